"""The Spark session that tests, benchmarks and scripts share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold everywhere: UTC, adaptive plans, skew handling, Arrow transfer; checkpoints go when nothing refers to them any more.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def session(name: str = "cellmill", master: str | None = None, shuffle_partitions: int | None = None, driver_memory: str = "6g", **more: str) -> SparkSession:
    """A session with SETTINGS; on a cluster leave master and shuffle_partitions to the submission."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master).config("spark.driver.memory", driver_memory)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (SETTINGS | more).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel(os.environ.get("CELLMILL_LOG", "ERROR"))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where it is unset and the master is local."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return context._jsc.sc().getCheckpointDir().get()
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), "cellmill-checkpoints")
    context.setCheckpointDir(own)
    return own


def settle(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder once and goes on from there: nothing is computed twice, and a lost executor costs no earlier stage."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
