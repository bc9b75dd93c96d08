"""A resumable log of work: what is done, what failed, and how often it was tried.

Outcomes are kept by a hash of their key in buckets, which are partition folders, so a batch reads the buckets of its own keys alone. Every batch of
outcomes is written to a folder of its own and committed by a rename that can't replace anything: a batch that is repeated after a loss
adds nothing. Failed keys are given out again until they have been tried `most` times; what is done never is.

Edge cases: a null key is a key; repeated keys of a batch are tried once; an empty batch is committed and adds nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmill.sources.publish import Files

BUCKETS = 1024


class Ledger:
    def __init__(self, spark: SparkSession, folder: str, key: str, kind: str, buckets: int = BUCKETS, most: int = 3):
        """kind: SQL type of the key column. buckets must stay what it was when the folder was begun."""
        self.spark, self.folder, self.key, self.buckets, self.most = spark, folder, key, buckets, most
        self.files, self.kind = Files(spark, folder), kind

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def _log(self) -> DataFrame:
        schema = f"{self.key} {self.kind}, state string, attempts int, detail string, batch string, bucket int"
        if not [n for n in self.files.names(self.folder) if n.startswith("batch=")]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.folder).parquet(f"{self.folder}/batch=*")

    def known(self, items: DataFrame) -> DataFrame:
        """key, done, attempts of items' keys that were tried; reads their buckets only."""
        wanted = [r[0] for r in items.select(self.bucket()).distinct().collect()]  # at most as many numbers as there are buckets
        rows = self._log().filter(F.col("bucket").isin(wanted)).select(F.col(self.key).alias("known"), "state", "attempts")
        return rows.groupBy("known").agg(F.max(F.col("state") == "done").alias("done"), F.max("attempts").alias("attempts"))

    def pending(self, items: DataFrame) -> DataFrame:
        """The items, one a key, that are neither done nor tried too often."""
        over = self.known(items).filter(F.col("done") | (F.col("attempts") >= self.most))
        return items.dropDuplicates([self.key]).join(over, F.col(self.key).eqNullSafe(F.col("known")), "left_anti")

    def record(self, outcomes: DataFrame, batch: str) -> bool:
        """outcomes: the key, ok (boolean; null is false), detail. False if the batch is in already."""
        if self.files.exists(f"{self.folder}/batch={batch}"):
            return False
        tried = self.known(outcomes)
        rows = outcomes.dropDuplicates([self.key]).join(tried, F.col(self.key).eqNullSafe(F.col("known")), "left").select(
            self.key, F.when(F.col("ok"), "done").otherwise("failed").alias("state"), (F.coalesce("attempts", F.lit(0)) + 1).alias("attempts"), "detail", self.bucket().alias("bucket")
        )
        staged = f"{self.folder}/staged-{uuid.uuid4().hex}"
        rows.repartition("bucket").write.partitionBy("bucket").parquet(staged)
        if self.files.rename(staged, f"{self.folder}/batch={batch}"):
            return True
        self.files.delete(staged)
        return False

    def run(self, items: DataFrame, work: Callable[[DataFrame], DataFrame], batch: str) -> bool:
        """Does what is pending among the items. work gets them and returns the key, ok and detail of each."""
        if self.files.exists(f"{self.folder}/batch={batch}"):
            return False
        return self.record(work(self.pending(items)), batch)

    def follow(self, stream: DataFrame, work: Callable[[DataFrame], DataFrame], checkpoint: str, name: str) -> None:
        """The same for all there is of a stream, batch by batch."""
        put = lambda batch, number: self.run(batch, work, f"{name}-{number}") and None
        stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def states(self) -> DataFrame:
        """key, state, attempts and the detail of the last attempt."""
        last = F.max_by(F.struct("state", "detail"), F.struct(F.col("state") == "done", "attempts")).alias("last")
        return self._log().groupBy(self.key).agg(last, F.max("attempts").alias("attempts")).select(self.key, "last.state", "attempts", "last.detail")
