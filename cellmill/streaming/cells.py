"""Streams: windows, deduplication, stateful cells. Every transformation takes a DataFrame, so a batch gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellmill.session import settle, shared_dir
from cellmill.sources.publish import Files


def tumbling(events: DataFrame, size: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """Counts and sums of event types in fixed windows."""
    return _windowed(events, F.window("ts", size), late)


def sliding(events: DataFrame, size: str = "2 hours", step: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    return _windowed(events, F.window("ts", size, step), late)


def _windowed(events: DataFrame, window, late: str | None) -> DataFrame:
    source = events.withWatermark("ts", late) if late and events.isStreaming else events
    out = source.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "10 minutes") -> DataFrame:
    """Runs of a user's events no further apart than gap."""
    source = events.withWatermark("ts", late) if late and events.isStreaming else events
    out = source.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "total")


def first_seen(events: DataFrame, *keys: str, late: str = "1 day") -> DataFrame:
    """One row per key; repeats within the watermark are dropped."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.dropDuplicatesWithinWatermark(list(keys)) if events.isStreaming else source.dropDuplicates(list(keys))


def synchronised(a: DataFrame, b: DataFrame, keys: list[str], within: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Pairs of two streams (ts and keys) whose times are less than `within` apart; state is dropped behind the watermark."""
    left = a.withWatermark("ts", late) if a.isStreaming else a
    right = b.withWatermark("ts", late) if b.isStreaming else b
    right = right.select(*[F.col(c).alias(f"{c}_b") for c in right.columns])
    near = F.expr(f"ts_b > ts - INTERVAL {within} AND ts_b < ts + INTERVAL {within}")
    same = None
    for k in keys:
        same = (F.col(k) == F.col(f"{k}_b")) if same is None else same & (F.col(k) == F.col(f"{k}_b"))
    return left.join(right, same & near)


CELL_STATE = "n long, total double, last double, change double, steps long"


def stateful_cells(samples: DataFrame, keys: list[str], order: str, value: str, idle: int | None = None) -> DataFrame:
    """Running cells over a stream of samples: after every batch a key's count, mean and mean absolute change between neighbours.
    The last value is kept as state, starts anew with each key, and is dropped when a key has been
    idle for so many milliseconds (None: never; with a timeout a run over what is there does not end by itself, so it is for streams that go on)."""
    kinds = {f.name: f.dataType.simpleString() for f in samples.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n long, mean double, mean_change double"

    def step(key: tuple, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        n, total, last, change, steps = state.get if state.exists else (0, 0.0, None, 0.0, 0)
        rows = pd.concat(list(batches)).sort_values(order)
        for v in rows[value].dropna():
            if last is not None:
                change, steps = change + abs(v - last), steps + 1
            n, total, last = n + 1, total + v, v
        state.update((n, total, last, change, steps))
        if idle:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame([(*key, n, total / n if n else None, change / steps if steps else None)], columns=[*keys, "n", "mean", "mean_change"])

    return samples.groupBy(*keys).applyInPandasWithState(step, schema, CELL_STATE, "update", "ProcessingTimeTimeout" if idle else "NoTimeout")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session for a while; a stream keeps those it was started with."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_to_end(spark: SparkSession, stream: DataFrame, mode: str = "append", checkpoint: str | None = None, needs: dict[str, str] | None = None) -> DataFrame:
    """Runs a stream over all there is and returns its rows, which are written to the shared folder batch by batch. With a checkpoint folder, a second
    run goes on where it ended. In complete mode the last batch is the result. needs: settings that the stream is started with."""
    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/batch={number}")  # a batch that is tried again replaces itself

    writer = stream.writeStream.foreachBatch(put).outputMode(mode).trigger(availableNow=True)
    with settings(spark, needs or {}):
        query = writer.option("checkpointLocation", checkpoint or f"{place}-checkpoint").start()
    query.awaitTermination()
    files = Files(spark, place)
    if not checkpoint:
        files.delete(f"{place}-checkpoint")
    if not files.exists(place):
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(stream.schema.add("batch", "long")).parquet(place)
    if mode == "complete":
        rows = rows.filter(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    rows = settle(rows.drop("batch"))
    files.delete(place)
    return rows


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def append_new(spark: SparkSession, source: DataFrame, path: str, key: str, checkpoint: str, buckets: int = 1024) -> None:
    """Appends the rows of a stream whose key the table at path lacks: a resumed run skips what is done. The table is partitioned by a hash of the key
    (the column bucket), and of it only the keys in the batch's own buckets are read. Of equal keys in a batch one row is appended; a null key is a key.
    buckets must stay what it was when the table was begun."""
    own = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")

    def put(batch: DataFrame, _: int) -> None:
        fresh = settle(batch.dropDuplicates([key]).withColumn("bucket", own))  # counted, compared and written from one reading
        if _exists(spark, path):
            wanted = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # as many numbers as there are buckets at most
            known = spark.read.schema(fresh.schema).parquet(path).filter(F.col("bucket").isin(wanted)).select(F.col(key).alias("__known"))
            fresh = fresh.join(known, F.col(key).eqNullSafe(F.col("__known")), "left_anti")
        fresh.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)

    source.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_of(spark: SparkSession, path: str, schema: T.StructType, per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def predict(frames: DataFrame, model: Callable[[pd.DataFrame], pd.Series], key: str, schema: str) -> DataFrame:
    """Calls a model on batches of rows: key, prediction, error (null if it went well). A batch that fails is tried row by
    row, and a row that fails becomes an invalid prediction, not a lost one."""

    def run(batches):
        for b in batches:
            try:
                yield pd.DataFrame({key: b[key], "prediction": model(b), "error": None})
            except Exception:
                rows = []
                for i in range(len(b)):
                    one = b.iloc[[i]]
                    try:
                        rows.append((one[key].iloc[0], model(one).iloc[0], None))
                    except Exception as e:
                        rows.append((one[key].iloc[0], None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(rows, columns=[key, "prediction", "error"])

    return frames.mapInPandas(run, schema)
