"""Streams give what batches give."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cellmill.streaming import cells as S


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "in")
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    e.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(path)
    return path


def both(spark, folder):
    batch = spark.read.parquet(folder)
    return batch, S.stream_of(spark, folder, batch.schema, 10)


def rows(df):
    return sorted(map(str, df.select(*[F.round(c, 4) if t == "double" else c for c, t in df.dtypes]).collect()))


@pytest.mark.parametrize("how", [S.tumbling, S.sliding, lambda d: S.sessions(d, "1 hour")])
def test_windows(spark, folder, how):
    batch, stream = both(spark, folder)
    closed = spark.createDataFrame([(10**9, dt.datetime(2100, 1, 1), 0, "end", 0.0)], batch.schema)
    got, want = rows(S.run_to_end(spark, how(stream), "append")), rows(how(batch))
    assert set(got) <= set(want) and len(got) >= len(want) * 0.9  # windows behind the watermark, which are nearly all
    assert closed.count() == 1


def test_dedup_and_join(spark, folder):
    batch, stream = both(spark, folder)
    one = S.run_to_end(spark, S.first_seen(stream.select("ts", "user_id", "event_id"), "event_id", late="400 days"))
    assert one.count() == batch.select("event_id").distinct().count()
    part = lambda d, t: d.filter(F.col("event_type") == t).select("ts", "user_id", "event_id")
    types = [r.event_type for r in batch.select("event_type").distinct().orderBy("event_type").collect()]
    pair = lambda d: S.synchronised(part(d, types[0]), part(d, types[1]), ["user_id"], "6 hours", "400 days").select("event_id", "event_id_b")
    assert rows(S.run_to_end(spark, pair(stream))) == rows(pair(batch))


def test_stateful_cells(spark, folder):
    batch, _ = both(spark, folder)
    stream = S.stream_of(spark, folder, batch.schema, 1)
    out = S.run_to_end(spark, S.stateful_cells(stream, ["user_id"], "ts", "value"), "update")
    last = {r.user_id: r for r in out.orderBy("n").collect()}
    want = batch.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).collect()
    assert {r.user_id: (r.n, round(r.mean, 6)) for r in want} == {u: (r.n, round(r.mean, 6)) for u, r in last.items()}


def test_resume_appends_only_new(spark, folder, tmp_path):
    batch, stream = both(spark, folder)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    S.append_new(spark, stream, out, "event_id", mark)
    S.append_new(spark, S.stream_of(spark, folder, batch.schema, 10), out, "event_id", mark)
    S.append_new(spark, S.stream_of(spark, folder, batch.schema, 10), out, "event_id", str(tmp_path / "lost mark"))
    whole = spark.read.parquet(out)
    assert whole.count() == batch.count() and {r.event_id for r in whole.collect()} == {r.event_id for r in batch.collect()}


def test_resume_reads_only_its_buckets(spark, folder, tmp_path):
    batch, _ = both(spark, folder)
    out, ids = str(tmp_path / "out"), sorted(r.event_id for r in batch.collect())
    one = batch.schema

    def add(name, rows):
        rows.write.parquet(str(tmp_path / name))
        S.append_new(spark, S.stream_of(spark, str(tmp_path / name), one, 10), out, "event_id", str(tmp_path / f"{name}-mark"), 16)

    add("most", batch.filter(F.col("event_id") != ids[0]))
    buckets = {r.event_id: r.bucket for r in spark.read.parquet(out).collect()}
    mine = batch.filter(F.col("event_id").isin(ids[0], ids[1]))
    other = next(b for b in sorted(set(buckets.values())) if b not in {buckets[ids[1]], mine.filter(F.col("event_id") == ids[0]).select(F.pmod(F.xxhash64(F.col("event_id").cast("string")), F.lit(16))).first()[0]})
    for file in (tmp_path / "out" / f"bucket={other}").glob("*.parquet"):
        file.write_bytes(b"torn")  # a bucket that the batch has no key of is never opened
    nulls = spark.createDataFrame([tuple(None for _ in one)], one)
    add("few", mine.unionByName(nulls).unionByName(nulls))
    sound = spark.read.parquet(*[str(p) for p in (tmp_path / "out").glob("bucket=*") if p.name != f"bucket={other}"])
    assert sound.filter(F.col("event_id").isin(ids[0], ids[1])).count() == 2 and sound.filter("event_id IS NULL").count() == 1
