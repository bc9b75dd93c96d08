"""Decoders, published tables and the resumable log."""

import io
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmill.sources import decode as B
from cellmill.sources import sinks
from cellmill.sources.publish import Conflict, Files, Published
from cellmill.streaming.ledger import Ledger


def filtered_png(pixels, bits, colour, kinds):
    """A PNG whose rows take the given filters in turn, by the format's own words."""
    deep = pixels.reshape(*pixels.shape[:2], -1)
    step = max(1, deep.shape[2] * bits // 8)
    rows = [r.astype(">u2" if bits == 16 else np.uint8).tobytes() for r in deep]
    out, above = b"", bytes(len(rows[0]))
    for y, row in enumerate(rows):
        kind, line = kinds[y % len(kinds)], []
        for i, x in enumerate(row):
            a, b, c = row[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((x - [0, a, b, (a + b) // 2, near][kind]) % 256)
        out, above = out + bytes([kind, *line]), row
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    half = zlib.compress(out)
    return B.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", deep.shape[1], deep.shape[0], bits, colour, 0, 0, 0)) + chunk(b"IDAT", half[:20]) + chunk(b"IDAT", half[20:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("colour,n", [(0, 1), (2, 3), (4, 2), (6, 4)])
@pytest.mark.parametrize("bits", [8, 16])
@pytest.mark.parametrize("kinds", [(0, 1, 2, 3, 4), (4,), (3,), (1, 1)])
def test_png_filters(bits, colour, n, kinds):
    pixels = np.random.default_rng(1).integers(0, 1 << bits, (11, 7, n)).astype(np.uint16 if bits == 16 else np.uint8)
    got, _ = B.png(filtered_png(pixels, bits, colour, kinds))
    assert got.dtype == pixels.dtype and (got.reshape(pixels.shape) == pixels).all()


def test_contracts(spark):
    rng = np.random.default_rng(2)
    deep, small, colour = rng.integers(0, 60_000, (5, 6)).astype(np.uint16), rng.integers(0, 4, (5, 6)).astype(np.uint8), rng.integers(0, 255, (5, 6, 3)).astype(np.uint8)
    palette = np.array([[0, 0, 0], [255, 0, 0], [0, 255, 0], [10, 20, 30]])
    depth, grey, rgb, mask = B.encoded_png(deep), B.encoded_png(small), B.encoded_png(colour), B.encoded_png(small, palette)
    npz = io.BytesIO()
    np.savez(npz, position=[1, 2, 3], orientation=[0, 0, 0, 1])
    pose = B.npy(np.array([1, 2, 3, 0, 0, 0, 1], np.float32))
    cases = [
        ("depth", depth, deep), ("depth", grey, None), ("depth", depth[:-5], None), ("depth", depth[:60] + b"x" + depth[61:], None), ("depth", b"", None), ("depth", None, "null"), ("mask", mask, small), ("mask", depth, deep), ("mask", rgb, None),
        ("rgb", rgb, colour), ("rgb", mask, palette[small]), ("rgb", depth, None), ("grey", grey, small), ("grey", rgb, None if False else (colour @ np.array(B.LUMA) + 32768) >> 16),
        ("pose", pose, [1, 2, 3, 0, 0, 0, 1]), ("pose", npz.getvalue(), [1, 2, 3, 0, 0, 0, 1]), ("pose", B.npy(np.zeros(6)), None), ("pose", b"torn", None), ("array", B.npy(np.arange(6.0).reshape(2, 3)), np.arange(6.0)), ("array", B.npy(np.array(["x"])), None), ("array", B.npy(np.zeros(0)), []),
    ]
    rows = spark.createDataFrame([(i, kind, data) for i, (kind, data, _) in enumerate(cases)], "i int, kind string, data binary")
    for kind in B.KINDS:
        for r in rows.filter(F.col("kind") == kind).select("i", B.decode(F.col("data"), kind).alias("o")).collect():
            want = cases[r.i][2]
            if want is None:
                assert r.o.error and r.o.values is None, cases[r.i]
            elif isinstance(want, str):
                assert r.o.error is None and r.o.values is None
            else:
                assert r.o.error is None and r.o.values == np.ravel(want).astype(float).tolist()
    with pytest.raises(ValueError):
        B.decode(F.col("data"), "video")


def test_bits_below_a_byte():
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    image = lambda colour, interlaced=0: B.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 2, 2, colour, 0, 0, interlaced)) + chunk(b"PLTE", bytes(range(12))) + chunk(b"IDAT", zlib.compress(bytes([0, 0b00011011, 0b11000000, 0, 0b11100100, 0]))) + chunk(b"IEND", b"")
    assert B.png(image(3))[0].tolist() == [[0, 1, 2, 3, 3], [3, 2, 1, 0, 0]]
    assert B.png(image(0))[0].tolist() == [[0, 85, 170, 255, 255], [255, 170, 85, 0, 0]]
    with pytest.raises(ValueError, match="interlaced"):
        B.png(image(3, 1))


def broken(spark):
    return spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("v"))


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "cells.parquet")
    sinks.write_cells(spark.range(3).withColumnRenamed("id", "v"), path)
    with pytest.raises(Exception, match="lost"):
        sinks.write_cells(broken(spark), path)
    assert spark.read.parquet(path).count() == 3 and [p.name for p in tmp_path.iterdir()] == ["cells.parquet"]
    sinks.write_cells(spark.range(4).withColumnRenamed("id", "v"), path)
    assert spark.read.parquet(path).count() == 4 and [p.name for p in tmp_path.iterdir()] == ["cells.parquet"]
    with pytest.raises(ValueError, match="at most 2 rows"):
        sinks.markdown(spark.range(3), most=2)


def test_published_versions(spark, tmp_path):
    p = Published(spark, str(tmp_path / "t"))
    assert p.number() == 0
    assert p.publish(spark.range(3), {"a": 1, "foreign": "kept"}) == 1
    with pytest.raises(Exception, match="lost"):
        p.publish(broken(spark))
    assert p.number() == 1 and p.read().count() == 3
    assert p.publish(spark.range(5), {"a": 2}) == 2 and p.sidecar() == {"a": 2, "foreign": "kept"}
    with pytest.raises(Conflict):
        p.publish(spark.range(9), based_on=1)  # another has published since it was read
    assert p.read().count() == 5 and p.read(1).count() == 3
    files = Files(spark, str(tmp_path))
    p.keep(1)
    assert len([n for n in files.names(f"{tmp_path}/t") if n.startswith("version-")]) == 1 and p.read().count() == 5
    assert p.publish(p.read().limit(0)) == 3 and p.read().count() == 0


def test_two_interrupted_runs_equal_one(spark, tmp_path):
    items = spark.createDataFrame([(i,) for i in range(200)] + [(None,), (3,)], "k int")
    bad = lambda df: df.select("k", F.when(F.col("k").isNotNull(), F.col("k") % 10 > 0).alias("ok"), F.lit("x").alias("detail"))  # noqa: E731  tens and null always fail
    whole, parts = (Ledger(spark, str(tmp_path / n), "k", "int", buckets=16, most=2) for n in ("whole", "parts"))
    assert whole.run(items, bad, "1") and whole.run(items, bad, "2")
    torn = lambda df: bad(df).withColumn("ok", F.when(F.col("k") == 150, F.raise_error(F.lit("lost")).cast("boolean")).otherwise(F.col("ok")))
    assert parts.run(items.filter("k < 90"), bad, "1")
    with pytest.raises(Exception, match="lost"):
        parts.run(items, torn, "2")
    assert parts.run(items, bad, "2") and not parts.run(items, bad, "2") and parts.run(items, bad, "3")
    read = lambda ledger: sorted((r.k is not None, r.k or 0, r.state, r.attempts) for r in ledger.states().collect())
    assert read(whole) == read(parts) and len(read(whole)) == 201 and sum(r[3] == 2 for r in read(whole)) == 21
    assert whole.pending(items).count() == 0
    plan = whole.known(items.filter("k = 5"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "detail" not in plan.split("ReadSchema")[1]


def test_the_ledger_follows_a_stream(spark, tmp_path):
    for n in range(3):
        spark.range(n * 10, n * 10 + 15).withColumnRenamed("id", "k").write.parquet(str(tmp_path / f"in-{n}"))
    good = lambda df: df.select("k", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("detail"))
    ledger = Ledger(spark, str(tmp_path / "log"), "k", "bigint", buckets=8)
    stream = lambda: spark.readStream.schema("k bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in-*"))
    ledger.follow(stream(), good, str(tmp_path / "mark"), "s")
    ledger.follow(stream(), good, str(tmp_path / "lost mark"), "s")  # the same batches again
    assert sorted((r.k, r.attempts) for r in ledger.states().collect()) == [(k, 1) for k in range(35)]
