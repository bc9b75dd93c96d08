"""Tar shards: packed members come back, filters read the ranges that matter, torn shards lose nothing before the tear."""

import io
import tarfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, StringStartsWith

from cellmill.sources import shards as S

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def packed(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("shards") / "pages")
    pages = spark.read.parquet(f"{SF}/pages.parquet").select(F.format_string("%06d.page.html", "page_id").alias("member"), F.col("html").cast("binary").alias("data"))
    S.pack(pages, place, shards=3, shard_bytes=40_000, range_bytes=8_000)
    return place, {r.member: bytes(r.data or b"") for r in pages.collect()}


def planned(place, *filters):
    reader = S.ShardReader({"path": place, "rangebytes": "1"})
    left = list(reader.pushFilters(filters))
    return [r for p in reader.partitions() for r in p.parts], left


def test_round_trip(spark, packed):
    place, want = packed
    rows = S.read(spark, place, range_bytes=8_000).collect()
    assert {r.member: bytes(r.data) for r in rows} == want and len(rows) == len(want)
    assert len({r.shard for r in rows}) > 3 and all(r.error is None and r.size == len(r.data) for r in rows)
    assert all(r.data is None and r.size == len(want[r.member]) for r in S.read(spark, place, payload=False).collect())


def test_filters(spark, packed):
    place, want = packed
    names = sorted(want)
    everything, _ = planned(place)
    one, left = planned(place, EqualTo(("member",), names[100]))
    assert len(one) == 1 < len(everything) and not left
    assert len(planned(place, In(("member",), (names[0], names[-1])))[0]) == 2
    assert not planned(place, EqualTo(("member",), "zzz"))[0]
    assert 0 < len(planned(place, StringStartsWith(("member",), "00001"))[0]) < len(everything)
    shard = everything[0][0]
    assert {r[0] for r in planned(place, EqualTo(("shard",), shard))[0]} == {shard}
    found = S.read(spark, place, range_bytes=1).filter(F.col("member") == names[100])
    assert found.rdd.getNumPartitions() == 1 and bytes(found.collect()[0].data) == want[names[100]]
    assert {r.member for r in S.read(spark, place).filter(F.col("member").startswith("00001")).collect()} == {n for n in names if n.startswith("00001")}
    assert S.read(spark, place).filter(F.length("data") > 10).count() == sum(len(d) > 10 for d in want.values())
    assert S.read(spark, place).filter("member = 'zzz'").count() == 0


def _tar(names, fmt=tarfile.GNU_FORMAT):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=fmt) as t:
        for i, n in enumerate(names):
            info = tarfile.TarInfo(n)
            if n.endswith("/"):
                info.type = tarfile.DIRTYPE
                t.addfile(info)
            else:
                info.size = 700 * i
                t.addfile(info, io.BytesIO(bytes([i]) * 700 * i))
    return out.getvalue()


def test_foreign_and_torn(spark, tmp_path):
    long = "d/" + "x" * 300
    whole = _tar(["b", "folder/", "a", long, "ü/é", "a", "big" * 60])
    for name, data in {"gnu.tar": whole, "sub/pax.tar": _tar([long, "z", "é"], tarfile.PAX_FORMAT), "torn.tar": whole[:5200], "noise.tar": b"no tar at all" * 99, "empty.tar": b"", "none.tar": _tar([]), "readme.txt": b"x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    for most in (1, 2_000, 1 << 26):
        ranges = S.index(spark, str(tmp_path), most).collect()
        assert {r.shard for r in ranges} == {"gnu.tar", "sub/pax.tar", "torn.tar", "noise.tar", "empty.tar", "none.tar"}
        rows = S.read(spark, str(tmp_path)).collect()
        of = lambda s: sorted((r.member, len(r.data)) for r in rows if r.shard == s and r.error is None)
        assert of("gnu.tar") == sorted([("b", 0), ("a", 1400), (long, 2100), ("ü/é", 2800), ("a", 3500), ("big" * 60, 4200)])
        assert of("sub/pax.tar") == sorted([(long, 0), ("z", 700), ("é", 1400)])
        assert of("torn.tar") == sorted([("b", 0), ("a", 1400)]) and not of("noise.tar") and not of("none.tar")
        assert {r.shard for r in rows if r.error} >= {"torn.tar", "noise.tar"} and len([r for r in rows if r.shard == "torn.tar" and r.error]) == 1


def test_empty_folder_and_nothing_packed(spark, tmp_path):
    S.index(spark, str(tmp_path))
    assert S.read(spark, str(tmp_path)).count() == 0
    S.pack(spark.createDataFrame([], "member string, data binary"), str(tmp_path / "x"), 2)
    assert S.read(spark, str(tmp_path / "x")).count() == 0
    with pytest.raises(Exception, match="needs a name"):
        S.pack(spark.createDataFrame([(None, b"x")], "member string, data binary"), str(tmp_path / "y"), 2)
    S.index(spark, str(tmp_path / "y"))
    assert S.read(spark, str(tmp_path / "y")).count() == 0


def test_samples(spark):
    rows = [("s", "c/1.rgb.png", 1), ("s", "c/1.depth.png", 2), ("t", "c/1.rgb.jpg", 3), ("s", "c/2.rgb.png", 1), ("s", "odd", 1), ("s", None, None)]
    got = S.samples(spark.createDataFrame(rows, "shard string, member string, size long"), ["rgb", "depth"]).collect()
    assert [(r["sample"], r.rgb.member, r.depth.size) for r in got] == [("c/1", "c/1.rgb.png", 2)]
