"""Plans: joint frames, even kinds, pending slots, cells that have too few."""

import pytest
from pyspark.sql import functions as F

from cellmill.operators import planning as B

SLOTS = [("main", "a", "all", None), ("half", "b", "first", None), ("later", None, "second", "not made yet")]


def rows(spark, frames):
    data = [(c, f, s, k, 100 * f + i) for c, n in frames.items() for f in range(n) for s in "ab" for i, k in enumerate("xyz") if not (f == 0 and s == "b")]
    return spark.createDataFrame(data, "cell string, frame int, stream string, kind string, id int")


def test_full_plan(spark):
    plan = B.full_plan(rows(spark, {"c": 9, "d": 7}), ["cell"], "frame", "stream", "kind", "id", SLOTS, 6, "s")
    got = plan.collect()
    for cell, eligible in (("c", 8), ("d", 6)):
        mine = [r for r in got if r.cell == cell]
        of = lambda s: [r for r in mine if r["slot"] == s]
        frames = lambda s: {r.frame for r in of(s)}
        assert len(of("main")) == len(frames("main")) == 6 and 0 not in frames("main") and all(r.eligible == eligible and r.enough for r in mine)
        assert len(frames("half")) == len(frames("later")) == 3 and frames("half") | frames("later") == frames("main")
        assert sorted(sum(r.kind == k for r in of("main")) for k in "xyz") == [2, 2, 2] and {r.kind for r in of("half")} == set("xyz")
        assert all(r.id is None and r.kind is None and r.reason == "not made yet" for r in of("later")) and all(r.id // 100 == r.frame and r.reason is None for r in of("main"))
    assert sorted(map(str, got)) == sorted(map(str, B.require_enough(plan, ["cell"]).collect()))


def test_too_few_and_none(spark):
    plan = B.full_plan(rows(spark, {"c": 9, "short": 3}), ["cell"], "frame", "stream", "kind", "id", SLOTS, 6, "s")
    assert {r.cell: r.n for r in plan.filter("NOT enough AND slot = 'main'").groupBy("cell").agg(F.count("*").alias("n")).collect()} == {"short": 2}
    with pytest.raises(ValueError, match="short has 2"):
        B.require_enough(plan, ["cell"])
    assert B.full_plan(rows(spark, {"c": 1}), ["cell"], "frame", "stream", "kind", "id", SLOTS, 6, "s").count() == 0
