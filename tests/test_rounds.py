"""Rounds over groups of any size equal the sequential rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmill.operators import grouped as R
from cellmill.operators import rounds as D


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_farthest_points(spark):
    rng = np.random.default_rng(5)
    data = [(g, i, float(x), float(y)) for g, n in (("a", 60), ("b", 3), ("c", 1)) for i, (x, y) in enumerate(rng.integers(0, 6, (n, 2)))]  # many ties and equal points
    df = spark.createDataFrame(data, "g string, i int, x double, y double")
    assert rows(D.farthest_points(df, ["g"], "i", ("x", "y"), 7)) == rows(R.farthest_point_sample(df, ["g"], "i", ("x", "y"), 7))
    odd = df.unionByName(spark.createDataFrame([("a", 99, None, 1.0), (None, 1, 1.0, 1.0), ("d", None, 1.0, 1.0)], df.schema))
    assert rows(D.farthest_points(odd, ["g"], "i", ("x", "y"), 2)) == rows(D.farthest_points(df, ["g"], "i", ("x", "y"), 2))
    assert D.farthest_points(df.limit(0), ["g"], "i", ("x", "y"), 3).count() == 0


def test_set_cover(spark):
    rng = np.random.default_rng(6)
    data = [(g, int(i), int(e)) for g, n in (("a", 90), ("b", 12)) for i, e in rng.integers(0, 15, (n, 2))] * 2
    df = spark.createDataFrame(data, "g string, i int, e int")
    for most in (1, 4, 50):
        assert rows(D.set_cover(df, ["g"], "i", "e", most)) == rows(R.set_cover(df, ["g"], "i", "e", most))
    odd = df.unionByName(spark.createDataFrame([("a", None, 1), ("b", 3, None), ("z", None, None)], df.schema))
    assert rows(D.set_cover(odd, ["g"], "i", "e", 3)) == rows(D.set_cover(df, ["g"], "i", "e", 3))
    assert D.set_cover(df.limit(0), ["g"], "i", "e", 3).count() == 0


@pytest.mark.parametrize("chain", [False, True])
def test_conflict_free(spark, chain):
    rng = np.random.default_rng(7)
    random = [(g, int(a), int(b), float(w)) for g, n in (("a", 80), ("b", 10)) for a, b, w in rng.integers(0, 9, (n, 3))]
    line = [("a", i // 2, (i + 1) // 2, float(i)) for i in range(8)]
    df = spark.createDataFrame(line if chain else random, "g string, a int, b int, w double").groupBy("g", "a", "b").agg(F.max("w").alias("w"))
    assert rows(D.conflict_free(df, ["g"], "a", "b", "w")) == rows(R.conflict_free(df, ["g"], "a", "b", "w"))
    odd = df.unionByName(df).unionByName(spark.createDataFrame([("a", None, 1, 99.0), ("a", 1, 1, None), (None, 1, 1, 99.0)], df.schema))  # repeated rows and nulls
    assert rows(D.conflict_free(odd, ["g"], "a", "b", "w")) == rows(D.conflict_free(df, ["g"], "a", "b", "w"))
    assert D.conflict_free(df.limit(0), ["g"], "a", "b", "w").count() == 0
