"""Nearest rows in leaves of a k-d tree, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmill.operators import joins, nearby


@pytest.mark.parametrize("radius, others, k", [(None, True, 5), (0.25, False, 1), (0.05, False, 3)])
def test_nearest_rows_against_brute_force(spark, radius, others, k):
    rng = np.random.default_rng(3)
    x = np.round(np.concatenate([rng.normal(size=(150, 3)) * 0.1, rng.normal(size=(50, 3)), np.zeros((30, 3)), rng.integers(0, 3, (70, 3)) / 4]), 3)
    frame = lambda rows: spark.createDataFrame([(int(i), x[i].tolist()) for i in rows], "row long, x array<double>")
    asking, asked = (range(300), range(300)) if others else (range(0, 300, 2), range(1, 300, 2))
    got = sorted((r.row, r.d2, r.other) for r in nearby.nearest_rows(frame(asking), frame(asked), k, radius, others, leaf=16).collect())
    want = []
    for i in asking:
        near = sorted((float(((x[j] - x[i]) ** 2).sum()), j) for j in asked if not others or j != i)[:k]
        want += [(i, d, j) for d, j in near if radius is None or d <= radius * radius]
    assert got == sorted(want)


def test_close_points_are_not_multiplied(spark, monkeypatch):
    """Points that all lie in one cell of the radius' grid: a row visits a few leaves, not all."""
    rng = np.random.default_rng(4)
    rows = [(i, i % 2, *(rng.random(3) * 0.2).tolist()) for i in range(2000)]
    monkeypatch.setattr(nearby.nearest_rows, "__defaults__", (None, False, 64))
    df = spark.createDataFrame(rows, "i long, side int, x double, y double, z double")
    written = []
    settle = nearby.settle
    monkeypatch.setattr(nearby, "settle", lambda d: written.append(settle(d)) or written[-1])
    got = joins.nearest_within(df.filter("side = 0"), df.filter("side = 1"), ("x", "y", "z"), 0.25, "i", "i").collect()
    visits = written[-1].filter("leaves IS NOT NULL").agg(F.sum(F.size("leaves"))).first()[0]
    assert len(got) == 1000 and visits < 6000  # of 31 leaves for each of 1,000 rows
