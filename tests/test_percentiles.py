"""Percentiles of whole groups, without a task that holds a group's values."""

import math

import numpy as np
import pytest

from cellmill.operators.ranks import percentiles
from cellmill.plans import cells as P

SHARES = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.95, "e": 1.0}


def test_percentiles_of_groups_with_ties_and_nulls(spark):
    draw = np.random.default_rng(2)
    values = {"x": [float(v) for v in draw.integers(0, 50, 301)], "y": [7.5], None: [float(v) for v in draw.normal(size=40)], "z": [1.0] * 99 + [2.0]}
    rows = [(k, v) for k, vs in values.items() for v in [*vs, None]] + [("none", None)]
    got = {r.k: r for r in percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", SHARES).collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        for name, q in SHARES.items():
            assert got[k][name] == pytest.approx(np.percentile(vs, q * 100), abs=1e-12) and not math.isnan(got[k][name])


def test_latencies_are_not_gathered_by_model(spark):
    plan = P.latency_percentiles(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan
