"""Ranks that rest on approximate quantiles, where each run of a plan finds other quantiles; and rounding of ties."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from cellmill.operators import difficulty, ranks
from cellmill.plans.cells import rounded


@pytest.fixture
def fickle(monkeypatch):
    """Approximate quantiles that are off by a few ranks, and by others in every run."""

    def quantiles(values, shares):
        ordered = sorted(values)
        return [ordered[min(max(int(s * len(ordered)) + random.randint(-9, 9), 0), len(ordered) - 1)] for s in shares]

    pick = F.udf(quantiles, "array<double>").asNondeterministic()
    monkeypatch.setattr(F, "percentile_approx", lambda value, shares, accuracy=None: pick(F.collect_list(value), shares if not isinstance(shares, list) else F.array(*map(F.lit, shares))))


def test_percentile_norms_with_fickle_quantiles(spark, fickle):
    rows = [("f", float(i) * 1.5) for i in range(400)]
    got = sorted((r.v, r.p) for r in ranks.percentile_norm(spark.createDataFrame(rows, "feature string, v double"), ("feature",), "v", "p").collect())
    assert got == [(v, (i + 1) / 400) for i, (_, v) in enumerate(rows)]


def test_percentile_norms_of_values_that_each_run_makes_anew(spark):
    fresh = F.udf(lambda _: random.random(), "double").asNondeterministic()
    df = spark.range(200).select(F.lit("f").alias("feature"), fresh("id").alias("v"))
    assert sorted(r.p for r in ranks.percentile_norm(df, ("feature",), "v", "p").collect()) == [(i + 1) / 200 for i in range(200)]


def test_tier_borders_with_fickle_quantiles(spark, fickle, monkeypatch):
    monkeypatch.setattr(difficulty, "BRACKET", 20)
    df = spark.createDataFrame([(r, i, float(i * 7 % 300)) for r in range(3) for i in range(300)], "replicate int, k int, score double")
    got = difficulty.tier_borders(df, "replicate", "score", ["k"], 300).collect()
    assert len(got) == 3 and all((g.easy.score, g.medium.score) == (99.0, 199.0) for g in got)


def test_ties_are_rounded_as_in_sql(spark):
    values = [(2 * i + 1) * 5e-7 for i in range(20_000, 520_000, 9)] + [-0.0000005, 1e301, 0.1234564]
    got = [r.v for r in rounded(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")).orderBy("i").collect()]
    want = duckdb.connect().execute("SELECT i, round(v, 6) FROM (SELECT unnest(?) AS i, unnest(CAST(? AS DOUBLE[])) AS v) ORDER BY i", [list(range(len(values))), values]).fetchall()
    assert got == [v for _, v in want]
