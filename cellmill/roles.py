"""Binding of the operators' roles to the tables at hand, for queries that run on any star schema with these tables.

scene: supplier; phase: order status; tier: third of the suppliers by balance; model and task: return flag and line status; metrics:
discount, quantity, tax and price of a line. Each binding has a DataFrame form and the same as a SQL common table expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmill.operators.ranks import global_rank, tertile
from cellmill.sources.tables import table

PHASES = ("clutter", "interaction", "clean")
TIERS = ("easy", "medium", "hard")
METRICS = ("absrel", "rmse", "delta1")


def phase_of(status: Column) -> Column:
    return F.when(status == "F", "clutter").when(status == "P", "interaction").when(status == "O", "clean")


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scene, score, tier"""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("scene"), F.col("s_acctbal").alias("score"))
    ranked = global_rank(s, "score", "scene")
    return ranked.select("scene", "score", tertile(F.col("rank"), F.col("total")).alias("tier"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line: sample, model, task, scene, phase, frame, metrics, latency and budget."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", phase_of(F.col("o_orderstatus")).alias("phase"))
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sample"), F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("task"),
        F.col("l_suppkey").alias("scene"), "phase", F.col("l_linenumber").alias("frame"),
        F.col("l_discount").alias("absrel"), (F.col("l_quantity") / 10).alias("rmse"), (1 - F.col("l_tax")).alias("delta1"),
        (F.col("l_extendedprice") / 1000).alias("latency_ms"), (F.col("l_linenumber") * 50).cast("long").alias("frame_budget"),
    )


def tiered_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).join(scenes(spark, sf_dir).select("scene", F.col("tier").alias("difficulty")), "scene", "left")


SCENES_SQL = """scenes AS (
    SELECT scene, score, CASE WHEN n < 3 THEN 'medium' WHEN rk * 3 <= total THEN 'easy' WHEN rk * 3 <= 2 * total THEN 'medium' ELSE 'hard' END AS tier
    FROM (SELECT s_suppkey AS scene, s_acctbal AS score, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS rk, count(*) OVER () AS total,
        (SELECT count(DISTINCT s_acctbal) FROM supplier) AS n FROM supplier))"""

SAMPLES_SQL = """samples AS (
    SELECT l_orderkey * 10 + l_linenumber AS sample, l_returnflag AS model, l_linestatus AS task, l_suppkey AS scene,
        CASE o_orderstatus WHEN 'F' THEN 'clutter' WHEN 'P' THEN 'interaction' WHEN 'O' THEN 'clean' END AS phase, l_linenumber AS frame,
        l_discount AS absrel, l_quantity / 10 AS rmse, 1 - l_tax AS delta1, l_extendedprice / 1000 AS latency_ms, CAST(l_linenumber * 50 AS BIGINT) AS frame_budget
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

TIERED_SQL = f"""{SCENES_SQL}, {SAMPLES_SQL}, tiered AS (SELECT samples.*, tier AS difficulty FROM samples LEFT JOIN scenes USING (scene))"""
