"""Queries of streaming operators as batches, with equal SQL; tests run the same as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellmill.plans.cells import rounded
from cellmill.sources.tables import table
from cellmill.streaming import cells as S
from cellmill.streaming import ended as E


def _events(spark, sf):
    return table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def _plain(df, places=4):
    return rounded(df.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes]), places)


def tumbling_windows(spark, sf):
    return _plain(S.tumbling(_events(spark, sf)))


def sliding_windows(spark, sf):
    return _plain(S.sliding(_events(spark, sf)))


def session_windows(spark, sf):
    return _plain(S.sessions(_events(spark, sf), "2 hours"))


def dedup_first(spark, sf):
    """Users by event type, each once."""
    return S.first_seen(_events(spark, sf), "user_id", "event_type").select("user_id", "event_type")


def stream_sync(spark, sf):
    """Clicks and purchases of a user less than an hour apart, as a join of two streams would pair them."""
    e = _events(spark, sf)
    a, b = (e.filter(F.col("event_type") == t).select("ts", "user_id", "event_id") for t in ("click", "purchase"))
    return S.synchronised(a, b, ["user_id"]).select("event_id", "event_id_b")


def ended_cells(spark, sf):
    """Users' days as cells of a stream that runs to its end; an error before six names the day before, which may be over by then. A cell falls idle
    after twelve hours, and ended ones are known for 400 days. Cells that the watermark (ten minutes late) hasn't ended yet are not sent."""
    kinds = table(spark, sf, "events").schema
    stream = spark.readStream.schema(kinds).parquet(f"{sf}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))  # a pattern, since a stream takes no single file
    day = "date_format(CASE WHEN event_type = 'error' THEN ts - INTERVAL 6 HOURS ELSE ts END, 'yyyy-MM-dd')"
    hours = 3_600_000
    return _plain(S.run_to_end(spark, E.ending_cells(stream, "user_id", day, "ts", "value", 12 * hours, 400 * 24 * hours), needs=E.STORE), 6)  # means of a few values of two places: no ties at six


def batch_predictions(spark, sf):
    """A model that fails on some rows, which become invalid predictions."""
    def model(b):
        if (b["value"] > 120).any():
            raise ValueError("out of range")
        return b["value"].round(3) * 2

    return S.predict(_events(spark, sf).select("event_id", "value"), model, "event_id", "event_id long, prediction double, error string").select("event_id", F.round("prediction", 3).alias("prediction"), F.col("error").isNotNull().alias("failed"))


QUERIES = {f.__name__: f for f in (tumbling_windows, sliding_windows, session_windows, dedup_first, stream_sync, ended_cells, batch_predictions)}

_F = "strftime({}, '%Y-%m-%d %H:%M:%S')"
ORACLE_SQL = {
    "tumbling_windows": f"""WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, event_type, value FROM events) SELECT {_F.format('s')} AS window_start, {_F.format('s + INTERVAL 1 HOUR')} AS window_end, event_type,
        count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY s, event_type""",
    "sliding_windows": f"""WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) - k * INTERVAL 1 HOUR AS s, event_type, value FROM events, (VALUES (0), (1)) AS t(k)) SELECT {_F.format('s')} AS window_start,
        {_F.format('s + INTERVAL 2 HOUR')} AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY s, event_type""",
    "session_windows": f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT user_id, {_F.format('min(ts)')} AS session_start, {_F.format('max(ts) + INTERVAL 2 HOUR')} AS session_end, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""",
    "dedup_first": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_sync": """SELECT a.event_id, b.event_id AS event_id_b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase'
        AND b.ts > a.ts - INTERVAL 1 HOUR AND b.ts < a.ts + INTERVAL 1 HOUR""",
    "ended_cells": f"""WITH e AS (
            SELECT user_id, epoch_us(ts) // 1000 AS ms, value, strftime(CASE WHEN event_type = 'error' THEN ts - INTERVAL 6 HOUR ELSE ts END, '%Y-%m-%d') AS cell FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
        c AS (SELECT *, row_number() OVER w AS k, CASE WHEN cell = lag(cell) OVER w AND ms - lag(ms) OVER w < 43200000 THEN 0 ELSE 1 END AS cut FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms, cell, value)),
        r AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM c),
        f AS (SELECT *, run = min(run) OVER (PARTITION BY user_id, cell) AS first_run FROM r),
        s AS (SELECT user_id, cell, run, count(*) AS n, avg(value) AS mean, min(ms) AS a, max(ms) AS b, any_value(first_run) AS kept FROM f GROUP BY user_id, cell, run),
        t AS (SELECT *, lead(a) OVER (PARTITION BY user_id ORDER BY run) AS next FROM s),
        o AS (SELECT user_id, cell, n, mean, a, b, CASE WHEN next - b < 43200000 THEN 'changed' ELSE 'idle' END AS status FROM t
                WHERE kept AND (next IS NOT NULL OR b + 43200000 <= (SELECT max(ms) - 600000 FROM e))
            UNION ALL SELECT user_id, cell, 1, value, ms, ms, 'reopened' FROM f WHERE NOT first_run)
        SELECT user_id, cell, n, round(mean, 6) AS mean, {_F.format('epoch_ms(a)')} AS started, {_F.format('epoch_ms(b)')} AS ended, status FROM o""",
    "batch_predictions": "SELECT event_id, CASE WHEN value <= 120 THEN round(round(value, 3) * 2, 3) END AS prediction, value > 120 AS failed FROM events",
}
