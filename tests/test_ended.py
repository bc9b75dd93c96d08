"""Streamed cells that end: any cut into batches gives what a plain loop gives, and state goes when nothing can come of it."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cellmill.streaming import cells as S
from cellmill.streaming import ended as E

SCHEMA = "ts timestamp, source string, cell string, value double, part int"
T0 = dt.datetime(2024, 1, 1)
IDLE, MEMORY = 60_000, 300_000


def loop(rows, upto, idle=IDLE, memory=MEMORY):
    """The rule, sample by sample; upto: the watermark at the end, in seconds."""
    out = []
    for source in {r[1] for r in rows}:
        open_, closed = None, {}
        end = lambda at, status: (out.append((source, open_["cell"], open_["n"], open_["first"], open_["last"], status)), closed.update({open_["cell"]: at}))
        for t, _, cell, _ in sorted((r for r in rows if r[1] == source), key=lambda r: (r[0], r[2])):
            if open_ and 1000 * (t - open_["last"]) >= idle:
                end(open_["last"] + idle / 1000, "idle")
                open_ = None
            if open_ and open_["cell"] != cell:
                end(t, "changed")
                open_ = None
            if open_ is None and cell in closed and 1000 * (t - closed[cell]) < memory:
                out.append((source, cell, 1, t, t, "reopened"))
                continue
            open_ = open_ or {"cell": cell, "n": 0, "first": t}
            open_["n"] += 1
            open_["last"] = t
        if open_ and 1000 * (upto - open_["last"]) >= idle:
            end(0, "idle")
    return sorted(out)


def run(spark, tmp_path, rows, cuts, late="1 second"):
    """Streams the rows in files that are cut at so many times; returns the cells and the checkpoint."""
    place, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    edges = [*cuts, 10**9]
    for i, stop in enumerate(edges):
        part = [(T0 + dt.timedelta(seconds=r[0]), *r[1:], i) for r in rows if (edges[i - 1] if i else -1) <= r[0] < stop]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(place)
    stream = S.stream_of(spark, place, spark.read.parquet(place).schema, 1)
    out = S.run_to_end(spark, E.ending_cells(stream, "source", "cell", "ts", "value", IDLE, MEMORY, late), checkpoint=mark, needs=E.STORE).collect()
    at = lambda t: (t - T0).total_seconds()
    return sorted((r.source, r.cell, r.n, at(r.started), at(r.ended), r.status) for r in out), out, mark


ROWS = [
    (0, "a", "x", 1.0), (10, "a", "x", None), (20, "a", "y", 3.0), (30, "a", "x", 9.0), (40, "a", "y", 9.0), (45, "a", "z", 1.0), (104, "a", "z", 2.0), (164, "a", "z", 5.0), (200, "a", "w", None),
    (319, "a", "x", 7.0), (320, "a", "x", 7.0), (325, "a", "x", 8.0), (500, "a", "y", 1.0), (5, "b", "x", 4.0), (700, "b", "x", 4.0), (701, "b", "y", 4.0),
]


@pytest.mark.parametrize("cuts", [[], [15, 35, 105, 320], [1, 11, 21, 31, 41, 46, 105, 165, 201, 321, 501, 701]])
def test_any_cut_gives_the_loop(spark, tmp_path, cuts):
    mark = (5_000, "end", "end", 0.0)
    got, out, _ = run(spark, tmp_path, [*ROWS, mark], [*cuts, 4_000])
    assert got == loop([*ROWS, mark], 4_999)
    means = {(r.source, r.cell, r.status, (r.started - T0).total_seconds()): r["mean"] for r in out}
    assert means["a", "x", "changed", 0] == 1.0 and means["a", "w", "idle", 200] is None
    assert {r.status for r in out} == {"changed", "idle", "reopened"}


def test_state_is_empty_after_the_last_timer(spark, tmp_path):
    _, _, mark = run(spark, tmp_path, [*ROWS, (5_000, "end", "end", 0.0), (9_000, "end2", "end", 0.0)], [4_000, 6_000])
    state = lambda name: spark.read.format("statestore").option("stateVarName", name).load(mark)
    with S.settings(spark, E.STORE):
        assert [r.key.source for r in state("open").select("key").collect()] == ["end2"]
        assert state("closed").count() == 0


def test_open_cells_wait_for_the_next_run(spark, tmp_path):
    got, _, mark = run(spark, tmp_path, ROWS[:7], [])
    assert got == loop(ROWS[:7], 103) and not any(c == "z" for _, c, *_ in got)
    place = str(tmp_path / "in")
    later = [(T0 + dt.timedelta(seconds=r[0]), *r[1:], 9) for r in [*ROWS[7:13], (9_000, "end", "end", 0.0)]]
    spark.createDataFrame(later, SCHEMA).coalesce(1).write.mode("append").parquet(place)
    stream = S.stream_of(spark, place, spark.read.parquet(place).schema, 1)
    more = S.run_to_end(spark, E.ending_cells(stream, "source", "cell", "ts", "value", IDLE, MEMORY, "1 second"), checkpoint=mark, needs=E.STORE).collect()
    at = lambda t: (t - T0).total_seconds()
    assert sorted(got + [(r.source, r.cell, r.n, at(r.started), at(r.ended), r.status) for r in more]) == loop([*ROWS[:13], (9_000, "end", "end", 0.0)], 8_999)


def test_nulls_empty_and_batches(spark, tmp_path):
    rows = [(0, None, "x", 1.0), (1, "a", None, 1.0), (2, "a", "x", 1.0), (2, "a", "x", 1.0), (9_000, "end", "e", 1.0)]
    got, _, _ = run(spark, tmp_path, rows, [])
    assert got == [("a", "x", 2, 2.0, 2.0, "idle")]
    with pytest.raises(ValueError, match="streams"):
        E.ending_cells(spark.createDataFrame([], SCHEMA), "source", "cell", "ts", "value", 1, 1)
    stream = S.stream_of(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, 1).filter(F.lit(False))
    assert S.run_to_end(spark, E.ending_cells(stream, "source", "cell", "ts", "value", 1, 1), needs=E.STORE).count() == 0
