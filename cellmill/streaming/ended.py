"""Streamed cells that end by event time: a cell is sent once, when it is over, and can't be opened again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What a stream with these cells must be started with (`cells.run_to_end(..., needs=STORE)`): timers and maps need a store that keeps them on disk.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
_FIELDS = "cell string, n bigint, mean double, started timestamp, ended timestamp, status string"


class EndingCells(StatefulProcessor):
    """State of one source: the open cell, and the cells it has closed with the time of closing. Times are milliseconds.

    Two timers keep the state small: one ends a cell that falls idle, one forgets closed cells after `memory`. Rows apply the same two rules
    by their own times, so results don't depend on how a stream is cut into batches."""

    def __init__(self, idle: int, memory: int):
        self.idle, self.memory = idle, memory

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept_open = handle.getValueState("open", "cell string, n bigint, total double, valued bigint, first bigint, last bigint")
        self.kept_closed = handle.getValueState("closed", "cell array<string>, at array<bigint>")

    def _load(self) -> None:
        """The source's state as plain values. A call on the store is a round trip, so a batch reads it once and writes it once."""
        now, over = self.kept_open.get(), self.kept_closed.get()
        self.open, self.closed = tuple(now) if now else None, dict(zip(over[0], map(int, over[1]))) if over else {}

    def _save(self) -> None:
        """Writes the state back, and one timer for the next thing that can happen: the open cell falls idle, or the oldest closed one is forgotten."""
        for state, value in ((self.kept_open, self.open), (self.kept_closed, self.closed and (list(self.closed), list(self.closed.values())))):
            if value:
                state.update(value)
            else:
                state.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        due = ([self.open[5] + self.idle] if self.open else []) + [at + self.memory for at in self.closed.values()]
        if due:
            self.handle.registerTimer(int(min(due)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        g = pd.concat([b[["cell", "ms", "value"]] for b in rows]).sort_values(["ms", "cell", "value"], kind="stable")
        cells, times, values = g["cell"].to_numpy(), g["ms"].to_numpy(np.int64), g["value"].to_numpy(float)
        # stretches of one cell without an idle gap inside
        cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (np.diff(times) >= self.idle)) + 1
        out: list[tuple] = []
        self._load()
        for a, b in zip([0, *cuts], [*cuts, len(g)]):
            self._stretch(cells[a], times[a:b], values[a:b], out)
        self._save()
        yield self._frame(key, out)

    def _stretch(self, cell: str, times: np.ndarray, values: np.ndarray, out: list[tuple]) -> None:
        if self.open and times[0] - self.open[5] >= self.idle:
            self._end(self.open[5] + self.idle, "idle", out)
        if self.open and self.open[0] != cell:
            self._end(int(times[0]), "changed", out)
        if self.open is None:
            at = self.closed.get(cell)
            # a cell that was closed is refused for as long as that is remembered
            late = 0 if at is None else int(np.searchsorted(times, at + self.memory))
            out.extend((cell, 1, None if np.isnan(v) else v, t, t, "reopened") for t, v in zip(times[:late], values[:late]))
            times, values = times[late:], values[late:]
            if len(times) == 0:
                return
            self.closed.pop(cell, None)
            self.open = (cell, 0, 0.0, 0, int(times[0]), int(times[0]))
        now, valued = self.open, ~np.isnan(values)
        self.open = (cell, now[1] + len(times), now[2] + float(values[valued].sum()), now[3] + int(valued.sum()), min(now[4], int(times[0])), max(now[5], int(times[-1])))

    def _end(self, at: int, status: str, out: list[tuple]) -> None:
        cell, n, total, valued, first, last = self.open
        out.append((cell, n, total / valued if valued else None, first, last, status))
        self.closed[cell] = int(at)
        self.open = None

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = timerValues.getCurrentWatermarkInMs(), []
        self._load()
        if self.open and self.open[5] + self.idle <= now:
            self._end(self.open[5] + self.idle, "idle", out)
        self.closed = {name: at for name, at in self.closed.items() if at + self.memory > now}
        self._save()
        yield self._frame(key, out)

    @staticmethod
    def _frame(key: tuple, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["cell", "n", "mean", "started", "ended", "status"])
        for c in ("started", "ended"):
            out[c] = pd.to_datetime(out[c].astype("int64"), unit="ms")
        out["n"], out["mean"] = out["n"].astype("int64"), out["mean"].astype(float)
        out.insert(0, "source", pd.Series([key[0]] * len(out), dtype=object))
        return out


def ending_cells(samples: DataFrame, source: str, cell, ts: str, value: str, idle: int, memory: int, late: str = "10 minutes") -> DataFrame:
    """Cells of a stream of samples, each sent once with count, mean, first and last time when it is over: `changed` when its source goes on with another
    cell, `idle` when no sample came for `idle` milliseconds of event time. A sample of a cell that is over is a row of its own, `reopened`, for `memory`
    milliseconds after the end (and it ends the cell that is open, as any change does); afterwards the name may be used anew.

    A source's samples are taken in the order of their times within a batch, batches in the order of the stream; those behind the watermark are
    dropped by it. Null values count as samples but not in the mean; samples without source, cell or time are left out. Of a source's
    samples in one batch time, cell and value are in memory at once, which maxFilesPerTrigger bounds. State: one open cell a source and
    the cells it closed within `memory`; nothing once a source has been silent for idle + memory."""
    if not samples.isStreaming:
        raise ValueError("ending_cells is for streams")
    if idle <= 0 or memory <= 0:
        raise ValueError("idle and memory must be positive")
    rows = samples.withWatermark(ts, late).filter(F.col(source).isNotNull() & F.col(ts).isNotNull())
    named = F.expr(cell) if isinstance(cell, str) else cell
    # plain names: the state's worker makes named tuples of rows, and these rename what begins with an underscore
    rows = rows.select(F.col(source).alias("source"), F.col(ts).alias("at"), named.cast("string").alias("cell"), F.unix_millis(F.col(ts)).alias("ms"), F.col(value).cast("double").alias("value"))
    kind = dict(rows.dtypes)["source"]
    out = rows.filter("cell IS NOT NULL").groupBy("source").transformWithStateInPandas(EndingCells(idle, memory), f"source {kind}, {_FIELDS}", "append", "EventTime")
    return out.withColumnRenamed("source", source)
