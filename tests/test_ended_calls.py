"""A source's batch reads and writes its state once, however many cells it has."""

import pandas as pd

from cellmill.streaming.ended import EndingCells


class Store:
    def __init__(self):
        self.calls, self.value, self.timers = 0, None, []

    def getValueState(self, *_):
        one = Store()
        self.parts = [*getattr(self, "parts", []), one]
        return one

    getMapState = getValueState

    def __getattr__(self, name):
        if name in ("get", "exists", "update", "clear", "containsKey", "getValue", "updateValue", "removeKey", "values", "iterator"):
            def call(*args):
                self.calls += 1
                self.value = args[0] if name == "update" else None if name == "clear" else self.value
                return {"get": self.value, "exists": self.value is not None, "values": [], "iterator": []}.get(name)

            return call
        raise AttributeError(name)

    def listTimers(self):
        return list(self.timers)

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.append(t)


def test_calls_do_not_follow_the_cells():
    store = Store()
    cells = EndingCells(1_000, 10**9)
    cells.init(store)
    rows = pd.DataFrame({"cell": [f"c{i}" for i in range(500)], "ms": range(0, 50_000, 100), "value": 1.0})
    (out,) = cells.handleInputRows(("s",), iter([rows]), None)
    assert len(out) == 499 and set(out["status"]) == {"changed"} and sum(p.calls for p in store.parts) <= 4
    (more,) = cells.handleInputRows(("s",), iter([pd.DataFrame({"cell": ["c0", "c500"], "ms": [50_000, 50_001], "value": 1.0})]), None)
    assert list(more["status"]) == ["changed", "reopened"] and store.timers == [51_001]
