"""Registries of metrics, their bounds, and tasks. Later registrations of a name win."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession

from cellmill.operators.scores import Spec

Calculator = Callable[[], dict[str, Column]]


@dataclass
class Task:
    """A task: the calculators that run on its rows, the metrics its analyses take, optional hooks on its cells."""

    name: str
    metrics: tuple[str, ...] = ()
    hooks: tuple[Callable[[DataFrame], DataFrame], ...] = ()


@dataclass
class Registry:
    calculators: dict[str, dict[str, Calculator]] = field(default_factory=dict)
    specs: dict[str, Spec] = field(default_factory=dict)
    tasks: dict[str, Task] = field(default_factory=dict)

    def metric(self, task: str, name: str | None = None) -> Callable[[Calculator], Calculator]:
        """Decorator: a function that returns aggregate columns by metric name."""

        def add(fn: Calculator) -> Calculator:
            self.calculators.setdefault(task, {})[name or fn.__name__] = fn
            return fn

        return add

    def spec(self, *specs: Spec) -> None:
        for s in specs:
            if s.best == s.worst:
                raise ValueError(f"bounds of {s.name} are equal")
            self.specs[s.name] = s

    def task(self, task: Task) -> None:
        self.tasks[task.name] = task

    def columns(self, task: str) -> dict[str, Column]:
        """All metrics of a task; of two with one name the later calculator's stays."""
        out: dict[str, Column] = {}
        for fn in self.calculators.get(task, {}).values():
            out |= fn()
        return out

    def evaluate(self, rows: DataFrame, task: str, *keys: str) -> DataFrame:
        """One aggregation with every metric of a task, then the task's hooks."""
        columns = self.columns(task)
        if not columns:
            raise KeyError(f"no metric is registered for {task}")
        out = rows.groupBy(*keys).agg(*[c.alias(n) for n, c in columns.items()])
        for hook in self.tasks.get(task, Task(task)).hooks:
            out = hook(out)
        return out

    def spec_table(self, spark: SparkSession) -> DataFrame:
        rows = [(s.name, s.direction, float(s.best), float(s.worst)) for s in self.specs.values()]
        return spark.createDataFrame(rows, "metric string, direction string, best double, worst double")


REGISTRY = Registry()
