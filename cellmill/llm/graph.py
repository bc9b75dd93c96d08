"""Connected components over a table of links, without gathering links or labels on the driver.

Up to LOCAL_LINKS links, which is counted, one task solves the whole graph: that many links take a few megabytes. Beyond, every
task first replaces the links it holds by a spanning forest, and rounds of joins follow until few enough are left. Each round hooks every node to its smallest neighbour, flattens the resulting forest by pointer jumping, and contracts the
links. A round at least halves the number of nodes that still have links. Joins meet a hot node only on the side that
adaptive execution can split; minima are pre-aggregated before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmill.llm.common import cut

LOCAL_LINKS = 500_000


def smallest_reachable(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each of n positions over links u - v."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _solve(batches):
    """Rows (node, component) of the graph that a task's links make; components name themselves too."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        u, v = (np.concatenate(x) for x in zip(*parts))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        label = smallest_reachable(len(nodes), at[: len(u)], at[len(u) :])
        for k in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[k : k + (1 << 16)]), pa.array(nodes[label[k : k + (1 << 16)]])], names=["node", "component"])


def _flatten(parents: DataFrame) -> DataFrame:
    """parents: node, parent, with parent <= node. Follows parents up to the roots."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        parents = cut(
            parents.join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent"), (F.col("grand") < F.col("parent")).alias("moved"))
        )
        if parents.filter("moved").isEmpty():
            return parents.select("node", "parent")
        parents = parents.select("node", "parent")


def components(links: DataFrame) -> DataFrame:
    """links: a, b (longs; nulls and self links are ignored). Returns node, component (smallest node reachable) for every node
    that has a link to another node."""
    local = lambda df: df.select("a", "b").mapInArrow(_solve, "node bigint, component bigint")
    links = cut(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels, n = None, links.count()
    if n > LOCAL_LINKS:
        links = cut(local(links).filter("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")).distinct())
    while n > LOCAL_LINKS:
        both = links.union(links.select("b", "a")).toDF("node", "other")
        parents = _flatten(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("parent")))
        root = lambda name: parents.select(F.col("node").alias(name), F.col("parent").alias(f"root_{name}"))
        if labels is None:
            labels = parents.toDF("node", "component")
        else:
            labels = cut(labels.join(parents.toDF("component", "root"), "component", "left").select("node", F.coalesce("root", "component").alias("component")))
        links = cut(
            links.join(root("a"), "a").join(root("b"), "b").filter("root_a <> root_b")
            .select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct()
        )
        n = links.count()
    last = cut(local(links.coalesce(1)))
    if labels is None:
        return last
    return labels.join(last.toDF("component", "root"), "component", "left").select("node", F.coalesce("root", "component").alias("component"))
