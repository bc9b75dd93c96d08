"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells.

Equal vectors of a label are one node with a multiplicity. Labels with more than CELL nodes are cut into cells by spherical
k-means, fitted on a bounded sample (SAMPLE nodes of large labels, those with the smallest hashes) with at most MAX_CENTROIDS centroids
in all, so the broadcast is bounded; every node is assigned. Cells that still hold more than SPLIT nodes are cut again by k-means of their own, fitted
on executors from a bounded sample of each, so cells don't grow with the table. Centroids stay `margin` degrees apart at least, so a dense
neighbourhood is not cut into cells that all its nodes would visit.

A node is at home in its nearest cell and visits all cells whose centroid is at most `margin` degrees further away than its own; the same holds
within a cell that is cut again. Within a cell, home nodes are compared with home nodes and visitors; a pair
met in two cells counts in the smaller one. A margin of twice the link angle (23 degrees at 0.98) makes the search exact; the
default of 8 leaves out pairs only where a link happens to point straight across a border (see README for measured recall).

A cell is dealt in blocks of about BLOCK nodes and compared block against block, so no task needs a whole cell. Tasks give sums
of links per node and a spanning forest of the linked nodes, never all pairs.

Vectors are most of what is shuffled and written: they stay 4-byte numbers where the table has such, go once into the parts of a cell and once
into its pairs of blocks, and come back to the rows by two hashes. Tables of cells are broadcast, but only cells above SPLIT (or BLOCK) nodes
are listed.

Edge cases: rows whose id, label or vector is null, and vectors that are empty, zero or hold null or non-finite components, link
with nothing; vectors of different lengths don't compare; repeated rows are vectors each; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmill.llm.common import cut, slices
from cellmill.llm.graph import components, smallest_reachable

SIMILARITY = 0.98
MARGIN = 8.0
CELL = 256
SPLIT = 1024
#: Centroids that one cell is cut into at most, and rows that one task assigns to them.
MAX_SUB, SUB_ROWS = 512, 4096
BLOCK = 1024
SAMPLE = 32_768
MAX_CENTROIDS = 32_768
ROUNDS = 8


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    rows = np.asarray(rows, np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def spherical_kmeans(rows: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k or fewer unit centroids of unit rows. Starts from rows spread evenly over their order."""
    centroids = rows[np.linspace(0, len(rows) - 1, k).astype(int)]
    for _ in range(rounds):
        nearest = np.concatenate([np.argmax(rows[at : at + 4096] @ centroids.T, axis=1) for at in range(0, len(rows), 4096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, rows)
        norms = np.linalg.norm(sums, axis=1)
        centroids = np.where(norms[:, None] > 0, sums / np.maximum(norms, 1e-300)[:, None], centroids)
    return centroids


def apart(centroids: np.ndarray, degrees: float) -> np.ndarray:
    """The centroids without those nearer than that to an earlier one."""
    near = np.cos(np.radians(degrees))
    kept = np.zeros(len(centroids), bool)
    for at in range(0, len(centroids), 512):
        block = centroids[at : at + 512]
        free = ~(block @ centroids[kept].T > near).any(axis=1) if kept.any() else np.ones(len(block), bool)
        among = block @ block.T > near
        for k in np.flatnonzero(free):
            if not (among[k, :k] & kept[at : at + k]).any():
                kept[at + k] = True
    return centroids[kept]


def fit_cells(nodes: DataFrame, cell: int = CELL, sample: int = SAMPLE, margin: float = MARGIN) -> dict[str, np.ndarray]:
    """Centroids by label, for labels with more than `cell` nodes. nodes: key, vector."""
    sizes = nodes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell).orderBy(F.desc("n"), "key").limit(MAX_CENTROIDS // 2)
    large = {r.key: r.n for r in sizes.collect()}
    total = sum(large.values())
    if not total:
        return {}
    share = min(1.0, sample / total)
    names = F.broadcast(nodes.sparkSession.createDataFrame([(k,) for k in large], "key string"))  # at most MAX_CENTROIDS / 2 names
    chosen = nodes.join(names, "key").filter(F.pmod(F.xxhash64(_doubles("vector")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("key", "vector").limit(2 * sample)
    by_key: dict[str, list] = {}
    for r in sorted(chosen.toArrow().to_pylist(), key=lambda r: (r["key"], r["vector"])):
        by_key.setdefault(r["key"], []).append(r["vector"])
    scale = min(1.0, MAX_CENTROIDS * cell / (2 * total))
    wanted = {k: min(max(1, int(large[k] * scale / cell)), max(1, len(v) // 4)) for k, v in by_key.items()}
    fitted = {k: apart(spherical_kmeans(unit(np.array(v)), wanted[k]), margin) for k, v in by_key.items() if wanted[k] > 1}
    return {k: c for k, c in fitted.items() if len(c) > 1}


def cells_of(rows: np.ndarray, centroids: np.ndarray, margin: float) -> list[list[int]]:
    """The home cell of each unit row, then those that it visits."""
    angles = np.degrees(np.arccos(np.clip(rows @ centroids.T, -1, 1)))
    nearest = angles.argmin(axis=1)
    near = angles <= angles[np.arange(len(rows)), nearest][:, None] + margin
    near[np.arange(len(rows)), nearest] = False
    return [[int(home), *map(int, np.flatnonzero(others))] for home, others in zip(nearest, near)]


def assign(nodes: DataFrame, cells: dict[str, np.ndarray], margin: float = MARGIN) -> DataFrame:
    """nodes (node, key, times, vector) with their cells (home first, then visited ones)."""
    shared = nodes.sparkSession.sparkContext.broadcast(cells)

    def run(batches):
        for batch in slices(batches, 1024):
            keys = np.array(batch.column(1).to_pylist(), object)
            at = [[0]] * len(keys)
            vectors = batch.column(3).to_pylist()
            for key in set(keys) & shared.value.keys():
                rows = np.flatnonzero(keys == key)
                for i, found in zip(rows, cells_of(unit([vectors[i] for i in rows]), shared.value[key], margin)):
                    at[i] = found
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.list_(pa.int32()))], names=["node", "key", "times", "vector", "cells"])

    return nodes.select("node", "key", "times", "vector").mapInArrow(run, _node_schema(nodes) + ", cells array<int>")


def _doubles(vector: str) -> Column:
    """The vector as doubles, whose hash doesn't depend on how the table keeps its numbers."""
    return F.col(vector).cast("array<double>")


def _node_schema(nodes: DataFrame) -> str:
    return f"node bigint, key string, times bigint, vector {nodes.schema['vector'].dataType.simpleString()}"


def split_cells(inside: DataFrame, margin: float = MARGIN, cell: int | None = None) -> DataFrame:
    """inside (node, key, times, vector, cells, cell) with subs: the parts of the cell, home first; [0] where the cell isn't cut."""
    cell = cell or CELL
    schema = _node_schema(inside) + ", cells array<int>, cell int, subs array<int>"
    sizes = inside.groupBy("key", "cell").agg(F.count(F.lit(1)).alias("n"))
    big = cut(sizes.filter(F.col("n") > SPLIT).withColumn("parts", F.least(F.ceil(F.col("n") / cell), F.lit(MAX_SUB))))
    known = inside.join(F.broadcast(big), ["key", "cell"], "left")  # a row for more than SPLIT nodes; a shuffle would carry all vectors
    whole = known.filter("n IS NULL").select(*inside.columns, F.array(F.lit(0)).alias("subs"))
    crowded = known.filter("n IS NOT NULL")
    draw = F.pmod(F.xxhash64("node", "cell"), F.lit(1 << 20)) <= F.least(F.lit(1.0), 4 * F.col("parts") / F.col("n")) * (1 << 20)

    def fit(table: pa.Table) -> pa.Table:
        rows = unit(np.array(table.column("vector").to_pylist()))
        rows = rows[np.argsort(table.column("node").to_numpy(), kind="stable")]
        k = min(table.column("parts")[0].as_py(), max(1, len(rows) // 4))
        centroids = apart(spherical_kmeans(rows, k), margin)
        return pa.table({"key": table.column("key")[:1], "cell": table.column("cell")[:1], "model": pa.array([centroids.tolist()], pa.list_(pa.list_(pa.float64())))})

    models = crowded.filter(draw).groupBy("key", "cell").applyInArrow(fit, "key string, cell int, model array<array<double>>")
    deals = F.ceil(F.col("n") / SUB_ROWS)
    dealt = crowded.select(*inside.columns, F.pmod(F.xxhash64("node"), deals).alias("deal"), F.lit(None).cast("array<array<double>>").alias("model"))
    columns = inside.columns
    copies = models.join(F.broadcast(big), ["key", "cell"]).withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), deals - 1)))
    none = lambda c: F.lit(None).cast(inside.schema[c].dataType).alias(c)
    copies = copies.select(*[c if c in ("key", "cell") else none(c) for c in inside.columns], "deal", "model")

    def place(table: pa.Table) -> pa.Table:
        model = pa.compute.drop_null(table.column("model"))
        rows = table.filter(pa.compute.is_valid(table.column("node"))).select(columns)
        subs = cells_of(unit(np.array(rows.column("vector").to_pylist())), np.array(model[0].as_py()), margin) if len(model) and len(rows) else [[0]] * len(rows)
        return rows.append_column("subs", pa.array(subs, pa.list_(pa.int32())))

    placed = dealt.unionByName(copies).repartition("key", "cell", "deal").groupBy("key", "cell", "deal").applyInArrow(place, schema)
    return whole.unionByName(placed)


def _once(homes: np.ndarray, visits: list[list[int]], here: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Whether a pair counts in this cell: one of the two is at home here, and they don't meet in a smaller cell."""
    out = (homes[u] == here) | (homes[v] == here)
    for at in np.flatnonzero(out & (homes[u] != homes[v])):
        inside, other = (u[at], v[at]) if homes[u[at]] == here else (v[at], u[at])
        out[at] = not (homes[other] < here and int(homes[other]) in visits[inside])
    return out


def compare(table: pa.Table, similarity: float = SIMILARITY) -> pa.Table:
    """Links within one pair of blocks of a cell: rows (node, null, links) and (node, other, null) of a spanning forest."""
    i, j = (table.column(c)[0].as_py() for c in ("i", "j"))
    node = table.column("node").to_numpy()
    order = np.lexsort((node,))
    node, times, block = node[order], table.column("times").to_numpy()[order], table.column("block").to_numpy()[order]
    rows = unit(np.array([table.column("vector")[int(k)].as_py() for k in order]))
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    a, b = np.nonzero(rows[left] @ rows[right].T >= similarity)
    u, v = left[a], right[b]
    if i == j:
        u, v = u[u < v], v[u < v]
    for level, name in (("cells", "cell"), ("subs", "sub")):
        visits = [table.column(level)[int(k)].as_py() for k in order]
        counts = _once(np.array([c[0] for c in visits]), visits, table.column(name)[0].as_py(), u, v)
        u, v = u[counts], v[counts]
    links = np.bincount(u, times[v], len(node)) + np.bincount(v, times[u], len(node))
    root = smallest_reachable(len(node), u, v)
    some, joined = np.flatnonzero(links > 0), np.flatnonzero(root != np.arange(len(node)))
    nulls = lambda n: pa.nulls(n, pa.int64())
    return pa.table({
        "node": pa.concat_arrays([pa.array(node[some]), pa.array(node[joined])]),
        "other": pa.concat_arrays([nulls(len(some)), pa.array(node[root[joined]])]),
        "links": pa.concat_arrays([pa.array(links[some].astype(np.int64)), nulls(len(joined))]),
    })


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", similarity: float = SIMILARITY, margin: float = MARGIN) -> DataFrame:
    """One row per row: id_col, n_links, component_id (smallest id reachable), kept (whether the row represents its group).
    Rows that share an id but not a vector are vectors each; their id names the group of either."""
    numbers = "array<float>" if rows.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    plain = rows.select(rows[id_col].cast("long").alias("id"), rows[label_col].alias("label"), rows[vector_col].cast(numbers).alias("vector"))
    key = F.concat_ws("|", F.col("label").cast("string"), F.size("vector").cast("string"))
    plain = plain.withColumn("key", F.when(usable(F.col("vector")) & F.col("id").isNotNull() & F.col("label").isNotNull(), key))
    digest = [F.xxhash64(_doubles("vector")).alias("d1"), F.xxhash64(F.lit(1), _doubles("vector")).alias("d2")]
    distinct = plain.filter("key IS NOT NULL").groupBy("key", "vector").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("times"))
    nodes = cut(distinct.withColumn("node", F.monotonically_increasing_id()))
    placed = cut(assign(nodes, fit_cells(nodes, margin=margin), margin))
    parted = cut(split_cells(placed.withColumn("cell", F.explode("cells")), margin))
    sub = parted.select("key", "cell", F.explode("subs").alias("sub")).groupBy("key", "cell", "sub").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    large = F.broadcast(cut(sub.filter("blocks > 1")))  # a row for more than BLOCK nodes
    inside = parted.withColumn("sub", F.explode("subs")).join(large, ["key", "cell", "sub"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    blocked = inside.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = blocked.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", "cell", "sub", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "node", "times", "cells", "subs", "vector"
    )
    compared = cut(pairs.repartition("key", "cell", "sub", "i", "j").groupBy("key", "cell", "sub", "i", "j").applyInArrow(lambda t: compare(t, similarity), "node bigint, other bigint, links bigint"))
    links = compared.filter("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(compared.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    names = nodes.select("node", "key", *digest, "least", "times")
    named = cut(names.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    known = named.join(links, "node", "left").join(ids, "component").select("key", "d1", "d2", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links"), "component_id")
    found = plain.select("id", "key", *digest).join(cut(known), ["key", "d1", "d2"], "left")
    component = F.coalesce("component_id", "id")
    return found.select(
        F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )
