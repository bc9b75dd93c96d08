"""Merkle manifest of a table: a digest for every row, a tree for every source, one root, and a proof for every row.

A row's leaf is the SHA-256 of its fields, each with its length in front. Leaves of a source stand in the order of their ids; FANOUT
consecutive nodes become one, the last run may be shorter, until one is left, the source's subroot. Subroots, in the order of their
sources, make the root in the same way. A node is the SHA-256 of its children's hexadecimal digests.

Superblocks: nodes are numbered and bucketed by FANOUT ** LEVELS; one call collapses LEVELS levels of one bucket, so a group has that many rows at
most, whatever a source holds. The buckets' roots are the nodes of the next round, until each source has one. Proofs
come down the same rounds: a bucket's upper proof, made once, follows the lower proofs of its members.

Numbers come from sorted ranges (common.running_sums), so no source needs one task.

Edge cases: a null field is "-", so it differs from an empty one; a null source is a source and comes first; null ids come first, equal ids
are ordered by their leaves, and equal rows are leaves each; a single leaf is its source's subroot, and a single subroot the root; a leaf
without any siblings has the digest of nothing as its proof; rows without an id are not tampered with; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmill.llm.common import cut, running_sums

FANOUT = 3
LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "tree string, idx bigint, n bigint, node string"
_PATH = "tree string, idx bigint, subroot string, lefts array<string>, rights array<string>"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def depth(n: int, fanout: int = FANOUT) -> int:
    """Levels above n nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def collapse(nodes: list[str], levels: int, fanout: int = FANOUT) -> list[list[str]]:
    """The nodes and the levels above them."""
    out = [nodes]
    for _ in range(levels):
        out.append([digest(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def steps(levels: list[list[str]], at: int, fanout: int = FANOUT) -> tuple[list[str], list[str]]:
    """On the way from a node to the top of its bucket: the joined siblings to the left and to the right, level by level."""
    lefts, rights = [], []
    for nodes in levels[:-1]:
        begin = at - at % fanout
        lefts.append("".join(nodes[begin:at]))
        rights.append("".join(nodes[at + 1 : begin + fanout]))
        at //= fanout
    return lefts, rights


def fold(node: str, lefts: list[str], rights: list[str]) -> str:
    """The root that a node and its siblings give."""
    for left, right in zip(lefts, rights):
        node = digest(left, node, right)
    return node


def _bucket(levels: int, fanout: int) -> Column:
    return F.floor(F.col("idx") / F.lit(fanout**levels)).cast("long")


def _levels_of(group: pd.DataFrame, levels: int, fanout: int) -> list[list[str]]:
    return collapse(group["node"].tolist(), min(levels, depth(int(group["n"].iloc[0]), fanout)), fanout)


def rounds(nodes: DataFrame, levels: int = LEVELS, fanout: int = FANOUT) -> list[DataFrame]:
    """nodes (tree, idx, n, node; n: nodes of the tree), then the nodes that are left after each round of `levels` levels. In the last each tree has one."""
    size = fanout**levels

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("idx")
        top = _levels_of(group, levels, fanout)[-1][0]
        return pd.DataFrame({"tree": [key[0]], "idx": [key[1]], "n": [-(-int(group["n"].iloc[0]) // size)], "node": [top]})

    out, most = [nodes], nodes.agg(F.max("n").alias("n")).first()["n"] or 0
    while most > 1:
        up = out[-1].select("tree", "idx", "n", "node").groupBy("tree", _bucket(levels, fanout).alias("bucket")).applyInPandas(one, _NODE)
        out.append(cut(up))
        most = -(-most // size)
    return out


def descend(members: DataFrame, above: DataFrame, each: Callable, schema: str, levels: int = LEVELS, fanout: int = FANOUT) -> DataFrame:
    """One row per member, made by each(member rows of a bucket by idx, its levels, the path of the bucket's root). above: the paths
    of the nodes of the next round."""

    def one(key: tuple, group: pd.DataFrame, parent: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("idx")
        return each(group, _levels_of(group, levels, fanout), parent.iloc[0])

    bucketed = members.withColumn("bucket", _bucket(levels, fanout))
    parents = above.withColumnRenamed("idx", "bucket")
    return bucketed.groupBy("tree", "bucket").cogroup(parents.groupBy("tree", "bucket")).applyInPandas(one, schema)


def _lower(fanout: int) -> Callable:
    def paths(group: pd.DataFrame, levels: list[list[str]], parent: pd.Series) -> pd.DataFrame:
        found = [steps(levels, at, fanout) for at in range(len(group))]
        return pd.DataFrame({"tree": group["tree"], "idx": group["idx"], "subroot": parent["subroot"], "lefts": [[*a, *parent["lefts"]] for a, _ in found], "rights": [[*b, *parent["rights"]] for _, b in found]})

    return paths


def _paths(levels_up: list[DataFrame], top: DataFrame, levels: int, fanout: int) -> DataFrame:
    """The paths of the first of levels_up, from those of the last (top)."""
    for members in reversed(levels_up[:-1]):
        top = cut(descend(members.select("tree", "idx", "n", "node"), top, _lower(fanout), _PATH, levels, fanout))
    return top


def manifest(leaves: DataFrame, levels: int = LEVELS, fanout: int = FANOUT) -> DataFrame:
    """One row per leaf: id, leaf, subroot, root, proof_sha256, folded_root (from `tampered`, or the leaf where that is null, and the original
    siblings). leaves: id, source, leaf, tampered."""
    kind = leaves.schema["id"].dataType
    tree = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # in the order of sources, null first
    rows = cut(leaves.select(tree.alias("tree"), "id", F.col("leaf").alias("node"), F.when(F.col("tampered") != F.col("leaf"), F.col("tampered")).alias("tampered")))
    placed = cut(running_sums(rows, ["tree"], ["id", "node"], {"idx": F.lit(1)}, {"idx": "n"}))
    trees = rounds(placed, levels, fanout)
    if len(trees) == 1:
        trees.append(cut(placed.select("tree", "idx", "n", "node")))  # every source has one leaf at most
    subroots = running_sums(trees[-1].select(F.col("tree").alias("of"), "node"), [], ["of"], {"idx": F.lit(1)}, {"idx": "n"})
    top_nodes = cut(subroots.select(F.lit("").alias("tree"), "idx", "n", "node", "of"))
    top = rounds(top_nodes, levels, fanout)
    found = top[-1].first()
    root = found["node"] if found else None
    nothing = F.array().cast("array<string>")
    apex = top[-1].select("tree", "idx", F.lit("").alias("subroot"), nothing.alias("lefts"), nothing.alias("rights"))
    to_root = _paths(top, apex, levels, fanout)
    of_source = top_nodes.select(F.col("idx").alias("at"), "of", "node").join(to_root, F.col("at") == F.col("idx"))
    sources = of_source.select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("idx"), F.col("node").alias("subroot"), "lefts", "rights")
    above = _paths(trees[1:], sources, levels, fanout)

    def proofs(group: pd.DataFrame, own: list[list[str]], parent: pd.Series) -> pd.DataFrame:
        upper_lefts, upper_rights = list(parent["lefts"]), list(parent["rights"])
        upper = "".join(a + b for a, b in zip(upper_lefts, upper_rights))
        proof, folded = [], []
        for at, (node, other) in enumerate(zip(group["node"], group["tampered"])):
            lefts, rights = steps(own, at, fanout)
            proof.append(digest(*[a + b for a, b in zip(lefts, rights)], upper))
            folded.append(fold(other or node, [*lefts, *upper_lefts], [*rights, *upper_rights]))
        return pd.DataFrame({"id": group["id"], "leaf": group["node"], "subroot": parent["subroot"], "proof_sha256": proof, "folded_root": folded})

    last = placed.select("tree", "idx", "n", "node", "tampered", F.col("id").cast("string").alias("id"))  # pandas has no whole numbers beside nulls
    made = descend(last, above, proofs, "id string, leaf string, subroot string, proof_sha256 string, folded_root string", levels, fanout)
    return made.select(F.col("id").cast(kind).alias("id"), "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof_sha256", "folded_root")
