"""SimHash near-dedup.

Fingerprints are 64 majority bits over the XXH64 values of word shingles. Candidate pairs come from a
segment-popcount embedding: a fingerprint is cut into 32 segments of two bits, and each segment becomes its number of
set bits. The Manhattan distance of two such vectors never exceeds the Hamming distance of the fingerprints, so a range
join of the vectors at the same radius loses nothing, and survivors are verified exactly.

The vectors are kept in unary form (0 -> 00, 1 -> 01, 2 -> 11), which makes the Manhattan distance the bit count of an
XOR. The range join runs on sub-grids: the 32 coordinates form BLOCKS groups; vectors within distance d differ in at
most d groups, so they share a grid cell in at least one choice of BLOCKS - d groups. Every choice is one equi-join key. BLOCKS grows
with the counted number of fingerprints, so that a cell holds a bounded number of strangers.

Work stays linear in dense neighbourhoods. Equal fingerprints are one node. Fingerprints that agree outside `d` fixed bit
positions are mutually linked, so each such clique becomes a star, and joins only look for links between
different stars: within a grid cell the most frequent star is joined with the rest, never with itself.

Edge cases: a null or empty text (or one without words) has fingerprint zero and links like any other; repeated
rows stay repeated; a null id is kept and never chosen as a component id unless the component has no other;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellmill.llm.common import cut, slices
from cellmill.llm.graph import components

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 3
LOW_BITS = 0x5555555555555555
CHUNK = 1 << 15
CELL = 16
#: Chance that the popcounts of two unrelated two-bit segments are equal.
_SAME = 0.375


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The unsigned fingerprint of one whole text."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only \\x20 and \\x09-\\x0D separate
    if not words:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    if len(words) <= shingle_words:
        return digest(join(words), SEED)
    n = len(words) - shingle_words + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        end = min(n, at + CHUNK)
        runs = zip(*(words[at + k : end + k] for k in range(shingle_words)))
        hashes = np.fromiter((digest(join(run), SEED) for run in runs), np.uint64, end - at)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per row of docs: id_col and fp, the fingerprint as a signed long."""

    def run(batches):
        for batch in slices(batches):
            fps = np.array([fingerprint(t, shingle_words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=[id_col, "fp"])

    rows = docs.select(docs[id_col], docs[text_col])
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, fp bigint")


def unary_popcounts(fp: Column) -> Column:
    """Segment-popcount vector of 32 two-bit segments; each coordinate in unary in its segment's two bits."""
    upper = F.shiftrightunsigned(fp, 1)
    low = fp.bitwiseOR(upper).bitwiseAND(F.lit(LOW_BITS))
    high = fp.bitwiseAND(upper).bitwiseAND(F.lit(LOW_BITS))
    return low.bitwiseOR(F.shiftleft(high, 1))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def grid_blocks(nodes: int, max_bits: int = MAX_BITS) -> int:
    """The fewest coordinate groups at which a cell holds about CELL strangers or fewer."""
    kept = lambda blocks: (blocks - max_bits) * (32 // blocks)
    return next((b for b in range(max_bits + 1, 17) if nodes * _SAME ** kept(b) <= CELL), 16)


def grid_masks(max_bits: int, blocks: int) -> list[int]:
    """One mask per choice of blocks - max_bits coordinate groups; each covers whole segments."""
    edges = [round(32 * i / blocks) * 2 for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [signed(sum(c)) for c in combinations(masks, blocks - max_bits)]


def clique_masks(max_bits: int = MAX_BITS) -> list[int]:
    """Masks that clear max_bits neighbouring bits each; fingerprints equal under one are mutually linked."""
    full = (1 << 64) - 1
    return [signed(full ^ (((1 << max_bits) - 1) << at)) for at in range(0, 64 - max_bits + 1, max_bits)] if max_bits else []


def cell_keys(nodes: DataFrame, value: Column, masks: list[int], *keep: str) -> DataFrame:
    """A row for each mask: the cell that value falls in (hashed with the mask's number; a collision only adds candidates)."""
    cells = F.array(*[F.xxhash64(F.lit(i), value.bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])
    return nodes.select(F.explode(cells).alias("cell"), *keep)


def stars(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """fp, star: the smallest fingerprint of all cliques that fp is in (fp itself if it is alone); the two are linked."""
    keys = cell_keys(nodes, F.col("fp"), clique_masks(max_bits), "fp")
    least = keys.groupBy("cell").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).filter("a < top").drop("top")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("a"))) <= max_bits
    found = keys.join(least, "cell").filter((F.col("a") < F.col("fp")) & near).groupBy("fp").agg(F.min("a").alias("star"))
    return nodes.join(found, "fp", "left").select("fp", F.coalesce("star", "fp").alias("star"))


def cross_links(nodes: DataFrame, max_bits: int, blocks: int) -> DataFrame:
    """Links (a, b) between fingerprints of different stars. nodes: fp, star."""
    keys = cell_keys(nodes, unary_popcounts(F.col("fp")), grid_masks(max_bits, blocks), "fp", "star")
    mixed = cut(keys.groupBy("cell").agg(F.min("star").alias("s"), F.max("star").alias("t")).filter("s < t").select("cell"))
    kept = cut(keys.join(mixed, "cell"))
    per_star = kept.groupBy("cell", "star").agg(F.count(F.lit(1)).alias("n"))
    main = per_star.groupBy("cell").agg(F.max_by("star", F.struct("n", "star")).alias("main"))
    rest = cut(kept.join(main, "cell").filter("star <> main").select("cell", F.col("fp").alias("b"), F.col("star").alias("star_b")))
    manhattan = F.bit_count(unary_popcounts(F.col("fp")).bitwiseXOR(unary_popcounts(F.col("b")))) <= max_bits
    hamming = F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= max_bits
    pairs = kept.join(rest, "cell").filter((F.col("star") != F.col("star_b")) & manhattan & hamming)
    return pairs.select(F.least("fp", "b").alias("a"), F.greatest("fp", "b").alias("b")).distinct()


def fingerprint_components(nodes: DataFrame, max_bits: int = MAX_BITS, blocks: int | None = None) -> DataFrame:
    """fp and component (the smallest fp reachable) of distinct fingerprints; only those that have a link. The number of coordinate
    groups follows from the number of fingerprints unless it is given; links are the same with any."""
    starred = cut(stars(nodes, max_bits))
    blocks = blocks or grid_blocks(starred.count(), max_bits)
    links = cross_links(starred, max_bits, blocks).union(starred.filter("star <> fp").select(F.col("star").alias("a"), F.col("fp").alias("b")))
    return components(links).select(F.col("node").alias("fp"), "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, blocks: int | None = None) -> DataFrame:
    """One row per row of docs: id_col, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    prints = cut(fingerprints(docs, id_col, text_col, shingle_words).toDF("id", "fp"))
    least = cut(prints.groupBy("fp").agg(F.min("id").alias("least")))
    linked = fingerprint_components(least.select("fp"), max_bits, blocks)
    known = least.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = known.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = known.join(ids, "component").select("fp", "component_id")
    return prints.join(by_fp, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
