"""Benchmark decontamination by spaced-seed hashing.

Texts become lower-case word tokens. Fixed masks pick positions out of a short window of tokens; the others may differ. The
hash of the picked tokens is a seed. Seeds of the test items are joined with those of the documents; a common seed puts an
item and a document on one diagonal. There the overlap is verified token by token: the longest stretch whose share of
equal tokens is SIMILARITY or more, and which has MIN_TOKENS tokens or that share of the item, if that is shorter, is a leak.

Masks follow from an item's length, so that no such stretch escapes where it is short: items of 16 tokens and more have masks
of five tokens, which find every stretch of 13 to 21 tokens with a fifth substituted; shorter items have masks of four, which find every stretch of 5
to 14; items of four tokens or fewer match as a whole only. Only masks that some item needs are hashed.

A seed that many items share, such as a common way to open a question, would pair all of them with every document that has it. Seeds with more than
HOT_PLACES places among the items are met in blocks of documents and items instead, each with the CONTEXT tokens around the seed, and only
pairs with as many equal tokens there as a leak must have go on; so no rows are made for the others.

Documents send only seeds that a fixed-size bitmap of the test seeds lets pass, and only documents with a candidate are
read again for verification, with ITEMS_AT_ONCE of their items at a time, so the corpus itself is not shuffled, and a document that quotes all
items is several rows.

Edge cases: null and empty texts have no tokens and leak nothing; leaks() and clean() judge alike: a whole item of one to four tokens
is a leak wherever a text has it, so a one-word item condemns every text with that word; `min_item` leaves items of fewer tokens out; rows are documents by id and text, so rows that share an id (null included) are judged each
by its own text, and equal rows once; the best of several overlaps of one item and document is reported, ties to the first; empty
tables give empty results; other columns are untouched.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellmill.llm.bitmap import Bitmap, maybe_in
from cellmill.llm.common import cut, document, slices, word_hash

#: Five tokens each, for items of LONG_ITEM tokens and more; the first needs them in a row.
MASKS = ("11111", "1101101", "110010101", "10101011")
#: Four tokens each, for shorter items.
SHORT_MASKS = ("1111", "11011", "10111", "11101")
LONG_ITEM = 16
#: Items up to this length match as a whole.
WHOLE = 4
MIN_TOKENS = 13
MIN_ITEM = 1
SIMILARITY = 0.8
#: Places among the items beyond which a seed is met in blocks of at most PART documents' and PART items' places.
HOT_PLACES, PART = 16, 4096
#: Tokens on either side of a seed's first: a stretch of 21 tokens that holds the seed lies within.
CONTEXT = 21
ITEMS_AT_ONCE = 64
#: Rows of counts that may be broadcast.
BROADCAST_SEEDS = 100_000
_WORD = re.compile(r"\w+").findall
_MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text."""
    words = _WORD(text.lower()) if text else []
    return np.fromiter(map(word_hash, words), np.uint64, len(words))


def masks_for(n: int) -> tuple[str, ...]:
    """The masks of an item of n tokens."""
    return MASKS if n >= LONG_ITEM else SHORT_MASKS if n > WHOLE else ("1" * n,) if n else ()


def seeds(rows: list[np.ndarray], masks: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seed hash, row and position of every window of every mask; of masks for whole items only a row's first place of each seed."""
    nothing = (np.zeros(0, np.int64),) * 3
    sizes = np.array([len(r) for r in rows], np.int64)
    if not sizes.sum():
        return nothing
    all_tokens = np.concatenate(rows)
    row = np.repeat(np.arange(len(rows)), sizes)
    start = np.cumsum(sizes) - sizes
    at = np.arange(len(all_tokens)) - start[row]
    room = sizes[row] - at
    found = []
    for mask in masks:
        n = len(all_tokens) - len(mask) + 1
        if n <= 0:
            continue
        h = np.full(n, int(mask, 2), np.uint64)
        for offset, bit in enumerate(mask):
            if bit == "1":
                h ^= all_tokens[offset : offset + n]
                h *= _MIX
                h ^= h >> np.uint64(29)
        fits = room[:n] >= len(mask)
        here = h[fits].view(np.int64), row[:n][fits], at[:n][fits]
        if len(mask) <= WHOLE and mask not in SHORT_MASKS:
            _, first = np.unique(np.stack(here[:2]), axis=1, return_index=True)
            here = tuple(x[first] for x in here)
        found.append(here)
    return tuple(np.concatenate(x) for x in zip(*found)) if found else nothing


def contexts(rows: list[np.ndarray], row: np.ndarray, at: np.ndarray) -> pa.Array:
    """The CONTEXT tokens before and after each place and the one there, as bytes; 0 beyond a row's ends."""
    edge = np.zeros(CONTEXT, np.uint64)
    padded = {k: np.concatenate([edge, rows[k], edge]) for k in np.unique(row).tolist()}
    return pa.array([padded[k][p : p + 2 * CONTEXT + 1].tobytes() for k, p in zip(row.tolist(), at.tolist())], pa.binary())


def _item_seeds(items: DataFrame, min_item: int, hot: Bitmap | None = None) -> DataFrame:
    """items: id, text. Returns seed, id, at, the number of the item's tokens and, with hot, the context of the seeds in it alone."""
    shared = items.sparkSession.sparkContext.broadcast(hot.words) if hot else None

    def run(batches):
        for batch in slices(batches):
            rows = [tokens(t) for t in batch.column(1).to_pylist()]
            for masks in {masks_for(len(r)) for r in rows}:
                kept = np.array([k for k, r in enumerate(rows) if masks_for(len(r)) == masks and len(r) >= min_item], np.int64)
                hashed, row, at = seeds([rows[k] for k in kept], masks)
                if shared:
                    some = Bitmap(shared.value).has(hashed)
                    hashed, row, at = hashed[some], row[some], at[some]
                size = np.array([len(rows[k]) for k in kept], np.int32)
                context = contexts([rows[k] for k in kept], row, at) if shared else pa.nulls(len(row), pa.binary())
                columns = [pa.array(hashed), batch.column(0).take(pa.array(kept[row])), pa.array(at.astype(np.int32)), pa.array(size[row]), context]
                yield pa.RecordBatch.from_arrays(columns, names=["seed", "id", "at", "size", "context"])

    return items.mapInArrow(run, f"seed bigint, id {items.schema['id'].dataType.simpleString()}, at int, size int, context binary")


def _doc_seeds(docs: DataFrame, allowed: Bitmap, hot: Bitmap, masks: tuple[str, ...]) -> DataFrame:
    """docs: id, text. Returns seed, id, at of seeds that may be an item's, and the context of those that may be hot."""
    shared = docs.sparkSession.sparkContext.broadcast((allowed.words, hot.words if hot.fill() else None))

    def run(batches):
        known, crowded = shared.value
        for batch in slices(batches):
            rows = [tokens(t) for t in batch.column(1).to_pylist()]
            hashed, row, at = seeds(rows, masks)
            hit = Bitmap(known).has(hashed)
            hashed, row, at = hashed[hit], row[hit], at[hit]
            context = pa.nulls(len(row), pa.binary())
            if crowded is not None and (some := Bitmap(crowded).has(hashed)).any():
                order = np.argsort(~some, kind="stable")  # those with a context first
                hashed, row, at, n = hashed[order], row[order], at[order], int(some.sum())
                context = pa.concat_arrays([contexts(rows, row[:n], at[:n]), context[n:]])
            columns = [pa.array(hashed), batch.column(0).take(pa.array(row)), pa.array(at.astype(np.int32)), context]
            yield pa.RecordBatch.from_arrays(columns, names=["seed", "id", "at", "context"])

    return docs.mapInArrow(run, f"seed bigint, id {docs.schema['id'].dataType.simpleString()}, at int, context binary")


def needed(size: np.ndarray | int, min_tokens: int = MIN_TOKENS, similarity: float = SIMILARITY) -> np.ndarray:
    """Tokens that an overlap with an item of that size must have."""
    return np.minimum(min_tokens, np.ceil(similarity * size - 1e-9)).astype(np.int64)


def _crowded_lines(hits: DataFrame, places: DataFrame, min_tokens: int, similarity: float) -> DataFrame:
    """id, item, shift of hot seeds' pairs that have equal tokens enough in their contexts. hits: seed, id, at, context; places: the same of
    items, with item and size."""
    of_docs = hits.groupBy("seed").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    of_items = places.groupBy("seed").agg(F.ceil(F.count(F.lit(1)) / PART).alias("item_parts"))
    counts = cut(of_docs.join(of_items, "seed"))
    if counts.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS:
        counts = F.broadcast(counts)
    number = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    mine = lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n))
    left = hits.join(counts, "seed").select("seed", mine("parts", "id", "at").alias("part"), number("item_parts").alias("item_part"), "id", "at", "context")
    right = places.join(counts, "seed").select("seed", number("parts").alias("part"), mine("item_parts", "item", "at").alias("item_part"), "item", "at", "size", "context")
    block, at_once = ["seed", "part", "item_part"], 1 << 22

    def met(docs: pa.Table, items: pa.Table) -> pa.Table:
        matrix = lambda t: np.frombuffer(b"".join(t.column("context").to_pylist()), np.uint64).reshape(t.num_rows, 2 * CONTEXT + 1)
        a, b = matrix(docs), matrix(items)
        least = np.ceil(similarity * needed(items.column("size").to_numpy(), min_tokens, similarity) - 1e-9)
        found = [(np.zeros(0, np.int64),) * 2]
        step = max(1, at_once // max(1, b.size))
        for at in range(0, len(a), step):
            equal = ((a[at : at + step, None, :] == b[None, :, :]) & (b[None, :, :] != 0)).sum(axis=2)
            u, v = np.nonzero(equal >= least[None, :])
            found.append((u + at, v))
        u, v = (pa.array(np.concatenate(x)) for x in zip(*found))
        shift = docs.column("at").take(u).to_numpy() - items.column("at").take(v).to_numpy()
        return pa.Table.from_arrays([docs.column("id").take(u), items.column("item").take(v), pa.array(shift, pa.int32())], names=["id", "item", "shift"])

    kinds = f"id {hits.schema['id'].dataType.simpleString()}, item {places.schema['item'].dataType.simpleString()}, shift int"
    return left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(met, kinds)


def candidates(own: DataFrame, test: DataFrame, min_tokens: int = MIN_TOKENS, similarity: float = SIMILARITY, min_item: int = MIN_ITEM) -> DataFrame:
    """Different diagonals that a common seed names: id, item, shift. own and test: id, text."""
    item_seeds = cut(_item_seeds(test, min_item).drop("context"))
    sizes = [r["size"] for r in item_seeds.select(F.least("size", F.lit(LONG_ITEM)).alias("size")).distinct().collect()]  # at most LONG_ITEM numbers
    masks = tuple(sorted({m for n in sizes for m in masks_for(n)}))
    crowded = cut(item_seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_PLACES).select("seed"))
    hot = Bitmap.of(crowded, F.col("seed"))
    hits = cut(_doc_seeds(own, Bitmap.of(item_seeds, F.col("seed")), hot, masks))
    rare = item_seeds.join(crowded, "seed", "left_anti").select("seed", F.col("id").alias("item"), F.col("at").alias("item_at"))
    lines = hits.select("seed", "id", "at").join(rare, "seed").select("id", "item", (F.col("at") - F.col("item_at")).alias("shift"))
    if hot.fill():
        places = cut(_item_seeds(test, min_item, hot).withColumnRenamed("id", "item").join(crowded, "seed", "left_semi"))
        lines = lines.unionByName(_crowded_lines(cut(hits.filter("context IS NOT NULL").join(crowded, "seed", "left_semi")), places, min_tokens, similarity))
    return lines.distinct()


def longest_overlap(equal: np.ndarray, similarity: float = SIMILARITY) -> tuple[int, int]:
    """First and last + 1 of the longest stretch with that share of True, from one True to another; (0, 0) if none."""
    if not equal.any():
        return 0, 0
    score = np.concatenate(([0.0], np.cumsum(np.where(equal, 1 - similarity, -similarity))))
    lowest = np.minimum.accumulate(np.where(equal, score[:-1], np.inf))  # falling: the first start with a score of x or less is found by bisection
    begin = np.searchsorted(-lowest, -(score[1:] + 1e-9), side="left")
    length = np.where(equal, np.arange(1, len(equal) + 1) - begin, 0)
    end = int(np.argmax(length)) + 1
    return end - int(length[end - 1]), end


def verify(doc: np.ndarray, item: np.ndarray, shift: int, min_tokens: int = MIN_TOKENS, similarity: float = SIMILARITY) -> tuple[int, int, int] | None:
    """Start in the document, tokens and equal tokens of the overlap on a diagonal, if it is a leak."""
    a, b = max(0, shift), min(len(doc), shift + len(item))
    if b <= a:
        return None
    equal = doc[a:b] == item[a - shift : b - shift]
    begin, end = longest_overlap(equal, similarity)
    if end - begin < needed(len(item), min_tokens, similarity):
        return None
    return a + begin, end - begin, int(equal[begin:end].sum())


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", min_tokens: int = MIN_TOKENS, similarity: float = SIMILARITY, min_item: int = MIN_ITEM) -> DataFrame:
    """One row per leaked item and document: document (see common.document), id, item, start, n_tokens, n_equal (in tokens of the document)."""
    test = items.select(items[item_id_col].alias("id"), items[item_text_col].alias("text")).filter("text IS NOT NULL").distinct()
    own = docs.select(document(docs[id_col], docs[text_col]).alias("id"), docs[text_col].alias("text"))
    lines = candidates(own, test, min_tokens, similarity, min_item)
    texts = test.select(F.col("id").alias("item_id"), F.col("text").alias("item_text"))
    by_item = lines.groupBy("id", "item").agg(F.collect_set("shift").alias("shifts"))
    block = F.floor((F.row_number().over(Window.partitionBy("id").orderBy("item")) - 1) / ITEMS_AT_ONCE).alias("block")
    listed = by_item.select("*", block).join(texts, F.col("item").eqNullSafe(F.col("item_id")))
    with_items = cut(listed.groupBy("id", "block").agg(F.collect_list(F.struct("item", "item_text", "shifts")).alias("items")))
    maybe, _ = maybe_in(own, F.xxhash64("id"), Bitmap.of(with_items, F.xxhash64("id")))
    pairs = maybe.select(F.col("id").alias("doc"), "text").join(with_items, F.col("doc").eqNullSafe(F.col("id"))).dropDuplicates(["id", "block"])
    overlap = pa.struct([("place", pa.int32()), ("start", pa.int32()), ("n_tokens", pa.int32()), ("n_equal", pa.int32())])

    @F.arrow_udf("array<struct<place:int,start:int,n_tokens:int,n_equal:int>>")
    def check(doc_texts: pa.Array, item_lists: pa.Array) -> pa.Array:
        out = []
        for text, found in zip(doc_texts, item_lists):
            doc, best = tokens(text.as_py()), []
            for place, one in enumerate(found.as_py()):
                item = tokens(one["item_text"])
                spans = [v for s in one["shifts"] if (v := verify(doc, item, s, min_tokens, similarity))]
                if spans:
                    start, n, equal = max(spans, key=lambda v: (v[2], -v[1], -v[0]))
                    best.append({"place": place, "start": start, "n_tokens": n, "n_equal": equal})
            out.append(best)
        return pa.array(out, pa.list_(overlap))

    found = pairs.select("id", "items", F.explode(check("text", "items")).alias("o"))
    each = found.select("id", F.get("items", F.col("o.place"))["item"].alias("item"), "o.start", "o.n_tokens", "o.n_equal")
    best = F.max_by(F.struct("start", "n_tokens", "n_equal"), F.struct(F.col("n_equal"), -F.col("n_tokens"), -F.col("start")))
    several = each.groupBy("id", "item").agg(best.alias("o"))  # items of one id and different texts
    return several.select(F.col("id").alias("document"), F.col("id.id").alias("id"), "item", "o.*")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", min_tokens: int = MIN_TOKENS, similarity: float = SIMILARITY, min_item: int = MIN_ITEM) -> DataFrame:
    """The rows of docs, with all their columns, whose texts hold no item."""
    found = leaks(docs, items, id_col, text_col, item_id_col, item_text_col, min_tokens, similarity, min_item)
    bad = cut(found.select(F.col("document").alias("leaked")).distinct())
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), document(docs[id_col], docs[text_col]).alias("of"))
    maybe, never = maybe_in(packed, F.xxhash64("of"), Bitmap.of(bad, F.xxhash64("leaked")))
    return never.select("row.*").unionByName(maybe.join(bad, F.col("of").eqNullSafe(F.col("leaked")), "left_anti").select("row.*"))
