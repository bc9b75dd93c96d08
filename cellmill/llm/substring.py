"""Substring dedup over sliding sentence spans.

A text is cut after sentence ends and line ends; the sentences make up the text again, and only whole ones are ever removed. From
every sentence a run starts: the fewest consecutive sentences, at least MIN_SENTENCES, that hold MIN_WORDS words or more; a
sentence of LONG_WORDS words or more is as long as several, and a run by itself. Every run is hashed to 128 bits over
its words (lower case, white space ignored). A run that occurs more than once is a repeated span. Its first
occurrence by (document, sentence) stays; the sentences of all others go. Of a passage set into other text in the middle of sentences, those
that it shares with that text stay.

A document is an id with a text, so positions never cross texts: rows that share an id but not the text are documents each, in
the order of two 64-bit hashes of their texts; documents without an id come last. Equal rows are one document.

The hashes of all runs are counted in one shuffle of 64-bit values with map-side sums. A fixed-size bitmap of those that
repeat then lets a second pass emit only their occurrences, so positions and texts are shuffled for repeated passages alone; once
the bitmap fills up, a join takes its place.
Runs that start at neighbouring sentences form a passage; a passage is sent as one row, and passages of equal content
are judged once, by their first place. So a passage that a third of the documents share is reduced by partial minima before
the shuffle, and costs a row for each document rather than one for each run.

Edge cases: null and empty texts have no sentences and come back unchanged; an equal row (null ids included) is no repetition of
itself; within a document a later repetition goes too; an empty table gives an empty result; other columns are untouched.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmill.llm.bitmap import Bitmap, maybe_in
from cellmill.llm.common import cut, document, slices

MIN_SENTENCES = 2
MIN_WORDS = 13
LONG_WORDS = 25
#: Beyond this share of bits the bitmap filters too little, and runs are joined with the repeated hashes instead.
MAX_FILL = 0.25
_END = re.compile(r"(?<=[.!?]\s)|(?<=\n)|(?<=[。！？])")


def sentences(text: str | None) -> list[str]:
    """The sentences of a text; joined, they are the text."""
    return [s for s in _END.split(text) if s] if text else []


def runs(text: str | None, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> tuple[list[int], list[int], list[bytes]]:
    """First sentence, sentence after the last, and 128-bit digest of each run."""
    words = [s.lower().split() for s in sentences(text)]
    until = np.cumsum([0, *map(len, words)])
    n = len(words)
    first = np.arange(n)
    after = np.maximum(np.searchsorted(until, until[:-1] + min_words), first + min_sentences)
    after[np.diff(until) >= max(LONG_WORDS, min_words)] = first[np.diff(until) >= max(LONG_WORDS, min_words)] + 1
    joined, digest = [" ".join(w) for w in words], xxhash.xxh3_128_digest
    whole = [(i, j) for i, j in zip(first.tolist(), after.tolist()) if j <= n and words[i]]
    return [i for i, _ in whole], [j for _, j in whole], [digest(" ".join(joined[i:j])) for i, j in whole]


def _halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)


_RUN = pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("offset", pa.int32()), ("size", pa.int32())])


class _Passages:
    """Collects passages: runs of a document that start at neighbouring sentences, with the digest of their contents."""

    names = ["id", "start", "c1", "c2", "runs"]

    def __init__(self):
        self.row, self.start, self.digest, self.ends, self.parts = [], [], [], [0], [np.zeros((0, 4), np.int64)]

    def add(self, row: int, first: np.ndarray, size: np.ndarray, half: np.ndarray) -> None:
        for these in np.split(np.arange(len(first)), np.flatnonzero(np.diff(first) != 1) + 1):
            passage = np.column_stack([half[these], first[these] - first[these[0]], size[these]])
            self.row.append(row)
            self.start.append(int(first[these[0]]))
            self.digest.append(xxhash.xxh3_128_digest(np.ascontiguousarray(passage).tobytes()))
            self.ends.append(self.ends[-1] + len(passage))
            self.parts.append(passage)

    def batch(self, ids: pa.Array) -> pa.RecordBatch:
        fields, half = np.concatenate(self.parts), _halves(self.digest)
        columns = [pa.array(fields[:, k] if k < 2 else fields[:, k].astype(np.int32)) for k in range(4)]
        runs = pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_RUN)))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(self.row, pa.int32())), pa.array(self.start, pa.int32()), pa.array(half[:, 0]), pa.array(half[:, 1]), runs], names=self.names)


def _passage_schema(docs: DataFrame) -> str:
    return f"id {docs.schema['id'].dataType.simpleString()}, start int, c1 bigint, c2 bigint, runs array<struct<h1:bigint,h2:bigint,offset:int,size:int>>"


def _passages(docs: DataFrame, min_sentences: int, min_words: int, repeated: Bitmap) -> DataFrame:
    """id, start, c1, c2, runs: the passages of documents (id, text) whose runs may all repeat, by the bitmap. c1 and c2 are the
    digest of a passage's runs, each with its hash, offset from start and number of sentences."""
    shared = docs.sparkSession.sparkContext.broadcast(repeated.words)

    def run(batches):
        known = Bitmap(shared.value)
        for batch in slices(batches):
            out = _Passages()
            for row, text in enumerate(batch.column(1).to_pylist()):
                first, after, digests = runs(text, min_sentences, min_words)
                half = _halves(digests)
                hits = np.flatnonzero(known.has(half[:, 0]))
                if len(hits):
                    begin = np.array(first, np.int64)[hits]
                    out.add(row, begin, np.array(after, np.int64)[hits] - begin, half[hits])
            yield out.batch(batch.column(0))

    return docs.mapInArrow(run, _passage_schema(docs))


def _passages_by_join(docs: DataFrame, min_sentences: int, min_words: int, repeated: DataFrame) -> DataFrame:
    """The same by a join of all runs with the repeated hashes, for corpora whose repeated hashes fill the bitmap."""

    def every(batches):
        for batch in slices(batches):
            row, firsts, sizes, digests = [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                first, after, found = runs(text, min_sentences, min_words)
                row += [k] * len(first)
                firsts += first
                sizes += [b - a for a, b in zip(first, after)]
                digests += found
            half = _halves(digests)
            columns = [batch.column(0).take(pa.array(row, pa.int32())), pa.array(firsts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(half[:, 0]), pa.array(half[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "first", "size", "h1", "h2"])

    def split(batches):
        for batch in slices(batches):
            out = _Passages()
            for row, hits in enumerate(batch.column(1)):
                fields = np.column_stack([hits.values.field(k).to_numpy().astype(np.int64) for k in range(4)])
                out.add(row, fields[:, 0], fields[:, 1], fields[:, 2:])
            yield out.batch(batch.column(0))

    kind = docs.schema["id"].dataType.simpleString()
    hits = docs.mapInArrow(every, f"id {kind}, first int, size int, h1 bigint, h2 bigint").join(repeated, "h1", "left_semi")
    grouped = hits.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("first", "size", "h1", "h2"))).alias("hits"))
    return grouped.mapInArrow(split, _passage_schema(docs))


def _hashes(docs: DataFrame, min_sentences: int, min_words: int) -> DataFrame:
    """h1 of each document's different runs, twice if the document repeats the run itself."""

    def run(batches):
        for batch in slices(batches):
            digests: list[bytes] = []
            for text in batch.column(0).to_pylist():
                times = Counter(runs(text, min_sentences, min_words)[2])
                digests += times
                if len(times) < times.total():
                    digests += [d for d, n in times.items() if n > 1]
            yield pa.RecordBatch.from_arrays([pa.array(_halves(digests)[:, 0])], names=["h1"])

    return docs.select("text").mapInArrow(run, "h1 bigint")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document that loses sentences: id (a struct, see document), gone (array of [first, after) structs), sources (ids
    of the documents that keep the passage)."""
    own = docs.select(document(docs[id_col], docs[text_col]).alias("id"), docs[text_col].alias("text"))

    counts = cut(_hashes(own, min_sentences, min_words).groupBy("h1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1"))
    bitmap = Bitmap.of(counts, F.col("h1"))
    sparse = bitmap.fill() <= MAX_FILL
    found = cut(_passages(own, min_sentences, min_words, bitmap) if sparse else _passages_by_join(own, min_sentences, min_words, counts))
    contents = found.groupBy("c1", "c2").agg(F.min(F.struct("id", "start")).alias("least"), F.any_value("runs").alias("runs"))
    each = cut(contents.select("c1", "c2", "least", F.explode("runs").alias("r")).select("c1", "c2", F.struct("least.id", (F.col("least.start") + F.col("r.offset")).alias("at")).alias("place"), "r.*"))
    kept = cut(each.groupBy("h1", "h2").agg(F.min("place").alias("kept")))
    judged = each.join(kept, ["h1", "h2"]).groupBy("c1", "c2").agg(F.collect_list(F.struct("offset", "size", "kept")).alias("runs"))
    placed = found.select("id", "start", "c1", "c2").join(cut(judged), ["c1", "c2"])
    later = F.filter("runs", lambda r: ~(r["kept"]["id"].eqNullSafe(F.col("id")) & (r["kept"]["at"] == F.col("start") + r["offset"])))
    spans = F.transform("later", lambda r: F.struct((F.col("start") + r["offset"]).alias("first"), (F.col("start") + r["offset"] + r["size"]).alias("after")))
    gone = placed.withColumn("later", later).filter(F.size("later") > 0).select("id", spans.alias("gone"), F.array_distinct(F.transform("later", lambda r: r["kept"]["id"]["id"])).alias("sources"))
    flat = lambda c: F.flatten(F.collect_set(c))
    return gone.groupBy("id").agg(F.sort_array(flat("gone")).alias("gone"), F.sort_array(F.array_distinct(flat("sources"))).alias("sources"))


def _without(text: str | None, gone: list[dict]) -> tuple[str, int, int]:
    parts = sentences(text)
    drop = np.zeros(len(parts) + 1, np.int64)
    for g in gone:
        drop[g["first"]] += 1
        drop[min(g["after"], len(parts))] -= 1
    inside = np.cumsum(drop)[:-1] > 0
    return "".join(p for p, d in zip(parts, inside) if not d), len(parts), int(inside.sum())


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """The changed rows and the untouched ones. The changed ones are two structs: `doc`, the row as it was, and
    `repeats`: text (what is left), sentences, removed (numbers of sentences), sources (ids that keep the passages)."""
    spans = cut(repeated_spans(docs, id_col, text_col, min_sentences, min_words))
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), document(docs[id_col], docs[text_col]).alias("of"))
    maybe, never = maybe_in(packed, F.xxhash64("of"), Bitmap.of(spans, F.xxhash64("id")))

    @F.arrow_udf("text string, sentences int, removed int")
    def rest(texts: pa.Array, gone: pa.Array) -> pa.Array:
        left = [_without(t.as_py(), g.as_py()) for t, g in zip(texts, gone)]
        kinds = (pa.string(), pa.int32(), pa.int32())
        return pa.StructArray.from_arrays([pa.array([x[k] for x in left], kind) for k, kind in enumerate(kinds)], names=["text", "sentences", "removed"])

    joined = maybe.join(spans, F.col("of").eqNullSafe(F.col("id")), "left")
    left = joined.filter("gone IS NOT NULL").withColumn("rest", rest(F.col(f"doc.`{text_col}`"), F.col("gone")))
    changed = left.select("doc", F.struct("rest.text", "rest.sentences", "rest.removed", "sources").alias("repeats"))
    return changed, never.select("doc.*").unionByName(joined.filter("gone IS NULL").select("doc.*"))
