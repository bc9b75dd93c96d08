"""Language-model scoring by cross-entropy difference.

Two bigram models of the same order, smoothing and vocabulary are counted, one on target texts, one on background texts. A text's
score is the mean over its tokens of the target model's loss minus the background model's (in nats), so the lower the score, the
more the text is like the target.

The shared vocabulary is every word of both corpora, the end of a text being a word too, and one place for words of neither.
Counts cover all texts, whole. A bigram's probability is the mixture
    p(w | v) = (n(v, w) + STRENGTH * p(w)) / (n(v) + STRENGTH),   p(w) = (n(w) + 1) / (N + V)
with N tokens and V words. Callers may ask for the `size` - 2 most frequent words alone; all others then share a place.

Counts are never in one place. A text begins and ends with the end, so its words as first and as second words of bigrams are the
same, and n(v) counts both ways: the loss of a text is the sum over its bigrams of
    log(n(w) + STRENGTH) - log(n(v, w) + STRENGTH * p(w))
which needs counts of (v, w) and w alone. Bigrams go to buckets by w, where both can be counted, and sums by text come back. Words and
bigrams that make up more than a HOT-th of all tokens (fewer than HOT each) are counted before: bigrams of such a word are dealt by both
words, and bigrams of two such words are scored on the spot. Less frequent words whose bigrams would overfill a bucket are dealt by both words too, down
to a HEAVY-th of all tokens. This only spreads the work; no result depends on HOT or HEAVY. Words are known by their 64-bit XXH64.

Edge cases: null and empty texts have the end token alone and are scored by it; with a size, ties at the vocabulary's edge go by the
word; repeated rows count and are scored each; empty corpora give uniform models; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmill.llm.common import cut, slices

STRENGTH = 64.0
OTHER, END = 0, 1
HOT = 1 << 14
#: Tokens of a bucket, and of a block of texts that is packed at once.
BUCKET_TOKENS = 1 << 17
BLOCK_TOKENS = 1 << 19
FLUSH_WORDS = 1 << 18
#: Tasks that go through the buckets, sorted, one bucket in memory at a time: TASKS at least, and one for every TASK_TOKENS. A text gets at most one
#: sum from each.
TASKS, TASK_TOKENS = 32, 1 << 26
#: Words with more than a HEAVY-th of all tokens (fewer than HEAVY; a sorted array of three numbers each is broadcast) are dealt by both words where
#: their bigrams would be more than a bucket's.
HEAVY = 1 << 20
#: A row's number is its block's and, in the low bits, its place in it.
PLACE_BITS = 16


def words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def _word_counts(texts: DataFrame) -> DataFrame:
    """word, n: partial counts."""

    def run(batches):
        counts: dict[bytes, int] = {}

        def flushed():
            keys = list(counts)
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([counts[k] for k in keys], pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                for word in words(text):
                    counts[word] = counts.get(word, 0) + 1
            if len(counts) > FLUSH_WORDS:
                yield flushed()
        yield flushed()

    return texts.mapInArrow(run, "word binary, n bigint")


def vocabulary(*corpora: DataFrame, size: int) -> set[bytes]:
    """The size - 2 most frequent words of all corpora (tables of one text column)."""
    counts = _word_counts(corpora[0])
    for more in corpora[1:]:
        counts = counts.union(_word_counts(more))
    top = counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size - 2)
    return {bytes(r.word) for r in top.collect()}


class _Keys(dict):
    """64-bit keys of words; a process remembers WORDS of them."""

    WORDS = 1 << 17

    def __init__(self, known: set[bytes] | None):
        self.known = known

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.WORDS:
            self.clear()
        out = self[word] = OTHER if self.known is not None and word not in self.known else xxhash.xxh64_intdigest(word)
        return out

    def blocks(self, batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
        """Blocks of rows: their batches, the tokens of each text (the end included), and the keys of all tokens in order."""
        rows, sizes, keys, n = [], [], [], 0
        for batch in slices(batches):
            rows.append(batch)
            for text in batch.column(column).to_pylist():
                found = words(text)
                one = np.empty(len(found) + 1, np.uint64)
                one[:-1] = np.fromiter(map(self.__getitem__, found), np.uint64, len(found))
                one[-1] = END
                keys.append(one)
                sizes.append(len(one))
                n += len(one)
            if n > BLOCK_TOKENS or len(sizes) > (1 << PLACE_BITS) - 512:
                yield rows, np.array(sizes), np.concatenate(keys)
                rows, sizes, keys, n = [], [], [], 0
        if sizes:
            yield rows, np.array(sizes), np.concatenate(keys)


def before(sizes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The first word of the bigram that each token ends."""
    out = np.empty_like(keys)
    out[1:] = keys[:-1]
    out[np.cumsum(sizes) - sizes] = END
    return out


def find(sought: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Positions in a sorted array; -1 where it lacks the value."""
    if not len(among):
        return np.full(len(sought), -1)
    at = np.minimum(np.searchsorted(among, sought), len(among) - 1)
    return np.where(among[at] == sought, at, -1)


def _counted(texts: DataFrame, known, is_target: bool, hot: np.ndarray | None = None) -> DataFrame:
    """key, near, far: partial counts of words, or with hot (sorted keys) of bigrams of two such words, as first * len(hot) + second."""
    shared = texts.sparkSession.sparkContext.broadcast((known, hot))

    def run(batches):
        kept, hot = shared.value
        for _, sizes, keys in _Keys(kept).blocks(batches, 0):
            if hot is not None:
                second = find(keys, hot)
                first = find(before(sizes, keys), hot)
                keys = (first * len(hot) + second)[(first >= 0) & (second >= 0)]
            key, n = np.unique(keys, return_counts=True)
            none = np.zeros(len(key), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n if is_target else none), pa.array(none if is_target else n)], names=["key", "near", "far"])

    return texts.mapInArrow(run, "key bigint, near bigint, far bigint")


def _frequent(counts: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys with more than `least` tokens, sorted, and their counts (near, far)."""
    got = counts.filter(F.col("near") + F.col("far") > least).toArrow()
    keys = got.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.stack([got.column(c).to_numpy()[order] for c in ("near", "far")]).astype(np.float64)


def losses(pair: np.ndarray, word: np.ndarray, totals: np.ndarray, size: int, strength: float) -> np.ndarray:
    """Losses in nats by both models, from counts (near, far) of bigrams and of their second words."""
    share = strength * (word + 1) / (totals[:, None] + size)
    return np.log(word + strength) - np.log(pair + share)


def _mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (first ^ (second * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(20)


PACKED = "bucket int, target boolean, block bigint, second binary, runs binary, first binary, places binary"


def _packed(texts: DataFrame, shared, is_target: bool) -> DataFrame:
    """The bigrams of a corpus for the buckets, block by block. texts: the id, and the text last. Texts to score also give a row each
    with the id, the number of tokens, and the losses of bigrams that are hot."""
    kind = texts.schema[0].dataType.simpleString()

    def run(batches):
        kept, hot, hot_counts, pairs, pair_counts, totals, size, strength, buckets, heavy, _ = shared.value
        task, id_type = TaskContext.get().partitionId(), None
        for number, (rows, sizes, second) in enumerate(_Keys(kept).blocks(batches, 1)):
            id_type = rows[0].column(0).type
            block = (task << 24 | number) << PLACE_BITS
            first, places = before(sizes, second), np.repeat(np.arange(len(sizes)), sizes)
            a, b = find(first, hot), find(second, hot)
            both = (a >= 0) & (b >= 0)
            at = np.full(len(second), -1)
            at[both] = find((a[both] * len(hot) + b[both]).view(np.uint64), pairs)
            done = at >= 0
            if not is_target:
                sums = losses(pair_counts[:, at[done]], hot_counts[:, b[done]], totals, size, strength)
                near, far = (np.bincount(places[done], s, len(sizes)) for s in sums)
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((np.arange(n) + number) % buckets, pa.int32()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.int64()), *[pa.nulls(n, pa.binary())] * 4,
                     pa.array(block + np.arange(n)), pa.concat_arrays([r.column(0) for r in rows]), pa.array(sizes), pa.array(near, pa.float64()), pa.array(far, pa.float64())],
                    names=NAMES,
                )
            left = ~done
            first, second, places, a = first[left], second[left], places[left], a[left]
            spread = find(second, heavy) >= 0  # hot ones are among them
            bucket = (np.where(spread, _mixed(first, second), _mixed(np.uint64(0), second)) % np.uint64(buckets)).astype(np.int64)
            bucket = bucket * 2 + (a >= 0)  # those with a hot first word by themselves: its position is enough
            order = np.lexsort((second, bucket))
            first, second, places, a, bucket = first[order], second[order], places[order].astype(np.uint16), a[order].astype(np.uint16), bucket[order]
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, np.int64)
            new = np.r_[True, (second[1:] != second[:-1]) | (bucket[1:] != bucket[:-1])] if len(bucket) else np.empty(0, bool)
            out = []
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)]):
                heads = np.flatnonzero(new[s:e])
                out.append((second[s:e][heads].tobytes(), np.diff(heads, append=e - s).astype(np.uint32).tobytes(), (a if bucket[s] & 1 else first)[s:e].tobytes(), places[s:e].tobytes()))
            for k in range(0, len(out), 256):
                part, n = out[k : k + 256], len(out[k : k + 256])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[starts[k : k + 256]] >> 1, pa.int32()), pa.array([is_target] * n), pa.array([block] * n, pa.int64()), *[pa.array(c, pa.binary()) for c in zip(*part)],
                     pa.nulls(n, pa.int64()), pa.nulls(n, id_type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64())],
                    names=NAMES,
                )

    return texts.mapInArrow(run, f"{PACKED}, row bigint, id {kind}, n_tokens bigint, near double, far double")


NAMES = ["bucket", "target", "block", "second", "runs", "first", "places", "row", "id", "n_tokens", "near", "far"]


class _Sums:
    """Losses by row, added up while a task goes through its buckets."""

    def __init__(self, limit: int = 1 << 20):
        self.limit, self.n, self.parts = limit, 0, []

    def add(self, rows: np.ndarray, sums: np.ndarray) -> None:
        self.parts.append((rows, sums))
        self.n += len(rows)
        if self.n > 2 * self.limit:
            self.fold()

    def full(self) -> bool:
        """Whether more than the limit are left when all are folded."""
        return len(self.parts) == 1 and self.n > self.limit

    def fold(self) -> None:
        if self.parts:
            rows, at = np.unique(np.concatenate([r for r, _ in self.parts]), return_inverse=True)
            sums = np.concatenate([s for _, s in self.parts], axis=1)
            self.parts, self.n = [(rows, np.stack([np.bincount(at, s, len(rows)) for s in sums]))], len(rows)

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        self.fold()
        out = self.parts[0] if self.parts else (np.empty(0, np.int64), np.empty((2, 0)))
        self.parts, self.n = [], 0
        return out


def _scored(bucket: list[tuple], hot: np.ndarray, heavy: np.ndarray, heavy_counts: np.ndarray, totals: np.ndarray, size: int, strength: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and losses (near, far) of every bigram of a bucket that is in a text to score."""
    runs = [np.frombuffer(x[3], np.uint32) for x in bucket]
    second = np.concatenate([np.repeat(np.frombuffer(x[2], np.uint64), r) for x, r in zip(bucket, runs)])
    first = np.concatenate([hot[np.frombuffer(x[4], np.uint16)] if len(x[4]) == len(x[5]) else np.frombuffer(x[4], np.uint64) for x in bucket])
    places = [np.frombuffer(x[5], np.uint16) for x in bucket]
    near = np.repeat([x[0] for x in bucket], [len(p) for p in places])
    rows = np.concatenate([x[1] + p.astype(np.int64) for x, p in zip(bucket, places)])
    order = np.lexsort((first, second))
    first, second, near, rows = first[order], second[order], near[order], rows[order]
    new_word = np.r_[True, second[1:] != second[:-1]]
    new_pair = new_word | np.r_[True, first[1:] != first[:-1]]
    at_word, at_pair = np.cumsum(new_word) - 1, np.cumsum(new_pair) - 1
    counts = lambda at: np.stack([np.bincount(at, near), np.bincount(at, ~near)])
    word, pair = counts(at_word), counts(at_pair)
    known = find(second[new_word], heavy)
    word[:, known >= 0] = heavy_counts[:, known[known >= 0]]
    loss = losses(pair, word[:, at_word[new_pair]], totals, size, strength)
    return rows[~near], loss[:, at_pair[~near]]


def cross_entropy_difference(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", size: int | None = None, strength: float = STRENGTH, hot: int = HOT, bucket_tokens: int = BUCKET_TOKENS, heavy: int = HEAVY
) -> DataFrame:
    """One row per row of docs: id_col, n_tokens (the end included), target_loss, background_loss (nats a token), score (their
    difference). docs are the background, all of them; target has the texts to resemble."""
    spark = docs.sparkSession
    background, wanted = docs.select(docs[text_col].alias("text")), target.select(target[target_text_col].alias("text"))
    known = None if size is None else vocabulary(background, wanted, size=size)
    both = lambda *a: _counted(wanted, known, True, *a).union(_counted(background, known, False, *a)).groupBy("key").agg(F.sum("near").alias("near"), F.sum("far").alias("far"))
    counts = cut(both())
    n_words, *totals = counts.agg(F.count_if(F.col("key") != END), F.sum("near"), F.sum("far")).first()
    totals = np.array([x or 0 for x in totals], np.float64)
    if size is None:
        size = n_words + 2
    least = totals.sum() / hot
    frequent, word_counts = _frequent(counts, least)
    pairs, pair_counts = _frequent(both(frequent), least)
    spread, spread_counts = _frequent(counts, min(least, max(totals.sum() / heavy, bucket_tokens)))
    shared = spark.sparkContext.broadcast((known, frequent, word_counts, pairs, pair_counts, totals, size, strength, int(totals.sum() // bucket_tokens) + 1, spread, spread_counts))
    rows = docs.select(docs[id_col], docs[text_col])
    kind = rows.schema[0].dataType.simpleString()
    packed = _packed(rows, shared, False).union(_packed(target.select(F.lit(None).cast(kind), target[target_text_col]), shared, True))

    def run(batches):
        _, hot, _, _, _, totals, size, strength, _, heavy, heavy_counts = shared.value
        sums, bucket, now, id_type = _Sums(), [], None, None

        def flushed():
            at, loss = sums.taken()
            for k in range(0, len(at), 1 << 16):
                part = at[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.nulls(len(part), id_type), pa.nulls(len(part), pa.int64()), *[pa.array(x[k : k + (1 << 16)], pa.float64()) for x in loss]], names=NAMES[7:])

        for batch in batches:
            id_type = batch.column("id").type
            texts = batch.column("row").is_valid()
            if (given := batch.filter(texts)).num_rows:
                yield given.select(NAMES[7:])
            for number, *blob in zip(*[batch.filter(pc.invert(texts)).column(c).to_pylist() for c in NAMES[:7]]):
                if number != now and bucket:
                    sums.add(*_scored(bucket, hot, heavy, heavy_counts, totals, size, strength))
                    bucket = []
                    if sums.full():
                        yield from flushed()
                now = number
                bucket.append(blob)
        if bucket:
            sums.add(*_scored(bucket, hot, heavy, heavy_counts, totals, size, strength))
        yield from flushed()

    tasks = max(TASKS, -(-int(totals.sum()) // TASK_TOKENS))
    parts = packed.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(run, f"row bigint, id {kind}, n_tokens bigint, near double, far double")
    summed = parts.groupBy("row").agg(F.first("id", ignorenulls=True).alias(id_col), F.max("n_tokens").alias("n_tokens"), F.sum("near").alias("near"), F.sum("far").alias("far"))
    return summed.select(
        id_col, "n_tokens", (F.col("near") / F.col("n_tokens")).alias("target_loss"), (F.col("far") / F.col("n_tokens")).alias("background_loss"), ((F.col("near") - F.col("far")) / F.col("n_tokens")).alias("score")
    )
