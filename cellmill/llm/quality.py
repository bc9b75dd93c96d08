"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

Features are words and marks (runs of other characters), their bigrams, and one feature for any word that repeats the word
before it, hashed into BUCKETS places. A text is the unit vector of its feature counts; its score is the logistic function of
one sparse dot product. (The repeated word is no n-gram, but a feature of its own.) Training is sequential by nature and runs in one task over TRAIN_ROWS
labelled rows and TRAIN_CHARS characters at most: rows in the order of a hash of their id, so the choice does not depend on order or partitions, as long as
their texts together have no more. Features are made where the texts are, and the one task gets them alone. The model
has BUCKETS + 1 numbers whatever the data, so it is broadcast; scoring is a map without a shuffle.

Edge cases: null and empty texts have no features and get the score of the bias alone; rows without a label, an id or a text
in the table of documents don't train; several different labels of one id train one after another, equal ones once; of several
texts of one id the one with the smallest hash trains; without any training row every score is 0.5; a null id is scored, and is not held out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellmill.llm.common import slices, word_hash

BUCKETS = 1 << 18
TRAIN_ROWS = 12_000
#: Bounds the memory of training: a character gives less than one feature, and a feature has 8 bytes.
TRAIN_CHARS = 1 << 27
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.1, 0.0
_UNITS = re.compile(r"\w+|[^\w\s]+").findall
_MIX = np.uint64(0x9E3779B97F4A7C15)
_REPEAT = np.uint64(0x5851F42D4C957F2D)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers and values of a text's features; the values have length 1."""
    units = _UNITS(text) if text else []
    one = np.fromiter(map(word_hash, units), np.uint64, len(units))
    two = one[:-1] * _MIX + one[1:]
    two ^= two >> np.uint64(31)
    again = np.full(int((one[:-1] == one[1:]).sum()), _REPEAT)
    at, n = np.unique(np.concatenate([one, two, again]) & np.uint64(BUCKETS - 1), return_counts=True)
    return at.astype(np.int32), (n / np.sqrt(np.dot(n, n)) if len(n) else n).astype(np.float32)


@dataclass
class Ftrl:
    """Per-coordinate follow-the-regularised-leader (proximal), with the bias in the last place."""

    z: np.ndarray
    n: np.ndarray

    @classmethod
    def new(cls) -> Ftrl:
        return cls(np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1))

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: float) -> None:
        at, x = np.append(at, BUCKETS), np.append(x, 1.0)
        w = self.weights(at)
        slope = (_logistic(w @ x) - label) * x
        n = self.n[at]
        step = (np.sqrt(n + slope * slope) - np.sqrt(n)) / ALPHA
        self.z[at] += slope - step * w
        self.n[at] = n + slope * slope


def _logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -700, 700))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights after some passes over (bucket numbers, values, label) rows in their order."""
    model = Ftrl.new()
    for _ in range(epochs):
        for at, x, label in rows:
            model.learn(at, x, float(label))
    return model.weights()


def score_text(text: str | None, weights: np.ndarray) -> float:
    at, x = features(text)
    return _logistic(float(weights[at] @ x) + weights[BUCKETS])


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> np.ndarray:
    """Weights learnt from at most `rows` labelled rows that are not held out, and at most `chars` characters of them."""
    known = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("label")).distinct()
    order = [F.xxhash64("id"), "id", "label"]
    sample = known.filter(F.col("label").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id"))).orderBy(*order).limit(rows)
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).filter("text IS NOT NULL")
    found = texts.join(F.broadcast(sample), "id")  # `rows` rows of two numbers
    found = found.groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # one text an id, however often it occurs

    def featured(batches):
        for batch in slices(batches):
            made = [features(t) for t in batch.column(3).to_pylist()]
            bytes_of = lambda k: pa.array([m[k].tobytes() for m in made], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], bytes_of(0), bytes_of(1), *batch.columns[4:]], names=["id", "label", "h", "at", "x", "chars"])

    def run(batches):
        rows = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["x"], np.float32), r["label"]) for batch in batches for r in batch.select(["at", "x", "label"]).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([fit(rows).tobytes()], pa.binary())], names=["weights"])

    texts = found.select("id", "label", F.xxhash64("text").alias("h"), "text", F.length("text").alias("chars"))
    made = texts.mapInArrow(featured, f"id {found.schema['id'].dataType.simpleString()}, label int, h bigint, at binary, x binary, chars int")
    in_order = Window.orderBy(*order, "h").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over `rows` rows
    one = made.withColumn("so_far", F.sum("chars").over(in_order)).filter(F.col("so_far") <= chars).select("label", "at", "x")
    got = one.mapInArrow(run, "weights binary").collect()
    return np.frombuffer(got[0].weights) if got else np.zeros(BUCKETS + 1)


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> Column:
    """The score of each row of docs as a column."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([score_text(t.as_py(), shared.value) for t in texts], pa.float64())

    return of(docs[text_col])
