"""Helpers shared by the operators: table access, lineage cuts, names of texts, Arrow batch slicing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellmill.session import settle, shared_dir  # noqa: F401  shared_dir is for other modules

#: Rows handed to Python code at once; keeps a worker's memory small whatever the session's Arrow batch size is.
SLICE_ROWS = 256


#: Rows of an Arrow batch between Spark and Python: texts may be long, and several batches are in memory at once.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


cut = settle  #: cuts lineage in the shared folder


def running_sums(df: DataFrame, by: list[str], order: list, values: dict[str, Column], totals: dict[str, str] | None = None) -> DataFrame:
    """df with a column for each of `values` (whole numbers by name): its sum over the rows of the same `by` that come before by `order`. totals: names
    of values whose whole sums are wanted too -> the columns for them.

    Rows are sorted into ranges, summed within each, and ranges get the sums of those before them, so neither a group nor the table needs
    one task. Rows that are equal in `order` may come in any order."""
    of, own, totals = [f"__of_{c}" for c in by], {v: f"__value_{v}" for v in values}, totals or {}
    valued = df.withColumns({"__tie": F.monotonically_increasing_id()} | {own[v]: c.cast("long") for v, c in values.items()})
    # ranges are sampled anew by every run of the plan, so it is run once
    dealt = cut(valued.repartitionByRange(*by, *order, "__tie").withColumn("__part", F.spark_partition_id()))
    parts = dealt.groupBy(*[F.col(c).alias(o) for c, o in zip(by, of)], F.col("__part").alias("__in")).agg(*[F.sum(own[v]).alias(f"__sum_{v}") for v in values])
    all_parts, before = Window.partitionBy(*of), (Window.unboundedPreceding, -1)
    earlier = {f"__offset_{v}": F.coalesce(F.sum(f"__sum_{v}").over(all_parts.orderBy("__in").rowsBetween(*before)), F.lit(0)) for v in values}
    offsets = parts.withColumns(earlier | {out: F.sum(f"__sum_{v}").over(all_parts) for v, out in totals.items()}).drop(*[f"__sum_{v}" for v in values])
    here = Window.partitionBy("__part", *by).orderBy(*order, "__tie").rowsBetween(*before)
    same = F.col("__part") == F.col("__in")
    for c, o in zip(by, of):
        same &= F.col(c).eqNullSafe(F.col(o))
    placed = dealt.withColumns({f"__within_{v}": F.coalesce(F.sum(own[v]).over(here), F.lit(0)) for v in values}).join(offsets, same)
    return placed.select(*df.columns, *[(F.col(f"__within_{v}") + F.col(f"__offset_{v}")).alias(v) for v in values], *totals.values())


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes that name a text; null counts as empty."""
    whole = F.coalesce(text, F.lit(""))
    return [F.xxhash64(whole).alias("d1"), F.xxhash64(F.lit(1), whole).alias("d2")]


def document(id_col: Column, text_col: Column) -> Column:
    """What names a document: its id and two hashes of its text; in order, those without an id come last."""
    return F.struct(id_col.isNull().alias("no_id"), id_col.alias("id"), *text_key(text_col))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class _Hashes(dict):
    """64-bit hashes of words; a process remembers WORDS of them."""

    WORDS = 1 << 16

    def __missing__(self, word: str) -> int:
        if len(self) >= self.WORDS:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


word_hash = _Hashes().__getitem__
