"""Delta-maintained token counts.

A rollup is a folder of committed batches. A batch holds signed sums by source, language and tokenizer version: inserts add, deletes
subtract, a revision subtracts the old count and adds the new one, perhaps under another key. Totals are the sums
over all batches, so a change costs as much as the change, not as the corpus.

A batch is written to a folder of its own and committed by renaming that to its final name, which fails if the name is taken: of
several writers of one id the first wins, and the others' work is removed. So a batch can be retried after any loss, and what a failed attempt
left is never read. compact() folds the committed batches of one listing into one, remembers their ids, and removes just those that the
written batch names; a batch that is committed meanwhile stays. Run one compaction at a time. A reader that began before a removal may miss files and
has to begin again.

Edge cases: null keys are keys; a null count is zero tokens (the document still counts); an unknown operation is an error; an
empty batch is committed and adds nothing; repeated rows count each; keys whose documents and tokens both reach zero vanish;
other columns are not read.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "version")
SCHEMA = "source string, lang string, version string, docs bigint, tokens bigint, folded string"
#: Tokenizer versions and the pattern of a token in each.
TOKENIZERS = {
    "words-1": r"[^\x20\x09-\x0D]+",
    "words-2": r"[A-Za-z0-9_]+|[^A-Za-z0-9_\x20\x09-\x0D]",
}


def count_tokens(text: Column, version: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKENIZERS[version])), F.lit(0)).cast("long")


def key(source: Column, lang: Column, version: Column, tokens: Column) -> Column:
    """Where a document counts, and how much."""
    return F.struct(source.alias("source"), lang.alias("lang"), version.alias("version"), tokens.cast("long").alias("tokens"))


def signed(changes: DataFrame) -> DataFrame:
    """changes: op ('insert', 'delete' or 'revise'), old and new (key structs; old for deletes and revisions, new for inserts
    and revisions). Returns signed rows of KEYS, docs, tokens."""
    plus = lambda at, sign: F.struct(*[F.col(f"{at}.{k}").alias(k) for k in KEYS], F.lit(sign).alias("docs"), (F.coalesce(F.col(f"{at}.tokens"), F.lit(0)) * sign).alias("tokens"))
    parts = (
        F.when(F.col("op") == "insert", F.array(plus("new", 1)))
        .when(F.col("op") == "delete", F.array(plus("old", -1)))
        .when(F.col("op") == "revise", F.array(plus("old", -1), plus("new", 1)))
        .otherwise(F.raise_error(F.concat(F.lit("unknown operation: "), F.coalesce("op", F.lit("null")))))
    )
    for absent in {"old", "new"}.difference(changes.columns):
        changes = changes.withColumn(absent, F.lit(None).cast("struct<source:string,lang:string,version:string,tokens:bigint>"))
    return changes.select(F.explode(parts).alias("d")).select("d.*")


def sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens")).filter("docs <> 0 OR tokens <> 0")


class Rollup:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._path = spark._jvm.org.apache.hadoop.fs.Path

    def remove(self) -> None:
        """Deletes the rollup with all its batches."""
        self._fs.delete(self._path(self.folder), True)

    def _of(self, batch: str) -> str:
        return f"{self.folder}/batch-{batch}"

    def _exists(self, place: str) -> bool:
        return self._fs.exists(self._path(place))

    def batches(self) -> list[str]:
        """Committed folders."""
        if not self._exists(self.folder):
            return []
        found = [s.getPath().toString() for s in self._fs.listStatus(self._path(self.folder)) if s.isDirectory()]
        return sorted(p for p in found if p.rpartition("/")[2].startswith("batch-"))

    def _read(self, places: list[str]) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(*places) if places else self.spark.createDataFrame([], SCHEMA)

    def _folded(self, places: list[str], within: list[str] | None = None) -> set[str]:
        """Which of these folders the batches of `within` (all of them, if not given) have folded in: as many as there are folders at most."""
        names = self.spark.createDataFrame([(p, p.rpartition("/batch-")[2]) for p in places], "place string, folded string")
        ids = self._read(places if within is None else within).filter("folded IS NOT NULL").select("folded")
        return {r.place for r in names.join(ids, "folded", "left_semi").collect()}

    def committed(self, batch: str) -> bool:
        return self._exists(self._of(batch)) or not self._read(self.batches()).filter(F.col("folded") == batch).isEmpty()

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch of changes once; False if it is in already."""
        if self.committed(batch):
            return False
        return self._write(batch, sums(signed(changes)).withColumn("folded", F.lit(None).cast("string")))

    def _write(self, batch: str, rows: DataFrame) -> bool:
        """Whether this writer was the first."""
        jvm, staged = self.spark._jvm, f"{self.folder}/staged-{uuid.uuid4().hex}"
        rows.write.parquet(staged)  # a row for each key, in as many files as adaptive execution leaves
        hadoop = jvm.org.apache.hadoop.fs
        files = hadoop.FileContext.getFileContext(self._path(staged).toUri() if "://" in staged else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        never_over = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            files.rename(self._path(staged), self._path(self._of(batch)), never_over)
        except Py4JJavaError as e:
            if not self._exists(self._of(batch)):
                raise
            self._fs.delete(self._path(staged), True)
            if not e.java_exception.getClass().getName().endswith(".FileAlreadyExistsException"):
                raise
            return False
        return True

    def _sums(self, places: list[str]) -> DataFrame:
        gone = self._folded(places)
        return sums(self._read([p for p in places if p not in gone]).filter("folded IS NULL"))

    def totals(self) -> DataFrame:
        """Batches that a compacted one has folded in don't count again, even where their removal was cut short."""
        return self._sums(self.batches())

    def compact(self, batch: str) -> None:
        """Folds all committed batches into one with this (new) id. Batches are removed after it is written; if that is cut
        short, calling it again ends it, and touches nothing that was committed since."""
        if not self.committed(batch):
            places = self.batches()
            names = self.spark.createDataFrame([(p.rpartition("/batch-")[2],) for p in places], "folded string")
            old = self._read(places).filter("folded IS NOT NULL").select("folded").union(names)
            ids = old.distinct().select(*[F.lit(None).cast("string").alias(k) for k in KEYS], *[F.lit(0).cast("long").alias(k) for k in ("docs", "tokens")], "folded")
            self._write(batch, self._sums(places).withColumn("folded", F.lit(None).cast("string")).unionByName(ids))
        own = self._of(batch)
        if self._exists(own):
            for place in self._folded([p for p in self.batches() if not p.endswith(f"/batch-{batch}")], [own]):
                self._fs.delete(self._path(place), True)
