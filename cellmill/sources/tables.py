"""Readers. Columns and filters reach the scan, because every reader returns a lazy DataFrame."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellmill.functions.kernels import relative

CELL_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("model_name", "task", "scene_id", "phase", "difficulty")]
    + [T.StructField(c, T.LongType()) for c in ("n_samples", "frame_budget", "batch_size")]
    + [T.StructField(c, T.DoubleType()) for c in ("latency_ms_mean", "gpu_memory_gb")]
    + [T.StructField(c, T.StringType()) for c in ("gpu_name", "precision", "toolkit_version", "git_sha", "timestamp_utc")]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_cells(spark: SparkSession, *paths: str) -> DataFrame:
    """Cell logs, Parquet or JSON lines by extension, with the union of their columns."""
    parts = [spark.read.json(p) if p.endswith((".jsonl", ".json")) else spark.read.option("mergeSchema", "true").parquet(p) for p in paths]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def read_manifest(spark: SparkSession, path: str, max_samples: int | None = None) -> DataFrame:
    """A JSON manifest {task, root, samples: [...]}: one row per sample, the head's fields beside it. max_samples keeps
    that many by position."""
    head = spark.read.option("multiLine", "true").json(path)
    rows = head.select(*[c for c in head.columns if c != "samples"], F.posexplode("samples").alias("position", "sample"))
    rows = rows.select("*", "sample.*").drop("sample")
    return rows if max_samples is None else rows.filter(F.col("position") < max_samples)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Metric records from CSV, JSON lines, or a JSON document {model, task, records: [...]} whose model and task fill gaps."""
    if path.endswith(".csv"):
        return spark.read.option("header", "true").option("inferSchema", "true").csv(path)
    if path.endswith(".jsonl"):
        return spark.read.json(path)
    doc = spark.read.option("multiLine", "true").json(path)
    rows = doc.select(*[F.col(c).alias(f"__{c}") for c in doc.columns if c != "records"], F.explode("records").alias("r")).select("*", "r.*").drop("r")
    for c in ("model", "task"):
        if f"__{c}" in rows.columns:
            rows = rows.withColumn(c, F.coalesce(c, f"__{c}") if c in rows.columns else F.col(f"__{c}"))
    return rows.drop(*[c for c in rows.columns if c.startswith("__")])


def read_jsonl_checked(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a declared schema; a broken line is kept in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path and bytes of files below root; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", F.col("length").alias("bytes"))


def file_checksums(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path and SHA-256 of files below root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def map_entries(df: DataFrame, json_col: str, key: str, value_schema: str) -> DataFrame:
    """A JSON object column keyed by id, as one row per entry: the other columns, key, and the value's fields."""
    parsed = df.withColumn("__m", F.from_json(json_col, f"map<string,struct<{value_schema}>>")).drop(json_col)
    return parsed.select("*", F.explode("__m").alias(key, "__v")).select("*", "__v.*").drop("__m", "__v")


def read_jsonl_numbered(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines with a declared schema: the rows of good lines, and the broken lines as file, line (1-based) and text. Blank lines count but give
    nothing. Lines stay where they are read: a block's first place and number of lines, a row each, say where a broken line is."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    lines = spark.read.text(path).select("value", *place)
    kinds = T.StructType.fromDDL(schema).add("_corrupt_record", "string")
    parsed = lines.withColumn("row", F.from_json("value", kinds, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    blank = F.trim(F.regexp_replace("value", r"\s", "")) == ""
    broken = F.col("row").isNull() | F.col("row._corrupt_record").isNotNull()
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    wrong = parsed.filter(~blank & broken).select("file", "block", "at", F.col("value").alias("text"))
    errors = wrong.join(blocks.withColumn("before", before), ["file", "block"]).select("file", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line"), "text")
    return parsed.filter(~blank & ~broken).select("row.*").drop("_corrupt_record"), errors


def read_scene_splits(spark: SparkSession, path: str) -> DataFrame:
    """scene and tier of a JSON document {"splits": {tier: [scene, ...]}} or {scene: tier}."""
    text = spark.read.text(path, wholetext=True)
    nested = F.from_json(F.get_json_object("value", "$.splits"), "map<string,array<string>>")
    flat = F.from_json("value", "map<string,string>")
    by_tier = text.filter(nested.isNotNull()).select(F.explode(nested).alias("tier", "scenes")).select(F.explode("scenes").alias("scene"), "tier")
    return by_tier.unionByName(text.filter(nested.isNull()).select(F.explode(flat).alias("scene", "tier")))


class ManifestError(ValueError):
    """A manifest or a table that lacks what it must have."""


def manifest_rows(spark: SparkSession, manifest: dict, tasks: set[str]) -> DataFrame:
    """The samples of a manifest that is parsed already: one row each with its position, the task and the root beside it."""
    if "task" not in manifest:
        raise ManifestError("the manifest has no task")
    if manifest["task"] not in tasks:
        raise ManifestError(f"unknown task {manifest['task']!r}; known are {sorted(tasks)}")
    if not isinstance(manifest.get("samples"), list):
        raise ManifestError("the manifest's samples must be a list")
    lines = [json.dumps(s | {"position": i}) for i, s in enumerate(manifest["samples"])]
    kinds = spark.range(1).select(F.schema_of_json(F.lit(json.dumps(_merged(manifest["samples"]) | {"position": 0})))).first()[0]
    rows = spark.createDataFrame([(line,) for line in lines], "line string").select(F.from_json("line", kinds).alias("s")).select("s.*")
    return rows.select("*", F.lit(manifest["task"]).alias("task"), F.lit(str(manifest.get("root") or ".")).alias("root"))


def _merged(samples: list[dict]) -> dict:
    """One sample that has every field that any has."""
    out: dict = {}
    for s in samples:
        out |= {k: v for k, v in s.items() if v is not None}
    return out


#: Columns of the truth that a task's rows must have, and those that may be empty.
TRUTH: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "monocular_depth": (("depth",), ()),
    "object_detection": ((), ("boxes", "labels")),
    "open_vocab_detection": ((), ("boxes", "labels")),
    "object_segmentation": (("mask",), ()),
    "object_tracking": ((), ("tracks",)),
    "relative_camera_pose": (("pose_a", "pose_b"), ()),
    "visual_grounding": (("text",), ("boxes", "labels")),
    "sparse_depth": (("coordinates", "depths"), ()),
    "keypoint_matching": (("points0", "points1"), ("visibility",)),
}
POSE = 16


def _rigid(flat: Column) -> Column:
    """Four rows of four numbers as a rotation's rows and a translation."""
    return F.array(*[F.get(flat, F.lit(4 * i + j)) for i in range(3) for j in range(3)], *[F.get(flat, F.lit(4 * i + 3)) for i in range(3)])


def to_samples(rows: DataFrame, task: str, phases: tuple[str, ...], tiers: tuple[str, ...]) -> DataFrame:
    """A wide table's rows as samples: id (text), rgb, ground_truth, rgb_b, phase, difficulty (null if empty), camera_pose (four rows of four numbers), and
    error, which names the first thing that is wrong with a row, or is null. ground_truth has the task's columns; of a pair of poses it is the
    motion between them (12 numbers: rotation by rows, translation). A table without a column that the task must have is refused."""
    if task not in TRUTH:
        raise ManifestError(f"no truth is known for task {task!r}")
    must, may = TRUTH[task]
    missing = [c for c in ("id", "rgb", *must) if c not in rows.columns]
    if missing:
        raise ManifestError(f"columns {missing} are missing for task {task!r}")
    optional = lambda c, kind: F.col(c).cast(kind) if c in rows.columns else F.lit(None).cast(kind)
    named = lambda c: F.nullif(optional(c, "string"), F.lit(""))
    pose = lambda c: optional(c, "array<double>")
    poses = [c for c in must if c.startswith("pose_")]
    wrong = [(F.col(c).isNull(), f"no {c}") for c in ("id", "rgb", *must)]
    wrong += [(~named(c).isin(*known), f"unknown {c}") for c, known in (("phase", phases), ("difficulty", tiers))]
    wrong += [(F.size(pose(c)) != POSE, f"{c} must have {POSE} numbers") for c in (*poses, "camera_pose")]
    error = F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), what) for c, what in wrong])
    square = F.when(F.size(pose("camera_pose")) == POSE, F.transform(F.sequence(F.lit(1), F.lit(13), F.lit(4)), lambda i: F.slice(pose("camera_pose"), i, 4)))
    truth = [*must, *[c for c in may if c in rows.columns]]
    if poses:
        truth = [F.when(error.isNull(), relative(*[_rigid(pose(c)) for c in poses])).alias("motion")]
    other = F.col("rgb_b") if "rgb_b" in rows.columns else F.lit(None).cast(rows.schema["rgb"].dataType)
    return rows.select(
        F.col("id").cast("string").alias("id"), "rgb", (F.struct(*truth) if truth else F.lit(None)).alias("ground_truth"), other.alias("rgb_b"),
        named("phase").alias("phase"), named("difficulty").alias("difficulty"), square.alias("camera_pose"), error.alias("error"),
    )
