"""Writers. A repeated write replaces the earlier one, which stays as it was if the new one fails (see publish.replace)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from cellmill.sources.publish import replace


def write_cells(cells: DataFrame, path: str, format: str = "auto") -> None:
    """Parquet or JSON lines ("auto": by extension). An empty table leaves a file with the schema."""
    kind = format if format != "auto" else ("jsonl" if path.endswith((".jsonl", ".json")) else "parquet")
    if kind == "jsonl":
        replace(cells.sparkSession, path, cells.write.option("ignoreNullFields", "false").json)
    else:
        replace(cells.sparkSession, path, cells.write.option("compression", "zstd").parquet)


def write_splits(manifest: DataFrame, path: str, *by: str) -> None:
    """JSON lines below one folder for each value of the columns `by`."""
    replace(manifest.sparkSession, path, manifest.repartition(*by).write.partitionBy(*by).json)


def with_checksum(df: DataFrame) -> DataFrame:
    """The rows as canonical JSON and its SHA-256."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("json")).withColumn("sha256", F.sha2("json", 256))


def _report_rows(rows: DataFrame, most: int) -> list[Row]:
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a report has at most {most} rows; write larger tables as such")
    return got


def markdown(rows: DataFrame, digits: int = 4, most: int = 1000) -> str:
    """A report table as Markdown, made in the driver; more than `most` rows are an error."""
    got = _report_rows(rows, most)
    cell = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = [" | ".join(rows.columns), " | ".join("---" for _ in rows.columns)]
    return "\n".join(f"| {x} |" for x in lines + [" | ".join(cell(v) for v in r) for r in got])


def report_json(rows: DataFrame, most: int = 1000) -> str:
    """The same as JSON."""
    return json.dumps([r.asDict(recursive=True) for r in _report_rows(rows, most)], default=str, sort_keys=True)
