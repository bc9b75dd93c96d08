"""Tar shards as a data source and a sink.

A tar file has no table of contents, so a Spark job walks the headers of each shard once (it seeks from one to the next and reads no payload) and keeps
ranges: stretches of about RANGE_BYTES that begin at a header, with their smallest and largest member name. The source plans its partitions from that
small table, drops ranges that filters on shard or member rule out, and each task reads its ranges by offset. What is packed here is sorted by
member within a shard, so the names narrow well; shards from elsewhere need no order.

A shard that is torn or no tar file gives one row with the error in place of what can't be read; all members before the tear are there. Members that
are no plain files (folders, links) are left out. Repeated names stay repeated. Headers that claim to hold for all later members
("global" ones) are not carried over into later ranges.
"""

from __future__ import annotations

import io
import re
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as pads
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from cellmill.sources.publish import replace

#: Bytes of a range, the unit of planning and of a task.
RANGE_BYTES = 1 << 26
#: Bytes of payload in one Arrow batch; a larger member has a batch of its own.
BATCH_BYTES = 1 << 24
INDEX = "_ranges"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
SCHEMA = "shard string, member string, size bigint, modified bigint, data binary, error string"
_ARROW = pa.schema([("shard", pa.string()), ("member", pa.string()), ("size", pa.int64()), ("modified", pa.int64()), ("data", pa.binary()), ("error", pa.string())])
_RANGES = "shard string, start bigint, stop bigint, members bigint, low string, high string, whole boolean"


def _open(place: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder, on whatever Arrow reaches (local, HDFS, object stores)."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", place))


def _walk(stream, start: int, stop: int) -> Iterator[tuple[tarfile.TarFile, tarfile.TarInfo]]:
    """Members whose headers lie in [start, stop). The archive's own list of members is emptied, so memory does not grow with it."""
    stream.seek(start)
    archive = tarfile.open(fileobj=stream, mode="r:")
    while (info := archive.next()) is not None and info.offset < stop:
        archive.members = []
        yield archive, info


def _ranges(shard: str, stream, size: int, most: int) -> list[tuple]:
    """(shard, start, stop, members, low, high, whole) of a shard's ranges; one that ends in a tear isn't whole."""
    out, start, names = [], 0, []

    def close(stop: int, whole: bool) -> None:
        out.append((shard, start, stop, names[2] if names else 0, names[0] if names else None, names[1] if names else None, whole))

    try:
        for _, info in _walk(stream, 0, size):
            if names and info.offset - start >= most:
                close(info.offset, True)
                start, names = info.offset, []
            names = [min(names[0], info.name), max(names[1], info.name), names[2] + 1] if names else [info.name, info.name, 1]
        whole = True
    except (tarfile.TarError, OSError, EOFError):
        whole = False
    close(size, whole)
    return out


def index(spark: SparkSession, place: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Walks all shards (*.tar) under a folder, a task for each, and writes their ranges beside them. A folder without shards has an empty index."""
    system, root = _open(place)
    found = [f.path[len(root) :].lstrip("/") for f in system.get_file_info(pafs.FileSelector(root, recursive=True)) if f.type == pafs.FileType.File and f.path.endswith(".tar")]
    names = spark.createDataFrame([(n,) for n in sorted(found)], "shard string").repartition(max(1, min(len(found), 10_000)), "shard")

    def run(batches):
        fs, base = _open(place)
        for batch in batches:
            for shard in batch.column("shard").to_pylist():
                with fs.open_input_file(f"{base}/{shard}") as stream:
                    rows = _ranges(shard, stream, stream.size(), range_bytes)
                yield pa.RecordBatch.from_arrays([pa.array(c) if i not in (4, 5) else pa.array(c, pa.string()) for i, c in enumerate(zip(*rows))], names=[c.split()[0] for c in _RANGES.split(", ")])

    replace(spark, f"{place}/{INDEX}", names.mapInArrow(run, _RANGES).sort("shard", "start").write.parquet)
    return spark.read.schema(_RANGES).parquet(f"{place}/{INDEX}")


@dataclass
class Ranges(InputPartition):
    """Neighbouring ranges that one task reads: (shard, start, stop)."""

    parts: list


class ShardReader(DataSourceReader):
    """Reads members by offset; filters on shard and member (equal, in, starts with) drop ranges at planning and members before their payload is read."""

    def __init__(self, options: dict):
        self.place, self.payload, self.range_bytes = options["path"], options.get("payload", "true") != "false", int(options.get("rangebytes", RANGE_BYTES))
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in ("shard", "member") and isinstance(f, EqualTo | In):
                self.tests.append((column, "in", tuple(f.value) if isinstance(f, In) else (f.value,)))
            elif column in ("shard", "member") and isinstance(f, StringStartsWith):
                self.tests.append((column, "starts", (f.value,)))
            else:
                yield f

    def _wanted(self, column: str, value: str) -> bool:
        return all(value in vs if how == "in" else value.startswith(vs) for c, how, vs in self.tests if c == column)

    def _may_hold(self, low: str, high: str) -> bool:
        """Whether a range between two member names can hold what is asked for."""
        for column, how, values in self.tests:
            if column == "member":
                if how == "in" and not any(low <= v <= high for v in values if v is not None):
                    return False
                if how == "starts" and (high < values[0] or low[: len(values[0])] > values[0]):
                    return False
        return True

    def partitions(self):
        system, root = _open(self.place)
        parts, size, plans = [], 0, []
        by_member = any(c == "member" for c, _, _ in self.tests)
        for r in (r for b in pads.dataset(f"{root}/{INDEX}", filesystem=system, format="parquet", exclude_invalid_files=True).to_batches() for r in b.to_pylist()):
            empty = r["low"] is None
            if not self._wanted("shard", r["shard"]) or (empty and (r["whole"] or by_member)) or (not empty and not self._may_hold(r["low"], r["high"])):
                continue
            if parts and size + r["stop"] - r["start"] > self.range_bytes:
                plans.append(Ranges(parts))
                parts, size = [], 0
            parts.append((r["shard"], r["start"], r["stop"]))
            size += r["stop"] - r["start"]
        return plans + [Ranges(parts)] if parts or not plans else plans

    def read(self, partition):
        system, root = _open(self.place)
        rows, size = [], 0
        for shard, start, stop in partition.parts if partition else []:
            with system.open_input_file(f"{root}/{shard}") as stream:
                for row in self._members(stream, shard, start, stop):
                    rows.append(row)
                    size += len(row[4] or b"") + 256
                    if size >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)

    def _members(self, stream, shard: str, start: int, stop: int) -> Iterator[tuple]:
        try:
            for archive, info in _walk(stream, start, stop):
                if info.isreg() and self._wanted("member", info.name):
                    data = archive.extractfile(info).read() if self.payload else None
                    if data is not None and len(data) < info.size:
                        raise tarfile.ReadError("unexpected end of data")
                    yield shard, info.name, info.size, int(info.mtime), data, None
        except (tarfile.TarError, OSError, EOFError) as e:
            if not any(c == "member" for c, _, _ in self.tests):  # the row of an error has no member
                yield shard, None, None, None, None, f"{type(e).__name__}: {e}"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


@dataclass
class Packed(WriterCommitMessage):
    staged: list


class ShardWriter(DataSourceArrowWriter):
    """One task writes the members it gets, in their order, to shards of at most so many bytes. Shards are staged under names that readers skip and
    are renamed when all tasks are done; what a lost task leaves stays unread."""

    def __init__(self, options: dict):
        self.place, self.most, self.job = options["path"], int(options.get("shardbytes", 1 << 30)), uuid.uuid4().hex[:12]

    def write(self, iterator):
        system, root = _open(self.place)
        system.create_dir(root, recursive=True)
        staged, stream, archive = [], None, None
        for batch in iterator:
            for member, data in zip(batch.column("member").to_pylist(), batch.column("data").to_pylist()):
                if member is None:
                    raise ValueError("a member needs a name")
                if stream is not None and stream.tell() + len(data or b"") > self.most:
                    archive.close()
                    stream.close()
                    stream = None
                if stream is None:
                    staged.append(f"{self.job}-{uuid.uuid4().hex[:12]}")
                    stream = system.open_output_stream(f"{root}/_staged-{staged[-1]}")
                    archive = tarfile.open(fileobj=stream, mode="w:", format=tarfile.PAX_FORMAT)
                info = tarfile.TarInfo(member)
                info.size = len(data or b"")
                archive.addfile(info, io.BytesIO(data or b""))
                archive.members = []
        if stream is not None:
            archive.close()
            stream.close()
        return Packed(staged)

    def commit(self, messages):
        system, root = _open(self.place)
        for name in (n for m in messages if m for n in m.staged):
            system.move(f"{root}/_staged-{name}", f"{root}/{name}.tar")

    def abort(self, messages):
        system, root = _open(self.place)
        for name in (n for m in messages if m for n in m.staged):
            system.delete_file(f"{root}/_staged-{name}")


class TarShards(DataSource):
    """`spark.read.format("tar_shards").load(folder)`; options payload (false: names and sizes only) and rangeBytes. Writes member and data, appended."""

    @classmethod
    def name(cls):
        return "tar_shards"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ShardReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("shards are only appended")
        return ShardWriter({k.lower(): v for k, v in self.options.items()})


def pack(members: DataFrame, place: str, shards: int | None = None, shard_bytes: int = 1 << 30, range_bytes: int = RANGE_BYTES) -> None:
    """Appends (member, data) to a folder of shards and indexes it: members are sorted into ranges by name, each range fills its own shards. A null payload is
    an empty file; a null name is an error."""
    spark = members.sparkSession
    spark.dataSource.register(TarShards)
    rows = members.select("member", "data")
    rows = (rows.repartitionByRange(shards, "member") if shards else rows.repartitionByRange("member")).sortWithinPartitions("member")
    rows.write.format("tar_shards").mode("append").option("shardBytes", shard_bytes).save(place)
    index(spark, place, range_bytes)


def read(spark: SparkSession, place: str, payload: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Members of an indexed folder of shards. Filters reach Python sources only with a session setting, which is put on here."""
    spark.dataSource.register(TarShards)
    spark.conf.set(PUSHDOWN, "true")
    return spark.read.format("tar_shards").option("payload", str(payload).lower()).option("rangeBytes", range_bytes).load(place)


def samples(members: DataFrame, required: list[str]) -> DataFrame:
    """Manifest of the samples of shards: members `<sample>.<modality>.<extension>` (the last two dots count) of one sample side by side, a column
    `<modality>` with shard, member and size for each required one. Samples that lack one are left out; of a modality that a sample has twice, the
    first by shard and member stays. Errors and names of other forms are no part of it."""
    parts = F.regexp_extract("member", r"^(.*)\.([^./]+)\.[^./]+$", 1), F.regexp_extract("member", r"^(.*)\.([^./]+)\.[^./]+$", 2)
    named = members.filter("member IS NOT NULL").select(parts[0].alias("sample"), parts[1].alias("modality"), F.struct("shard", "member", "size").alias("at"))
    found = [F.min(F.when(F.col("modality") == m, F.col("at"))).alias(m) for m in required]
    whole = F.lit(True)
    for m in required:
        whole &= F.col(f"`{m}`").isNotNull()
    return named.filter(F.col("modality").isin(required)).groupBy("sample").agg(*found).filter(whole)
