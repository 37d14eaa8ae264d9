"""Tar archives as a data source: members are listed once, dealt by their bytes, and hashed as streams.

Planning reads headers only, skipping over contents. A partition is a run of
members of one archive, up to `bytes` of them or one larger member; a task
seeks to each member and hashes it a piece at a time, so neither an archive
nor a member has to fit in memory. A compressed archive (.gz, .bz2, .xz) can't
be entered in the middle: it is one partition, read from front to end.

Paths are such as pyarrow's file systems open (file, hdfs, s3 and others).
"""

from __future__ import annotations

import hashlib
import tarfile

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a member read at a time; bytes of members that make a partition.
PIECE, PARTITION = 1 << 20, 64 << 20
SCHEMA = "archive string, name string, at bigint, size bigint, sha256 string"
_ARROW = pa.schema([("archive", pa.string()), ("name", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("sha256", pa.string())])


def opened(path: str):
    """A path's file for reading, and its length."""
    fs, inner = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return fs.open_input_file(inner)


def _compressed(path: str) -> bool:
    return path.endswith((".gz", ".tgz", ".bz2", ".xz"))


def members(path: str) -> list[tuple[str, int, int]]:
    """Name, offset and size of each file in a plain archive, from its headers."""
    with opened(path) as raw, tarfile.open(fileobj=raw, mode="r:") as tar:
        return [(m.name, m.offset_data, m.size) for m in tar if m.isfile()]


def _digest(stream, size: int) -> str:
    state = hashlib.sha256()
    while size:
        piece = stream.read(min(PIECE, size))
        if not piece:
            raise EOFError("an archive ends inside a member")
        state.update(piece)
        size -= len(piece)
    return state.hexdigest()


class _Run(InputPartition):
    def __init__(self, archive: str, found: list[tuple[str, int, int]] | None):
        self.archive, self.found = archive, found


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths, self.bytes = options["paths"].split("\n"), int(options.get("bytes", PARTITION))

    def partitions(self):
        out = []
        for path in filter(None, self.paths):
            if _compressed(path):
                out.append(_Run(path, None))
                continue
            run, held = [], 0
            for m in members(path):
                if run and held + m[2] > self.bytes:
                    out.append(_Run(path, run))
                    run, held = [], 0
                run.append(m)
                held += m[2]
            if run:
                out.append(_Run(path, run))
        return out or [_Run("", [])]

    def read(self, part):
        def hashed():
            if part.found is None:
                with opened(part.archive) as raw, tarfile.open(fileobj=raw, mode="r|*") as tar:
                    for m in tar:
                        if m.isfile():
                            yield m.name, m.offset_data, m.size, _digest(tar.extractfile(m), m.size)
            elif part.found:
                with opened(part.archive) as raw:
                    for name, at, size in part.found:
                        raw.seek(at)
                        yield name, at, size, _digest(raw, size)

        rows = []
        for row in hashed():
            rows.append((part.archive, *row))
            if len(rows) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class TarMembers(DataSource):
    """format("tar_members") with option paths (one a line): archive, name, at, size, sha256."""

    @classmethod
    def name(cls):
        return "tar_members"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def tar_members(spark: SparkSession, paths: list[str], bytes_per_task: int = PARTITION) -> DataFrame:
    spark.dataSource.register(TarMembers)
    return spark.read.format("tar_members").option("paths", "\n".join(paths)).option("bytes", bytes_per_task).load()


def folder_members(spark: SparkSession, path: str) -> DataFrame:
    """The files below a folder, in the columns of tar_members."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return raw.select(F.lit(path).alias("archive"), F.col("path").alias("name"), F.lit(0).cast("bigint").alias("at"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def write_tars(rows: DataFrame, name: str, body: str, folder: str) -> DataFrame:
    """One archive a partition of rows below folder, a member a row; archive and members of each that has some."""
    own = rows.select(F.col(name).cast("string").alias("name"), F.col(body).cast("binary").alias("body"))

    def run(batches):
        import io
        import uuid

        fs, inner = pafs.FileSystem.from_uri(folder) if ":" in folder.split("/")[0] else (pafs.LocalFileSystem(), folder)
        fs.create_dir(inner, recursive=True)
        tar = out = None
        made, n = f"part-{uuid.uuid4().hex}.tar", 0  # a task that runs again makes another, and only one is reported
        for batch in batches:
            for who, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if tar is None:
                    out = fs.open_output_stream(f"{inner}/{made}")
                    tar = tarfile.open(fileobj=out, mode="w|", format=tarfile.PAX_FORMAT)
                info = tarfile.TarInfo(who or "")
                info.size = len(data or b"")
                tar.addfile(info, io.BytesIO(data or b""))
                n += 1
        if tar is not None:
            tar.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{made}"]), pa.array([n], pa.int64())], names=["archive", "members"])

    return own.mapInArrow(run, "archive string, members bigint")


def reconcile(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """sha256, status, places of each wanted blob (sha256, size_bytes), and of what was found and nobody wants.

    found: name, size and sha256 of members or files. A blob is a hash;
    members are named by their hash's decimal path or any name, which says
    what they claim to be: RESTORABLE (found by content), SIZE_MISMATCH,
    CHANGED (only a member of its name is there, with other content), MISSING,
    or UNKNOWN (content that nobody wants).
    """
    by_content = found.groupBy("sha256").agg(F.count("*").alias("places"), F.first("size").alias("size"))
    claimed = found.select(F.element_at(F.split("name", "/"), -1).alias("sha256")).distinct().withColumn("claimed", F.lit(True))
    wanted = wanted.groupBy("sha256").agg(F.max("size_bytes").alias("size_bytes"))
    j = wanted.join(by_content, "sha256", "left").join(claimed, "sha256", "left")
    status = (
        F.when(F.col("places").isNull() & F.col("claimed"), "CHANGED")
        .when(F.col("places").isNull(), "MISSING")
        .when(F.col("size") != F.col("size_bytes"), "SIZE_MISMATCH")
        .otherwise("RESTORABLE")
    )
    of = j.select("sha256", status.alias("status"), F.coalesce("places", F.lit(0)).alias("places"))
    rest = by_content.join(wanted, "sha256", "left_anti").select("sha256", F.lit("UNKNOWN").alias("status"), "places")
    return of.unionByName(rest)
