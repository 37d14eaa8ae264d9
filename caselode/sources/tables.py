"""Readers with the checks of the data model, and writers that publish whole or not at all."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import text_of


class SourceError(ValueError):
    """A reader's integrity rule failed; the message is its code."""


def scan(spark: SparkSession, path: str, schema: T.StructType | None = None, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table; columns are pruned in the scan."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def in_file_order(df: DataFrame) -> DataFrame:
    """df with file and row_index: file order without trusting task order."""
    return df.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row_index"))


def point_lookup(df: DataFrame, key: str, value, pinned: tuple[str, str] | None = None) -> DataFrame:
    """The row of a key, found by the statistics of row groups.

    With (column, sha256) the text must still be the pinned version: the
    result says FOUND or BODY_VERSION_CHANGED.
    """
    row = df.where(F.col(key) == value)
    if pinned is None:
        return row.withColumn("lookup", F.lit("FOUND"))
    column, digest = pinned
    return row.withColumn("lookup", F.when(F.sha2(column, 256) == digest, "FOUND").otherwise("BODY_VERSION_CHANGED"))


def lookup_many(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of wanted keys (distinct), each with how often it is there: 1, or a duplicate position, or 0."""
    wanted = keys.select(key).distinct()
    per = df.join(wanted, key, "left_semi").groupBy(key).agg(F.count("*").alias("n"))
    state = F.when(F.col("n").isNull(), "ROW_NOT_FOUND").when(F.col("n") > 1, "DUPLICATE_POSITION").otherwise("FOUND")
    return wanted.join(per, key, "left").select(key, state.alias("lookup"))


def as_fields(df: DataFrame, key: str) -> DataFrame:
    """Stored rows as (key, name, value, status) fields."""
    cells = [F.struct(F.lit(f.name).alias("name"), text_of(f.dataType, F.col(f.name)).alias("value")) for f in df.schema if f.name != key]
    return df.select(key, F.inline(F.array(*cells))).withColumn("status", F.lit("LEGACY_STORED"))


def footer_metadata(path: str, key: str) -> dict:
    """A JSON value of the footer of one local Parquet file; Spark doesn't show footers."""
    import pyarrow.parquet as pq

    raw = (pq.read_schema(path).metadata or {}).get(key.encode())
    return json.loads(raw) if raw else {}


def json_rows(spark: SparkSession, path: str, schema: T.StructType, key: str, body: str | None = None, digest: str | None = None) -> DataFrame:
    """JSON lines; a repeated key or a body that isn't its hash raises."""
    df = spark.read.schema(schema).json(path)
    if not df.groupBy(key).count().where("count > 1").isEmpty():
        raise SourceError("DUPLICATE_POSITION")
    if body and not df.where(~F.sha2(body, 256).eqNullSafe(F.col(digest))).isEmpty():
        raise SourceError("HASH_MISMATCH")
    return df


def csv_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header and maybe a byte order mark."""
    return spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").option("multiLine", True).option("enforceSchema", True).csv(path)


def quarantined(spark: SparkSession, lines: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """Raw JSON lines parsed, with status PRESERVED or QUARANTINED; the raw line stays either way."""
    probe = T.StructType([*schema, T.StructField("_bad", T.StringType())])
    parsed = F.from_json(F.col(value), probe, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    out = lines.withColumn("row", parsed)
    bad = F.col("row").isNull() | F.col("row._bad").isNotNull()
    return out.withColumn("status", F.when(bad, "QUARANTINED").otherwise("PRESERVED"))


def text_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below path as UTF-8 text; `text` is null where the bytes aren't UTF-8."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return raw.select("path", "length", F.expr("try_validate_utf8(cast(content as string))").alias("text"), F.sha2("content", 256).alias("sha256"))


def verified_blobs(spark: SparkSession, path: str, registry: DataFrame) -> DataFrame:
    """Registry rows (sha256, size_bytes) with the state of their blob: VERIFIED, MISSING or BLOB_INTEGRITY_FAILED.

    As where Spark lists files, an empty blob is MISSING and hidden files are passed
    over. The driver lists the entries of path alone; what is below them, and the
    blobs' bytes, only tasks see, a folder each.
    """
    fs, inner = _file_system(path)
    top = [(f.path, f.type == pafs.FileType.Directory) for f in fs.get_file_info(pafs.FileSelector(inner))]

    def run(batches):
        fs, _ = _file_system(path)
        for batch in batches:
            for place, folder in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files = fs.get_file_info(pafs.FileSelector(place, recursive=True)) if folder else [fs.get_file_info(place)]
                seen = [f for f in files if f.type == pafs.FileType.File and f.size and not any(x.startswith(("_", ".")) for x in f.path[len(inner) :].split("/"))]
                for at in range(0, len(seen), 1000):
                    some = seen[at : at + 1000]
                    yield pa.RecordBatch.from_arrays([pa.array([f.base_name for f in some]), pa.array([f.size for f in some], pa.int64()), pa.array([_sha256(fs, f.path) for f in some])], names=["sha256", "length", "_real"])

    places = spark.createDataFrame(top, "place string, folder boolean").repartition(max(1, len(top)), "place")  # a place of path a row
    blobs = places.mapInArrow(run, "sha256 string, length long, _real string")
    j = registry.join(blobs, "sha256", "left")
    ok = (F.col("_real") == F.col("sha256")) & (F.col("length") == F.col("size_bytes"))
    return j.withColumn("state", F.when(F.col("_real").isNull(), "MISSING").when(ok, "VERIFIED").otherwise("BLOB_INTEGRITY_FAILED")).drop("_real", "length")


def publish(df: DataFrame, path: str, rows_per_file: int | None = None) -> DataFrame:
    """Write a new Parquet table and read it back; it must hold the same rows. Never overwrites.

    Spark's commit makes the files appear at once; the check compares counts
    and order-free sums of row hashes, not the rows themselves. Those of df are
    taken in the pass that writes, so df is computed once.
    """
    from ..functions.hashes import table_fingerprint

    seen = Observation()
    cols = [F.to_json(F.struct(F.col(f.name))) if isinstance(f.dataType, T.MapType) else F.col(f.name) for f in df.schema]
    writer = df.observe(seen, *table_fingerprint(*cols)).write.mode("errorifexists").option("compression", "zstd")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    if seen.get != back.agg(*table_fingerprint(*cols)).first().asDict():
        raise SourceError("ROUND_TRIP_FAILED")
    return back


def row_bundle(df: DataFrame, key: str) -> DataFrame:
    """(key, body, sha256, size) of each row as JSON: a manifest with its blobs."""
    body = F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})
    return df.select(key, body.alias("body")).withColumn("sha256", F.sha2("body", 256)).withColumn("size_bytes", F.octet_length("body").cast("bigint"))


def jdbc_rows(spark: SparkSession, url: str, table: str, key: str, bounds: tuple[int, int], parts: int, properties: dict | None = None) -> DataFrame:
    """A table of a database by JDBC, in `parts` ranges of a whole-number key so that no task reads it all.

    The driver's jar is the caller's. Rows outside of the bounds are in the first and last range. One read is
    one statement a range; for one snapshot of all, read from an exported or frozen table.
    """
    if parts < 1 or bounds[0] > bounds[1]:
        raise SourceError("INVALID_JDBC_RANGES")
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    for name, value in (properties or {}).items():
        reader = reader.option(name, value)
    return reader.load()


def _file_system(folder: str):
    return pafs.FileSystem.from_uri(folder) if ":" in folder.split("/")[0] else (pafs.LocalFileSystem(), folder)


def _sha256(fs, path: str) -> str:
    """The hash of a file, read as a stream."""
    h = hashlib.sha256()
    with fs.open_input_stream(path) as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()


def put_files(rows: DataFrame, digest: str, body: str, folder: str) -> DataFrame:
    """Write each body as <folder>/<first two digits>/<digest>, unless it is there; digest and written of each."""
    own = rows.select(F.col(digest).alias("digest"), F.col(body).cast("binary").alias("body"))

    def run(batches):
        import uuid

        fs, inner = _file_system(folder)
        for batch in batches:
            written = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = f"{inner}/{name[:2]}/{name}"
                new = fs.get_file_info(path).type == pafs.FileType.NotFound
                if new:  # whole or not at all: another task may write the same
                    fs.create_dir(f"{inner}/{name[:2]}", recursive=True)
                    part = f"{inner}/{name[:2]}/.{name}.{uuid.uuid4().hex}"
                    with fs.open_output_stream(part) as out:
                        out.write(data or b"")
                    fs.move(part, path)
                written.append(new)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(written, pa.bool_())], names=["digest", "written"])

    return own.mapInArrow(run, "digest string, written boolean")


def described(df: DataFrame) -> DataFrame:
    """position, name and type of a table's columns."""
    return df.sparkSession.createDataFrame([(k, f.name, f.dataType.simpleString()) for k, f in enumerate(df.schema)], "position int, name string, type string")
