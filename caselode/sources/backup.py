"""Backups of tables: a copy with a manifest of files, and its check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, sha256, size_bytes) of all files below a path; hashed where the files are read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))


def backup(spark: SparkSession, tables: dict[str, str], target: str) -> DataFrame:
    """Copy Parquet tables and write the manifest: table, rows, schema version, row fingerprint."""
    from .tables import publish

    out = []
    for name, path in tables.items():
        copied = publish(spark.read.parquet(path), f"{target}/{name}")
        out.append((name, copied.count(), SCHEMA_VERSION, copied.schema.simpleString()))
    rows = spark.createDataFrame(out, "table string, rows long, schema_version int, columns string")
    rows.write.mode("errorifexists").parquet(f"{target}/_manifest")
    return spark.read.parquet(f"{target}/_manifest")


def verify(spark: SparkSession, target: str) -> DataFrame:
    """Manifest rows with VERIFIED, ROWS_DIFFER, SCHEMA_DIFFERS or VERSION_DIFFERS."""
    listed = spark.read.parquet(f"{target}/_manifest").collect()  # one row a table
    got = []
    for r in listed:
        df = spark.read.parquet(f"{target}/{r['table']}")
        state = "VERSION_DIFFERS" if r["schema_version"] != SCHEMA_VERSION else "SCHEMA_DIFFERS" if df.schema.simpleString() != r["columns"] else "ROWS_DIFFER" if df.count() != r["rows"] else "VERIFIED"
        got.append((r["table"], state))
    return spark.createDataFrame(got, "table string, state string")


def missing_blobs(wanted: DataFrame, have: DataFrame, offset: int, count: int, budget: int) -> DataFrame:
    """What a bounded restore may copy: wanted blobs (sha256, size_bytes) that aren't there, in order, within the budget."""
    from ..operators.paging import bounded_selection

    return bounded_selection(wanted.join(have.select("sha256"), "sha256", "left_anti"), ["sha256"], "size_bytes", offset, count, budget)
