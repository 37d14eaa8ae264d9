"""Footers of Parquet files as tables: zone maps of row groups, and key-value metadata, read by many tasks.

A footer is read where its file's task runs, without the data. The zone map
names the row groups that may hold a value before anything else is read.
Paths are such as pyarrow's file systems open.
"""

from __future__ import annotations

import json

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .archives import opened

ZONES = "file string, row_group int, rows bigint, bytes bigint, column string, nulls bigint, low string, high string"
#: Files that a lookup names one by one; beyond that it scans with the filter alone.
NAMED = 1000


def _files(spark: SparkSession, files: list[str]) -> DataFrame:
    """A row a file, dealt over tasks."""
    parts = max(1, min(len(files), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return spark.createDataFrame([(f,) for f in files], "file string").repartition(parts, "file")


def _text(x) -> str | None:
    if x is None:
        return None
    if isinstance(x, bytes):
        return x.decode("utf-8", "replace")
    return str(x).lower() if isinstance(x, bool) else str(x)


def zone_map(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A row a row group and column of df's files: rows, bytes, nulls, and the least and greatest value as text (null if not known)."""
    spark, wanted = df.sparkSession, set(columns or df.columns)

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with opened(path) as f:
                    meta = pq.ParquetFile(f).metadata
                out = []
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    for k in range(group.num_columns):
                        c = group.column(k)
                        if c.path_in_schema in wanted:
                            s = c.statistics
                            bounds = (_text(s.min), _text(s.max)) if s is not None and s.has_min_max else (None, None)
                            out.append((path, g, group.num_rows, c.total_compressed_size, c.path_in_schema, s.null_count if s is not None and s.has_null_count else None, *bounds))
                if out:
                    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in ZONES.split(", ")])

    return _files(spark, df.inputFiles()).mapInArrow(run, ZONES)


def key_values(df: DataFrame) -> DataFrame:
    """file, key, value of the footers of df's files; Spark's own schema entry among them."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with opened(path) as f:
                    found = pq.ParquetFile(f).metadata.metadata or {}
                own = [(k.decode("utf-8", "replace"), v.decode("utf-8", "replace")) for k, v in found.items()]
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(own)), *(pa.array(x) for x in zip(*own, strict=True))], names=["file", "key", "value"])

    return _files(df.sparkSession, df.inputFiles()).mapInArrow(run, "file string, key string, value string")


def footer_value(df: DataFrame, key: str) -> dict:
    """The JSON value that all of df's files have under a key; {} if none has it. Files that differ raise."""
    found = key_values(df).where(F.col("key") == key).groupBy("value").count().limit(2).collect()
    if len(found) > 1:
        raise ValueError("FOOTERS_DIFFER")
    return json.loads(found[0]["value"]) if found else {}


def may_hold(zones: DataFrame, column: str, value, kind: str) -> DataFrame:
    """Row groups (file, row_group, rows) that may hold a value of a column; those without bounds may."""
    typed = lambda c: F.col(c).try_cast(kind)
    wanted: Column = F.lit(value).cast(kind)
    inside = typed("low").isNull() | typed("high").isNull() | wanted.between(typed("low"), typed("high"))
    return zones.where((F.col("column") == column) & inside & ~F.coalesce(F.col("nulls") == F.col("rows"), F.lit(False))).select("file", "row_group", "rows")


def zone_lookup(df: DataFrame, zones: DataFrame, column: str, value) -> DataFrame:
    """The rows with a value, with `row_groups`: how many were named before reading."""
    groups = may_hold(zones, column, value, df.schema[column].dataType.simpleString())
    named = groups.groupBy("file").count().limit(NAMED + 1).collect()
    n = sum(r["count"] for r in named)
    rows = df if len(named) > NAMED else df.sparkSession.read.schema(df.schema).parquet(*[r["file"] for r in named]) if named else df.limit(0)
    return rows.where(F.col(column) == value).withColumn("row_groups", F.lit(n).cast("bigint"))
