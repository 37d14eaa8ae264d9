"""Tables between steps, in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


#: Where tables lie that this process wrote and may delete.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where that is unset a folder of our own.

    On one machine, that is under a master local or local[...], a temporary
    folder serves; under any other master one in the warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            base = f"file://{tempfile.mkdtemp(prefix='caselode-')}"
        else:
            base = f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/caselode-{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again.

    Cuts the lineage: what follows survives lost executors without running
    df again, and reads the same rows however often it is retried.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df's rows dealt by keys over as many tasks as a shuffle has.

    For rows that much is made of: a table of small rows is read as few
    splits, and adaptive execution would coalesce a deal without a number. What
    is grouped by the same keys later needs no further shuffle.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `materialize` gave, once nothing reads them any more."""
    for df in tables:
        path = _PATHS.pop(df, None)
        if path:
            drop_path(df.sparkSession, path)
