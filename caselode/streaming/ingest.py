"""Streams into append-only tables. The reference has no streams: this is an extension of the batch ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ledger import insert_if_absent


def deduplicated(stream: DataFrame, keys: list[str], time: str, lateness: str) -> DataFrame:
    """The first row of each key within the watermark; state of older keys is dropped."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, width: str, lateness: str, *by: str) -> DataFrame:
    """Counts per window and key; rows later than the watermark are left out."""
    return stream.withWatermark(time, lateness).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))


def append_once(stream: DataFrame, table_path: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Run what is there and append rows whose keys the table lacks: a batch that is replayed adds nothing.

    Each micro-batch is anti-joined with the table by key, so exactly-once
    needs no transactions of the sink.
    """

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        hpath = spark._jvm.org.apache.hadoop.fs.Path(table_path)
        fresh = batch.dropDuplicates(keys)
        if hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath):
            fresh = insert_if_absent(spark.read.schema(batch.schema).parquet(table_path), batch, keys)
        fresh.write.mode("append").parquet(table_path)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
