"""Ordered output: top rows, pages, batches, chunks, bounded selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialize


def top(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows of a total order: a heap per task, no full sort."""
    return df.orderBy(*order).limit(limit)


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def keyset_page(df: DataFrame, key: str, after, limit: int = 100) -> DataFrame:
    """The page after a key; the comparison is pushed down to the scan."""
    return (df if after is None else df.where(F.col(key) > after)).orderBy(key).limit(limit)


def ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """df in sorted ranges, written once with a row's range `_p` and its place `_k` in it."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return materialize(ranged.select("*", F.spark_partition_id().alias("_p"), place.alias("_k")), "ranges")


def numbered(df: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """df with a gapless number from 0 in the given order, without a single task.

    Rows are dealt into sorted ranges and written once with their range and
    place in it (ranges are sampled, so a second deal would differ); a range's
    base is the sum of the counts before.
    """
    ranged = ranges(df, order)
    bases, at = {}, 0
    for p, n in sorted((r[0], r[1]) for r in ranged.groupBy("_p").count().collect()):
        bases[p] = at
        at += n
    base = F.get(F.array(*[F.lit(bases.get(p, 0)).cast("bigint") for p in range(max(bases, default=0) + 1)]), F.col("_p"))
    return ranged.withColumn(name, base + F.col("_k")).drop("_p", "_k")


def batch_plan(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """df with the number of its batch of `size` rows."""
    return numbered(df, order).withColumn("batch", F.floor(F.col("ordinal") / size).cast("bigint"))


def waves(df: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """df with waves of at most `size` groups, groups by their first row's order."""
    firsts = df.groupBy(group).agg(F.min(order).alias("_first"))
    plan = numbered(firsts, ["_first", group]).select(group, F.floor(F.col("ordinal") / size).cast("bigint").alias("wave"))
    return df.join(plan, group)


def distinct_chunks(df: DataFrame, value: str, order: str, size: int) -> DataFrame:
    """df with chunks of at most `size` distinct values by first sight; rows without a value join chunk 0."""
    firsts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(order).alias("_first"))
    plan = numbered(firsts, ["_first", value]).select(value, F.floor(F.col("ordinal") / size).cast("bigint").alias("_chunk"))
    return df.join(plan, value, "left").withColumn("chunk", F.coalesce("_chunk", F.lit(0).cast("bigint"))).drop("_chunk")


def ranked_union(parts: list[tuple[DataFrame, list[str]]], limit: int) -> DataFrame:
    """Tables one after the other, each in its own order, cut at limit."""
    out = []
    for k, (df, order) in enumerate(parts):
        out.append(df.select("*", F.lit(k).alias("_source"), F.struct(*order).alias("_key")))
    return reduce(DataFrame.unionByName, out).orderBy("_source", "_key").limit(limit).drop("_source", "_key")


def bounded_selection(df: DataFrame, order: list[str], size: str, offset: int, count: int, budget: int) -> DataFrame:
    """Rows offset .. offset + count in order, as long as their sizes sum to the budget at most.

    `count` bounds what the window sees, so one task is enough.
    """
    some = df.orderBy(*order).offset(offset).limit(count)
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return some.withColumn("running", F.sum(F.col(size).cast("bigint")).over(w)).where(F.col("running") <= budget)
