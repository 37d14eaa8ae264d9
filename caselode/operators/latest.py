"""Latest per key, first seen, streaks, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by `order`. The rank filter becomes a group limit before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def latest_by_value(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The same for a descending order, as an aggregate with partial sums: cheaper for few wide columns."""
    rest = [c for c in df.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct(*by)).alias("_row")
    return df.groupBy(*keys).agg(top).select(*keys, "_row.*")


def failure_streaks(df: DataFrame, keys: list[str], order: list[str], failed: Column, length: int = 3) -> DataFrame:
    """Per key: the longest run of failures in a row, and whether a breaker of `length` opens."""
    w = Window.partitionBy(*keys).orderBy(*order)
    runs = df.withColumn("_f", failed.cast("int")).withColumn("_run", F.sum(1 - F.col("_f")).over(w))
    per = runs.where("_f = 1").groupBy(*keys, "_run").count()
    longest = per.groupBy(*keys).agg(F.max("count").alias("longest"))
    all_keys = df.select(*keys).distinct()
    out = all_keys.join(longest, keys, "left").withColumn("longest_streak", F.coalesce("longest", F.lit(0)).cast("bigint")).drop("longest")
    return out.withColumn("breaker_open", F.col("longest_streak") >= length)


def running_budget(df: DataFrame, keys: list[str], order: list[str], size: str, budget: int) -> DataFrame:
    """Rows with the running sum of size in their group, and whether it is within the budget."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(F.col(size).cast("bigint")).over(w)).withColumn("within", F.col("running") <= budget)


def is_monotone(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Per key, whether value never falls in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    falls = (F.col(value) < F.lag(value).over(w)).alias("_falls")
    return df.select(*keys, falls).groupBy(*keys).agg((~F.coalesce(F.bool_or("_falls"), F.lit(False))).alias("monotone"))


def status_changes(df: DataFrame, keys: list[str], order: list[str], status: str, allowed: dict[str, list[str]]) -> DataFrame:
    """Transitions that the table of allowed ones doesn't have."""
    w = Window.partitionBy(*keys).orderBy(*order)
    prior = F.lag(status).over(w)
    moved = df.withColumn("previous", prior).where(F.col("previous").isNotNull() & (F.col("previous") != F.col(status)))
    pairs = [f"{a}>{b}" for a, bs in allowed.items() for b in bs]
    return moved.where(~F.concat("previous", F.lit(">"), F.col(status)).isin(pairs))


def latest_before(df: DataFrame, keys: list[str], order: str, counts: Column, name: str) -> DataFrame:
    """df with the greatest `order` (a time) of the rows that count and are strictly earlier; one sort, no self-join."""
    earlier = Window.partitionBy(*keys).orderBy(F.unix_micros(F.col(order).cast("timestamp"))).rangeBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.max(F.when(counts, F.col(order))).over(earlier))
