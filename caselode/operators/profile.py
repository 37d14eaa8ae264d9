"""Column profiles, samples, completeness and table comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.cells import missing_kind, text_of


def long_form(df: DataFrame, value) -> DataFrame:
    """(column, value) rows; value(kind, col) gives the text for a column. One scan, one explode."""
    cells = [F.struct(F.lit(f.name).alias("column"), value(f.dataType, F.col(f.name)).alias("value")) for f in df.schema]
    return df.select(F.inline(F.array(*cells)))


def missing_profile(df: DataFrame) -> DataFrame:
    """Rows by column and kind of missing value."""
    return long_form(df, missing_kind).groupBy("column", F.col("value").alias("kind")).agg(F.count("*").alias("rows"))


def type_profile(df: DataFrame, position: str) -> DataFrame:
    """Per column: type, rows with a value, distinct values, first position with one, longest text."""
    cells = [
        F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), text_of(f.dataType, F.col(f.name)).alias("value"), F.col(position).cast("bigint").alias("position"))
        for f in df.schema
    ]
    rows = df.select(F.inline(F.array(*cells)))
    known = F.col("value").isNotNull()
    return rows.groupBy("column", "type").agg(
        F.count("value").alias("present"),
        F.countDistinct("value").alias("distinct_values"),
        F.min(F.when(known, F.col("position"))).alias("first_position"),
        F.max(F.length("value")).alias("longest"),
    )


def sequence_complete(df: DataFrame, key: str) -> DataFrame:
    """One row: whether key is exactly 0 .. n-1."""
    return df.agg(
        F.count("*").alias("n"),
        F.coalesce((F.min(key) == 0) & (F.max(key) == F.count("*") - 1) & (F.countDistinct(key) == F.count("*")), F.lit(True)).alias("complete"),
    )


def stratified_sample(df: DataFrame, strata: list[str], key: str, seed: str, per_stratum: int) -> DataFrame:
    """The same rows on every run: per stratum those of the smallest hash of seed and key."""
    h = F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)
    w = Window.partitionBy(*strata).orderBy("_h", key)
    return df.withColumn("_h", h).withColumn("sample_rank", F.row_number().over(w)).where(F.col("sample_rank") <= per_stratum).drop("_h")


def uniform_sample(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    h = F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)
    return df.orderBy(h, key).limit(n)


def selected_sample(df: DataFrame, key: str, category: str, text: str, step: int) -> DataFrame:
    """Keys of every step-th row, the first row of each category, and the longest text."""
    systematic = df.where(F.col(key) % step == 0).select(key)
    firsts = df.groupBy(category).agg(F.min(key).alias(key)).select(key)
    longest = df.select(key, F.length(text).alias("_n")).orderBy(F.col("_n").desc_nulls_last(), key).limit(1).select(key)
    return reduce(DataFrame.union, [systematic, firsts, longest]).distinct()


def samples_per_category(df: DataFrame, category: str, order: str, n: int = 10) -> DataFrame:
    w = Window.partitionBy(category).orderBy(order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one table has more often than the other, with the side that has them."""
    left = a.exceptAll(b).withColumn("side", F.lit("left"))
    return left.unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def cell_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, column) of cells that differ, null-aware, after a full join on the key."""
    cols = [c for c in a.columns if c != key]
    kinds = {f.name: f.dataType for f in a.schema}
    long = lambda df: df.select(key, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), text_of(kinds[c], F.col(c)).alias("value")) for c in cols])))
    j = long(a).withColumnRenamed("value", "left").join(long(b).withColumnRenamed("value", "right"), [key, "column"], "full_outer")
    return j.where(~F.col("left").eqNullSafe(F.col("right")))
