"""Counters by cohort, differences between sources, and rows with what a registry knows of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def baseline(df: DataFrame, cohorts: list[str], counters: dict[str, Column], distinct: dict[str, Column] | None = None) -> DataFrame:
    """Per cohort, and for all rows together, the rows, those that each test holds for, and distinct values.

    (cohort..., measure, n): one pass with grouping sets; the row of all has
    null cohorts and `total` true. Unknown tests count as not held.
    """
    sums = [F.count("*").alias("rows"), *[F.count_if(F.coalesce(v, F.lit(False))).alias(k) for k, v in counters.items()]]
    sums += [F.countDistinct(v).alias(k) for k, v in (distinct or {}).items()]
    wide = df.groupingSets([[F.col(c) for c in cohorts], []], *[F.col(c) for c in cohorts]).agg(*sums, (F.grouping_id() != 0).alias("total"))
    names = ["rows", *counters, *(distinct or {})]
    return wide.unpivot([*cohorts, "total"], names, "measure", "n")


def source_differences(ours: DataFrame, theirs: DataFrame, key: str, columns: list[str], offset: int = 0, count: int | None = None) -> DataFrame:
    """(key, state, differing): documents of two sources, SAME, DIFFERENT with the columns that differ, or where one lacks them.

    With `count` only so many documents in order of the key, from `offset`: the
    bounded form for sources that are asked live.
    """
    if count is not None:
        ours = ours.orderBy(key).offset(offset).limit(count)
        theirs = theirs.join(ours.select(key), key, "left_semi")
    a = ours.select(key, F.struct(*columns).alias("_a"))
    b = theirs.select(key, F.struct(*columns).alias("_b"))
    differing = F.array_compact(F.array(*[F.when(~F.col("_a")[c].eqNullSafe(F.col("_b")[c]), F.lit(c)) for c in columns]))
    state = F.when(F.col("_a").isNull(), "THEIRS_ONLY").when(F.col("_b").isNull(), "OURS_ONLY").when(F.size("_d") == 0, "SAME").otherwise("DIFFERENT")
    j = a.join(b, key, "full_outer").withColumn("_d", differing)
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return j.select(key, state.alias("state"), F.when(both, F.col("_d")).alias("differing"))


def registered(rows: DataFrame, registry: DataFrame, on: str, columns: list[str], kinds: list[str], metadata: str = "metadata") -> DataFrame:
    """rows with a registry's columns, left joined, of the entries whose metadata (JSON) name one of the kinds."""
    some = registry.where(F.get_json_object(metadata, "$.kind").isin(kinds)).select(on, *columns)
    return rows.join(some, on, "left")


def history(rows: DataFrame, at: str, key: str, n: int = 20) -> DataFrame:
    """The newest n rows with their rank; of equal times the larger key first."""
    from pyspark.sql.window import Window

    newest = rows.orderBy(F.desc(at), F.desc(key)).limit(n)
    return newest.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(at), F.desc(key))))  # n rows


def date_overlay(rows: DataFrame, key: str, title: str, html: str, *metadata: str) -> DataFrame:
    """key, status, value and apply of a repair of missing decision dates: only READY proposals are applied, the others are quarantined with their state."""
    from ..functions.dates import cited_dates, decision_date_status

    status = decision_date_status(F.col(title), F.col(html), *map(F.col, metadata))
    value = F.when(status == "READY", F.get(cited_dates(F.col(title)), F.lit(0)))
    return rows.select(key, status.alias("status"), value.alias("value"), (status == "READY").alias("apply"))
