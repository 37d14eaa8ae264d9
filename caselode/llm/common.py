"""Helpers of the training-data operators: tables between steps, words, column names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..storage import discard, materialize, scratch_path, shared_dir

__all__ = ["count_upto", "discard", "if_small", "let", "materialize", "scratch_path", "shared_dir", "table", "unused", "words_of"]

#: White space of the word rule, for Java and for DuckDB patterns.
SPACE = r"[\x20\x09-\x0D]+"


#: Rows of a narrow table (a few numbers a row) that may be broadcast: tens of MB.
BROADCAST_ROWS = 500_000


def if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, to be broadcast if it is counted as small; beyond the bound the join shuffles.

    df is a written table, so counting it reads footers. Pass rows if known.
    """
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    r"""Words [^\x20\x09-\x0D]+ of a text; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with no column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """body(value) with value computed once: the argument of a lambda.

    Keeps an expression of linear size, also where the optimizer moves a
    filter on it below a projection.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def count_upto(values: Column, x: Column, n: int) -> Column:
    """How many of the n ascending values are at most x, by bisection."""
    steps = [1 << k for k in reversed(range(max(1, n).bit_length()))]
    further = lambda at, step: F.when(F.get(values, at + step - 1) <= x, at + step).otherwise(at)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further)
