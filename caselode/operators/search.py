"""Any-column literal search over a wide table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import text_of
from ..functions.text import contains_folded, strip
from ..session import ship

LEAST, MOST, SHOWN = 1, 100, 8


def clamp(limit: int) -> int:
    return max(LEAST, min(limit, MOST))


def column_hits(df: DataFrame, query: str, columns: list[str] | None = None) -> Column:
    """Names of the columns that hold the query, in order of the schema.

    Each column is tested for itself, so a match never spans two.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    cols = columns or df.columns
    return F.array_compact(F.array(*[F.when(contains_folded(text_of(kinds[c], F.col(c)), query), F.lit(c)) for c in cols]))


def search(df: DataFrame, query: str, columns: list[str] | None = None, order: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Rows with the query in any column, plus matched_columns (the first 8).

    A blank query finds nothing. With `limit`, the first rows by `order`.
    """
    ship(df.sparkSession)
    query = query.strip()
    if not query:
        return df.limit(0).withColumn("matched_columns", F.expr("cast(array() as array<string>)"))
    out = df.withColumn("matched_columns", F.slice(column_hits(df, query, columns), 1, SHOWN)).where(F.size("matched_columns") > 0)
    if limit is not None:
        out = out.orderBy(*(order or df.columns[:1])).limit(clamp(limit))
    return out


def case_numbers(*cols: Column) -> Column:
    """Trimmed texts that aren't blank, each once, in order."""
    return F.array_distinct(F.filter(F.array_compact(F.array(*[strip(c) for c in cols])), lambda x: x != ""))


def title_first(df: DataFrame, query: str, title: str, body: str) -> DataFrame:
    """Rows whose title holds the query; only if there is none, rows whose body does."""
    in_title = F.coalesce(F.contains(F.lower(title), F.lit(query.lower())), F.lit(False))
    in_body = F.coalesce(F.contains(F.lower(body), F.lit(query.lower())), F.lit(False))
    hits = df.withColumn("matched", F.when(in_title, F.lit("title")).when(in_body, F.lit("body"))).where("matched is not null")
    some = hits.agg(F.coalesce(F.bool_or(F.col("matched") == "title"), F.lit(False)).alias("some_title"))
    return hits.join(F.broadcast(some)).where(~F.col("some_title") | (F.col("matched") == "title")).drop("some_title")


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


#: Which part of a current document matched, and the title of one without.
IN_TITLE, IN_HTML, NO_TITLE = "current_reader_title", "current_reader_html", "현재 제공 본문"


def hit_items(hits: DataFrame, query: str, title: str, html: str) -> DataFrame:
    """hits with display_title and matched_columns: the title if it holds the query, else the body; others go."""
    shown = F.when(strip(F.col(title)) != "", F.col(title)).otherwise(NO_TITLE)
    part = F.when(contains_folded(shown, query), IN_TITLE).when(contains_folded(F.col(html), query), IN_HTML)
    return hits.withColumn("display_title", shown).withColumn("matched_columns", part).where("matched_columns is not null").withColumn("matched_columns", F.array("matched_columns"))
