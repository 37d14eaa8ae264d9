"""Document dissection as relations: occurrences, payloads parsed once, inventories, positional links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.cells import body_state
from ..session import ship


def tag_occurrences(pages: DataFrame, key: str, html: str, tag: str) -> DataFrame:
    """One row per start tag. A cheap test of the text goes first, so most pages are never parsed."""
    ship(pages.sparkSession)
    some = pages.where(F.contains(F.lower(html), F.lit(f"<{tag}")))
    return some.select(key, F.inline(H.occurrences_udf(tag)(F.col(html))))


def payloads_once(pages: DataFrame, key: str, payload: str, parse) -> DataFrame:
    """(key, result) with each distinct payload parsed once and joined back by its hash."""
    ship(pages.sparkSession)
    hashed = pages.select(key, F.sha2(payload, 256).alias("_h"), payload)
    once = hashed.groupBy("_h").agg(F.first(payload).alias(payload)).select("_h", parse(F.col(payload)).alias("result"))
    return hashed.select(key, "_h").join(once, "_h").drop("_h")


def inventory(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Per row: state, counts (null, not 0, where nothing could be parsed) and error codes."""
    ship(pages.sparkSession)
    state = body_state(F.col(html))
    ok = F.when(state == "OBSERVED", F.col(html))
    seen = pages.select(key, state.alias("status"), H.observation_udf()(ok).alias("o"))
    codes = F.array_compact(F.array(F.when(F.col(key).isNull(), "INVALID_ROW_POSITION"), F.when(F.col("status") == "ERROR", "BODY_NOT_STRING")))
    return seen.select(key, "status", "o.images", "o.links", "o.tables", "o.scripts", "o.title", "o.heading", codes.alias("errors"))


def inventory_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("status") == "OBSERVED").alias("observed"),
        F.coalesce(F.sum("images"), F.lit(0)).cast("bigint").alias("images"),
        F.coalesce(F.sum("links"), F.lit(0)).cast("bigint").alias("links"),
        F.count_if(F.col("links") > 0).alias("rows_with_links"),
        F.count_if(F.size("errors") > 0).alias("rows_with_errors"),
    )


def positional_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full join by ordinal with a state: PAIRED, LEFT_ONLY or RIGHT_ONLY; a strict zip if all are PAIRED."""
    a, b = left.withColumn("_l", F.lit(True)), right.withColumn("_r", F.lit(True))
    j = a.join(b, keys, "full_outer")
    return j.withColumn("pairing", F.when(F.col("_l").isNull(), "RIGHT_ONLY").when(F.col("_r").isNull(), "LEFT_ONLY").otherwise("PAIRED")).drop("_l", "_r")


def unique_links(texts: DataFrame, links: DataFrame, key: str, text: str, target: str) -> DataFrame:
    """Texts with the one target their equal link text has: PRESERVED; none: UNLINKED; several: AMBIGUOUS."""
    per = links.groupBy(text).agg(F.countDistinct(target).alias("_n"), F.min(target).alias("_t"))
    j = texts.select(key, text).join(per, text, "left")
    state = F.when(F.col("_n").isNull(), "UNLINKED").when(F.col("_n") > 1, "AMBIGUOUS").otherwise("PRESERVED")
    return j.select(key, text, state.alias("status"), F.when(F.col("_n") == 1, F.col("_t")).alias("target"))


def match_occurrences(legacy: DataFrame, current: DataFrame, least: int = 30) -> DataFrame:
    """Links of occurrences (source, order, file, before, after) with equal file and long enough equal surroundings.

    A match must be the only one of both its sides, and the order of targets
    must not fall along the order of sources; sources where it does lose all.
    """
    from ..operators.latest import is_monotone

    rich = lambda d, p: d.where((F.length("before") >= least) & (F.length("after") >= least)).select("source", "file", "before", "after", F.col("order").alias(p))
    j = rich(legacy, "legacy_order").join(rich(current, "current_order"), ["source", "file", "before", "after"])
    left = j.groupBy("source", "legacy_order").agg(F.count("*").alias("nl"))
    right = j.groupBy("source", "current_order").agg(F.count("*").alias("nr"))
    one = j.join(left, ["source", "legacy_order"]).join(right, ["source", "current_order"]).where("nl = 1 and nr = 1")
    good = is_monotone(one, ["source"], ["legacy_order"], "current_order").where("monotone")
    return one.join(good, "source").select("source", "legacy_order", "current_order", "file")
