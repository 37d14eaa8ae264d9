"""Inventory snapshots: differences with conservative absence, candidates to fetch, page checks, catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import source_id_state
from .paging import ranges

KINDS = ["NEW", "CHANGED", "UNCHANGED", "LEGACY_KNOWN", "CURRENT_KNOWN", "UNPRESERVED", "MISSING", "ABSENCE_UNCONFIRMED"]
FETCHED = ["NEW", "CHANGED", "UNPRESERVED"]


def _flag(ids: DataFrame | None, like: DataFrame, name: str) -> DataFrame:
    """Distinct ids that aren't blank, with a flag column."""
    if ids is None:
        return like.select("source_id").limit(0).withColumn(name, F.lit(True))
    return ids.where(F.col("source_id").isNotNull() & (F.col("source_id") != "")).select("source_id").distinct().withColumn(name, F.lit(True))


def compare_inventory(
    current: DataFrame,
    baseline: DataFrame | None = None,
    legacy: DataFrame | None = None,
    collected: DataFrame | None = None,
    both_complete: bool = False,
    preservation_checked: bool = False,
    scopes: tuple[str, str] | None = None,
) -> DataFrame:
    """source_id, kind, previous_hash, current_hash of two snapshots (source_id, metadata_hash).

    An id that only the baseline has is MISSING if both listings are complete;
    else its absence is unconfirmed. An id new here is CURRENT_KNOWN if
    collected, else LEGACY_KNOWN if in the legacy catalog, else NEW. Equal
    hashes are UNPRESERVED if preservation was checked and neither set has the
    id. All joins are on the id.
    """
    if scopes is not None and scopes[0] != scopes[1]:
        raise ValueError("snapshots of different scope")
    base = baseline if baseline is not None else current.limit(0)
    now = current.select("source_id", F.col("metadata_hash").alias("current_hash"), F.lit(True).alias("_now"))
    old = base.select("source_id", F.col("metadata_hash").alias("previous_hash"), F.lit(True).alias("_old"))
    rows = now.join(old, "source_id", "full_outer")
    rows = rows.join(_flag(legacy, current, "_legacy"), "source_id", "left").join(_flag(collected, current, "_collected"), "source_id", "left")
    known, here = F.col("_legacy").isNotNull(), F.col("_collected").isNotNull()
    kind = (
        F.when(F.col("_now").isNull(), F.lit("MISSING" if both_complete and baseline is not None else "ABSENCE_UNCONFIRMED"))
        .when(F.col("_old").isNull() & here, "CURRENT_KNOWN")
        .when(F.col("_old").isNull() & known, "LEGACY_KNOWN")
        .when(F.col("_old").isNull(), "NEW")
        .when(~F.col("previous_hash").eqNullSafe(F.col("current_hash")), "CHANGED")
        .when(F.lit(preservation_checked) & ~known & ~here, "UNPRESERVED")
        .otherwise("UNCHANGED")
    )
    return rows.select("source_id", kind.alias("kind"), "previous_hash", "current_hash")


def fetch_candidates(delta: DataFrame, incomplete: DataFrame | None = None) -> DataFrame:
    """Distinct ids whose detail is to be fetched: new, changed or unpreserved, and formerly incomplete ones."""
    out = delta.where(F.col("kind").isin(FETCHED)).select("source_id")
    if incomplete is not None:
        out = out.unionByName(incomplete.where("source_id is not null and source_id <> ''").select("source_id"))
    return out.distinct()


def validate_sorted(delta: DataFrame, position: str) -> DataFrame:
    """Rows of a stored delta that break its order or repeat an id."""
    # ranges of positions, each written with its number; a range's first row follows the last row before it
    ranged = ranges(delta, [position])
    within = Window.partitionBy("_p").orderBy("_k")
    lasts = ranged.groupBy("_p").agg(F.max_by("source_id", "_k").alias("_last"))  # a row for each range
    before = lasts.select("_p", F.lag("_last").over(Window.partitionBy(F.lit(1)).orderBy("_p")).alias("_last"))
    prior = ranged.withColumn("_lag", F.lag("source_id").over(within)).join(F.broadcast(before), "_p", "left")
    prior = prior.withColumn("_prior", F.when(F.col("_k") == 0, F.col("_last")).otherwise(F.col("_lag")))
    return prior.where(F.col("source_id") <= F.col("_prior")).select(*delta.columns)


def audit_pages(pages: DataFrame) -> DataFrame:
    """Listing pages (scope, page, total, ids) with an error: TOTAL_CHANGED, REPEATED_PAGE_IDS, or null.

    A listing that ends early is never COMPLETE; see listing_completeness.
    """
    w = Window.partitionBy("scope").orderBy("page")
    first = F.first("total").over(w)
    ids = pages.select("scope", "page", F.explode("ids").alias("id"))
    repeats = ids.groupBy("scope", "id").agg(F.count("*").alias("n"), F.max("page").alias("page")).where("n > 1").select("scope", "page").distinct().withColumn("_repeat", F.lit(True))
    out = pages.withColumn("_first", first).join(repeats, ["scope", "page"], "left")
    error = F.when(F.col("total") != F.col("_first"), "TOTAL_CHANGED").when(F.col("_repeat"), "REPEATED_PAGE_IDS")
    return out.withColumn("error", error).drop("_first", "_repeat")


def listing_completeness(audited: DataFrame) -> DataFrame:
    """Per scope: PARTIAL with any error, COMPLETE if the ids are as many as the total, else UNKNOWN."""
    per = audited.groupBy("scope").agg(F.count("error").alias("errors"), F.sum(F.size("ids")).cast("bigint").alias("ids"), F.max("total").alias("total"))
    state = F.when(F.col("errors") > 0, "PARTIAL").when(F.col("ids") == F.col("total"), "COMPLETE").otherwise("UNKNOWN")
    return per.select("scope", "ids", "total", state.alias("completeness"))


def catalog(df: DataFrame, id_col: Column) -> DataFrame:
    """One row: distinct valid ids, rows rejected (null is skipped, not rejected), rows in all."""
    s = df.select(id_col.alias("id")).withColumn("state", source_id_state(F.col("id")))
    return s.agg(
        F.countDistinct(F.when(F.col("state") == "VALID", F.col("id"))).alias("distinct_ids"),
        F.count_if(F.col("state").isin("PADDED", "SENTINEL")).alias("rejected"),
        F.count("*").alias("rows"),
    )
