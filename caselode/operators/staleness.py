"""What a change makes stale: items that depend on others by the content they saw, to a fixpoint.

An item is stale at depth 0 if an upstream item's content is not what it saw,
or is gone; and at depth d + 1 if it depends on an item stale at depth d.
Rounds go along the links, each written, with the newly stale items only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


def staleness(items: DataFrame, links: DataFrame) -> DataFrame:
    """id, state (FRESH, STALE), depth, changed: of each item (id, hash); changed: its own upstream items that aren't as seen.

    links: id, upstream, seen (the hash that the item was made from). Cycles
    end, as an item keeps its first depth.
    """
    now = items.select("id", "hash")
    own = links.join(now.select(F.col("id").alias("upstream"), F.col("hash").alias("is_now")), "upstream", "left")
    own = own.where(~F.col("is_now").eqNullSafe(F.col("seen"))).groupBy("id").agg(F.countDistinct("upstream").alias("changed"))
    step = materialize(now.join(own, "id").select("id", F.lit(0).alias("depth"), "changed"), "stale")
    found, depth = [step], 0
    ways = links.select("id", "upstream").distinct()
    while not step.isEmpty():
        depth += 1
        seen = reduce(DataFrame.unionByName, [f.select("id") for f in found])
        after = ways.join(step.select(F.col("id").alias("upstream")), "upstream").select("id").distinct().join(seen, "id", "left_anti")
        step = materialize(after.join(now.select("id"), "id", "left_semi").select("id", F.lit(depth).alias("depth"), F.lit(0).cast("bigint").alias("changed")), "stale")
        found.append(step)
    stale = reduce(DataFrame.unionByName, found)
    out = now.select("id").join(stale, "id", "left")
    return out.select("id", F.when(F.col("depth").isNull(), "FRESH").otherwise("STALE").alias("state"), "depth", F.coalesce("changed", F.lit(0)).alias("changed"))


def review_states(reviews: DataFrame, items: DataFrame, stale: DataFrame) -> DataFrame:
    """reviews (id, revision, ...) with review_state: VALID, ITEM_MISSING, REVISION_CHANGED (the item is another now) or UPSTREAM_STALE."""
    j = reviews.join(items.select("id", F.col("hash").alias("_now")), "id", "left").join(stale.select("id", F.col("state").alias("_state")), "id", "left")
    state = F.when(F.col("_now").isNull(), "ITEM_MISSING").when(F.col("_now") != F.col("revision"), "REVISION_CHANGED").when(F.col("_state") == "STALE", "UPSTREAM_STALE").otherwise("VALID")
    return j.withColumn("review_state", state).drop("_now", "_state")


def gold(reviews: DataFrame) -> DataFrame:
    """id, gold, reasons: an item is gold if it has reviews and all of them are valid and passed."""
    why = F.when(F.col("review_state") != "VALID", F.col("review_state")).when(~F.coalesce("passed", F.lit(False)), "NOT_PASSED")
    per = reviews.groupBy("id").agg(F.array_sort(F.collect_set(why)).alias("reasons"))  # a set of codes
    return per.select("id", (F.size("reasons") == 0).alias("gold"), "reasons")
