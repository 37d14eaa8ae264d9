"""Parent chains and job trees, by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


def descendants(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """root, node, depth of all nodes (id, parent) below the roots (id), at any depth.

    Pointer doubling: with 2^k-th ancestors known, round k adds the depths from
    2^k on below 2^(k+1), until one adds nothing. Each round is written. A chain
    deeper than there are nodes holds a cycle: that raises.
    """
    up = materialize(nodes.where("parent is not null").select("id", F.col("parent").alias("up")), "up")
    n, steps = nodes.count(), 1
    start = roots.select(F.col("id").alias("root"), F.col("id").alias("node"), F.lit(0).alias("depth"))
    known = materialize(start, "down")
    while True:
        new = known.join(up, F.col("node") == F.col("up")).select("root", F.col("id").alias("node"), (F.col("depth") + steps).alias("depth"))
        new = materialize(new, "down")
        if new.isEmpty():
            return known.where("depth > 0")
        if steps > n:
            raise ValueError("a chain of parents below the roots holds a cycle")
        known = known.unionByName(new)
        up = materialize(up.join(up.select(F.col("id").alias("up"), F.col("up").alias("next")), "up").select("id", F.col("next").alias("up")), "up")
        steps *= 2


def in_cycle(nodes: DataFrame) -> DataFrame:
    """Ids that lie on or below a cycle of parents.

    Pointer doubling: after k rounds each node knows its 2^k-th ancestor, and
    whoever still has one after more steps than there are nodes never comes to
    a root. Each round is written, so plans don't grow.
    """
    n = nodes.count()
    up = nodes.select("id", F.col("parent").alias("up"))
    up = materialize(up.join(nodes.select(F.col("id").alias("up")).distinct(), "up", "left_semi").select("id", "up"), "up")
    steps = 1
    while steps <= n and not up.isEmpty():
        up = materialize(up.join(up.select(F.col("id").alias("up"), F.col("up").alias("next")), "up").select("id", F.col("next").alias("up")), "up")
        steps *= 2
    return up.select("id")


def roll_up(rows: DataFrame, keys: list[str], state: str, failed: list[str], running: list[str]) -> DataFrame:
    """NEEDS_ATTENTION if any member failed, else PROCESSING if any runs, else FINISHED."""
    any_of = lambda names: F.bool_or(F.col(state).isin(names))
    return rows.groupBy(*keys).agg(F.when(any_of(failed), "NEEDS_ATTENTION").when(any_of(running), "PROCESSING").otherwise("FINISHED").alias("roll_up"))
