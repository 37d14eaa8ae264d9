"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of edges (a, b).

    Each round links all larger neighbours, then all smaller ones, to the
    smallest neighbour, until every edge leads to its component's smallest
    node: a logarithmic number of rounds. A round is written to the shared
    folder and the one before deleted; only two sums of it come to the driver.
    Null ends are left out.
    """
    both = edges.where("a is not null and b is not null and a <> b")
    now = materialize(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        # larger neighbours of u go to the smallest of u and its neighbours
        all_ways = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = all_ways.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = all_ways.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(least.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        # u and its smaller neighbours go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, now = now, materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(before)
        sums = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if tuple(sums) == state:
            break
        state = tuple(sums)
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    out = materialize(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots), "components")
    discard(now)
    return out
