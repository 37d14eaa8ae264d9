"""Comparing large tables by hierarchical fingerprints: bucket hashes first, then only the rows of buckets that differ.

A table is written in folders by the first bits of a hash of its key, sorted
by bucket inside. Its tree has, for every bucket and every group of buckets
above, a row count and two sums of row hashes, which don't depend on order and
count repeated rows. Two trees are compared from the root down, a level at a
time, following only the nodes that differ; of the tables, only the folders
and row groups of differing buckets are read.

The tree's depth is a parameter (16 to its power are the buckets: 4096, or a
million at 5 levels for tables of many terabytes), so differing buckets, which
are numbers, may come to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.log import exists, read_json, write_once

#: Bits of a level; levels below the root if not said otherwise; the level whose nodes are folders.
FAN_BITS, LEVELS, FOLDER_LEVEL = 4, 3, 2


def _row_hashes(columns: list[str]) -> list[Column]:
    """Two hashes of a row; null and empty cells differ, as each cell says whether it is null."""
    cells = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(F.lit(salt), *cells) for salt in (1, 2)]


def _sums(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("h1").alias("h1"), F.sum("h2").alias("h2"))


class Fingerprinted:
    """A written table with its tree."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.keys, self.levels = read_json(spark, f"{path}/keys.json")

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """The table, or only some buckets of it: folders are pruned, then row groups."""
        df = self.spark.read.parquet(f"{self.path}/rows")
        if buckets is not None:
            shift = FAN_BITS * (self.levels - FOLDER_LEVEL)
            folders = sorted({b >> shift for b in buckets})
            inside = lambda c, xs: f"{c} in ({', '.join(map(str, xs))})" if xs else "false"
            df = df.where(inside("folder", folders)).where(inside("bucket", buckets))
        return df.drop("folder", "bucket")

    def tree(self) -> DataFrame:
        """level (0: the root), node, n, h1, h2."""
        return self.spark.read.parquet(f"{self.path}/tree")


def fingerprint(df: DataFrame, keys: list[str], path: str, levels: int = LEVELS) -> Fingerprinted:
    """Write df with its tree below path; keys decide about buckets."""
    spark = df.sparkSession
    if exists(spark, f"{path}/keys.json"):
        raise ValueError(f"{path} holds a fingerprinted table")
    if not FOLDER_LEVEL <= levels <= 7:
        raise ValueError(f"levels must be from {FOLDER_LEVEL} to 7")
    bucket = F.pmod(F.xxhash64(*keys), F.lit(1 << FAN_BITS * levels)).cast("int")
    dealt = df.withColumn("bucket", bucket).withColumn("folder", F.shiftright("bucket", FAN_BITS * (levels - FOLDER_LEVEL)))
    # one file a folder, or in deep trees several
    dealt.repartition("folder", *(["bucket"] if levels > LEVELS else [])).sortWithinPartitions("folder", "bucket").write.partitionBy("folder").option("compression", "zstd").parquet(f"{path}/rows")
    h1, h2 = _row_hashes(df.columns)
    wide = lambda h: h.cast("decimal(20,0)")
    leaves = spark.read.parquet(f"{path}/rows").select("bucket", F.lit(1).cast("bigint").alias("n"), wide(h1).alias("h1"), wide(h2).alias("h2"))
    leaves = _sums(leaves, "bucket")
    # every leaf counts in one node of each level
    above = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("bucket", FAN_BITS * (levels - k)).alias("node")) for k in range(levels + 1)])).alias("x")
    nodes = _sums(leaves.select("n", "h1", "h2", above).select("x.level", "x.node", "n", "h1", "h2"), "level", "node")
    nodes.write.parquet(f"{path}/tree")
    write_once(spark, f"{path}/keys.json", [keys, levels])
    return Fingerprinted(spark, path)


def differing_buckets(a: Fingerprinted, b: Fingerprinted) -> list[int]:
    """Buckets whose fingerprints differ, found from the root down."""
    if (a.keys, a.levels) != (b.keys, b.levels):
        raise ValueError("the tables have other keys or levels")
    x, y = a.tree(), b.tree()
    above: list[int] | None = None
    for level in range(a.levels + 1):
        own = lambda t: t.where(f"level = {level}") if above is None else t.where(f"level = {level}").where(F.shiftright("node", FAN_BITS).isin(above))  # noqa: B023, E731
        j = own(x).alias("x").join(own(y).alias("y"), "node", "full_outer")
        same = F.col("x.n").eqNullSafe(F.col("y.n")) & F.col("x.h1").eqNullSafe(F.col("y.h1")) & F.col("x.h2").eqNullSafe(F.col("y.h2"))
        above = sorted(r["node"] for r in j.where(~same).select("node").collect())  # a number a bucket
        if not above:
            return []
    return above


def differing_rows(a: Fingerprinted, b: Fingerprinted) -> DataFrame:
    """The keys, `change` (ADDED, REMOVED, CHANGED, or COUNT where only repeats differ) and the columns before and after as structs.

    Rows of a key that are in both tables as often cancel out. Where a key has
    several rows left on either side, all of them are in the lists.
    """
    buckets = differing_buckets(a, b)
    old, new = a.rows(buckets), b.rows(buckets)
    if old.schema != new.schema:
        raise ValueError("the tables have other columns")
    columns = old.columns
    signed = old.withColumn("side", F.lit(-1)).unionByName(new.withColumn("side", F.lit(1)))
    left = signed.groupBy(*columns).agg(F.sum("side").alias("more"), F.count_if(F.col("side") < 0).alias("before"), F.count_if(F.col("side") > 0).alias("after")).where("more <> 0")
    row = F.struct(*columns)
    per = left.groupBy(*a.keys).agg(
        F.sort_array(F.collect_list(F.when(F.col("more") < 0, row))).alias("before_rows"),
        F.sort_array(F.collect_list(F.when(F.col("more") > 0, row))).alias("after_rows"),
        F.bool_and((F.col("before") > 0) & (F.col("after") > 0)).alias("repeats"),
    )
    change = F.when(F.col("repeats"), "COUNT").when(F.size("before_rows") == 0, "ADDED").when(F.size("after_rows") == 0, "REMOVED").otherwise("CHANGED")
    return per.select(*a.keys, change.alias("change"), F.col("before_rows").alias("before"), F.col("after_rows").alias("after"))


def cross_validate(audit: Fingerprinted, candidates: Fingerprinted) -> DataFrame:
    """One row: whether every candidate equals its audit row and each audit row has its candidate, with counts of what doesn't."""
    rows = lambda t: t.tree().where("level = 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    of = lambda x: F.count_if(F.col("change") == x).alias(x.lower())
    out = differing_rows(audit, candidates).agg(*map(of, ("ADDED", "REMOVED", "CHANGED", "COUNT")))
    out = out.select(F.lit(rows(audit)).alias("audited"), F.lit(rows(candidates)).alias("candidates"), "*")
    return out.withColumn("equal", F.expr("added + removed + changed + `count` = 0"))
