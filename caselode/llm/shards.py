"""Sharding: a uniform shuffle with exact shard sizes.

A random matrix says how many rows of each input partition go to each cell (a
piece of a shard's slots); given the partition and cell sizes its rows follow
the multivariate hypergeometric law, so that dealing each locally permuted
partition out by its row of the matrix is a uniformly random distribution. The
local permutation is a sort inside the partition, which moves nothing. Rows
are then exchanged once, by cell, and permuted again: their rank in the cell,
plus the cell's first slot, is the slot.

Partitions are fixed before anything is counted: the permuted rows are written
once, each with its partition and place, and all that follows (the totals, the
matrix, the exchange) is a function of what was written, however files are
split or tasks run again when it is read. Places without a gap are checked, so
that a row can't get lost between the counts and the deal.

Partitions and cells are what tasks sort, not shards, so the work of a task
stays bounded while the corpus grows to the matrix' bounds, and spills beyond
them. An input of more than MAX_PARTS partitions is coalesced to that many,
without a shuffle. The driver holds the partition totals and the matrix, of
MAX_PARTS x MAX_CELLS counts at most, whatever the number of rows.

Defined cases: rows need not be distinct, each has a place of its own; a null
text has size 16 and crc32 0; other columns pass through, those named as an
output are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import json
import random
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import count_upto, materialize, table, unused

SHARDS = 40
#: Rows in a cell, as long as that makes no more cells than the bounds of the matrix
#: (beyond them cells grow; their sorts spill).
CELL_ROWS, MAX_CELLS, MAX_PARTS = 100_000, 1024, 1024
#: Bits of a row's number inside its partition (the place of monotonically_increasing_id).
_PLACE = 33
SEED = 20240


def _hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of `draws` balls taken from good + bad are good; by inversion around the mode."""
    if draws == 0 or good == 0:
        return 0
    if bad == 0:
        return draws
    low, high = max(0, draws - bad), min(draws, good)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    from math import exp, lgamma

    log_c = lambda n, k: lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)
    p = exp(log_c(good, mode) + log_c(bad, draws - mode) - log_c(good + bad, draws))
    u, up, down, pu, pd = rng.random() - p, mode, mode, p, p
    while u > 0 and (up < high or down > low):
        if up < high:
            pu *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            u -= pu
            if u <= 0:
                return up
        if down > low:
            pd *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            u -= pd
            if u <= 0:
                return down
    return mode


def communication_matrix(block_sizes: list[int], cell_sizes: list[int], seed: int) -> list[list[int]]:
    """Counts by block and cell with these sums, drawn as a uniform deal would give them."""
    rng, left, out = random.Random(seed), list(cell_sizes), []
    for size in block_sizes:
        row, todo, rest = [], size, sum(left)
        for k, have in enumerate(left):
            rest -= have
            x = _hypergeometric(rng, have, rest, todo) if todo else 0
            row.append(x)
            todo -= x
            left[k] -= x
        out.append(row)
    return out


def cells_of(n: int, shards: int, cell_rows: int) -> list[tuple[int, int, int]]:
    """(shard, first slot, rows) of each cell; shard sizes differ by one at most."""
    out = []
    for s in range(shards):
        size = n // shards + (s < n % shards)
        parts = max(1, -(-size // cell_rows))
        at = 0
        for k in range(parts):
            rows = size // parts + (k < size % parts)
            out.append((s, at, rows))
            at += rows
    return out


def _sizes(rows: DataFrame, part: str, place: str) -> list[int]:
    """Rows of each partition; empty ones up to the last that has rows count too."""
    found = {r[0]: r for r in rows.groupBy(part).agg(F.count("*").alias("n"), (F.max(place) + 1).alias("upto"), F.min(place).alias("least")).collect()}
    if any(r["n"] != r["upto"] or r["least"] for r in found.values()):
        raise RuntimeError("written partitions have gaps")
    return [found[k]["n"] if k in found else 0 for k in range(max(found, default=-1) + 1)]


def shard(df: DataFrame, shards: int = SHARDS, seed: int = SEED, cell_rows: int = CELL_ROWS, max_parts: int = MAX_PARTS) -> DataFrame:
    """df with shard and slot: a uniform random order cut into shards of equal size."""
    spark = df.sparkSession
    rid, part, place, cell, first, upto = unused(df, "rid", "part", "place", "cell", "first_slot", "upto")
    mixed = lambda salt: F.xxhash64(F.lit(seed).cast("bigint"), F.lit(salt), F.col(rid))
    keyed = df.drop("shard", "slot").coalesce(max_parts).withColumn(rid, F.monotonically_increasing_id())
    # after the local sort the next running number is partition and rank
    local = keyed.sortWithinPartitions(mixed("local"), rid).withColumn(place, F.monotonically_increasing_id())
    local = local.withColumn(part, F.shiftright(place, _PLACE).cast("int")).withColumn(place, F.col(place).bitwiseAND(F.lit((1 << _PLACE) - 1)))
    local = materialize(local, "permuted")
    sizes = _sizes(local, part, place)
    n_rows = sum(sizes)
    cells = cells_of(n_rows, shards, max(cell_rows, -(-n_rows // max(1, MAX_CELLS - shards))))
    matrix = communication_matrix(sizes, [c[2] for c in cells], seed)
    # a partition's ranks are cut into one run for each cell: the runs' ends, in order
    runs = _inline(spark, [{part: p, upto: list(accumulate(row))} for p, row in enumerate(matrix)], f"array<struct<{part}:int,{upto}:array<bigint>>>")
    slots = _inline(spark, [{cell: c, "shard": s, first: at} for c, (s, at, _) in enumerate(cells)], f"array<struct<{cell}:int,shard:int,{first}:bigint>>")
    # the cell whose run holds the rank: as many as end at or before it lie ahead
    out = local.join(F.broadcast(runs), part).withColumn(cell, count_upto(F.col(upto), F.col(place), len(cells))).drop(part, place, upto)
    again = Window.partitionBy(cell).orderBy(mixed("slot"), rid)
    out = out.withColumn("slot", F.row_number().over(again).cast("bigint") - 1).join(F.broadcast(slots), cell)
    return out.withColumn("slot", F.col(first) + F.col("slot")).drop(rid, cell, first)


def _inline(spark: SparkSession, rows: list[dict], kind: str) -> DataFrame:
    """A small table from the driver; its size is set by parameters, not by texts."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("bigint")


def op7_shard_hypergeometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", size_of(F.col("text")).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"))
    out = shard(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"))
