"""Hashes and identifiers: UTF-8 sha256 throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_hash(x: Column) -> Column:
    return F.sha2(x, 256)


def record_hash(fields: dict[str, Column]) -> Column:
    """Hash of named fields in order of name, each with its length: an encoding of our own, free of ambiguity.

    A null differs from an empty text.
    """
    parts = []
    for name in sorted(fields):
        x = fields[name].cast("string")
        parts += [F.lit(f"{name}="), F.when(x.isNull(), "-").otherwise(F.concat(F.length(x).cast("string"), F.lit(":"), x)), F.lit("\n")]
    return F.sha2(F.concat(*parts), 256)


def canonical_id(key: Column) -> Column:
    return F.concat(F.lit("kc:"), F.sha2(F.concat(F.lit("canonical-allocation-1"), F.decode(F.unhex(F.lit("00")), "UTF-8"), key), 256))


def set_hash(rows: Column) -> Column:
    """Aggregate: hash of the sorted distinct texts of a group, one a line.

    It gathers a group's distinct texts in one row: for groups that are small
    by nature. For tables see table_fingerprint and cell_fingerprint.
    """
    return F.sha2(F.array_join(F.array_sort(F.collect_set(rows)), "\n"), 256)


def _digest_number(digest: Column) -> Column:
    """48 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint")


def _sum(n: Column) -> Column:
    """A sum that wraps around at 2^61, whatever the number of rows."""
    return F.pmod(F.sum(n.cast("decimal(20,0)")), F.lit(1 << 61).cast("decimal(20,0)")).cast("bigint")


def cell_fingerprint(fields: dict[str, Column]) -> list[Column]:
    """Aggregates over the cells of all rows, by name, length and text: row count, sum and xor of 48 bits of each row's record_hash.

    They don't depend on the order of rows and need no gathering.
    """
    n = _digest_number(record_hash(fields))
    return [F.count(F.lit(1)).alias("rows"), _sum(n).alias("sum_hash"), F.bit_xor(n).alias("xor_hash")]


def table_fingerprint(*cols: Column) -> list[Column]:
    """Aggregates that tell tables apart without an order: row count, and two sums of row hashes.

    The sums don't depend on the order of rows and need no gathering.
    """
    h = F.xxhash64(*cols)
    return [F.count(F.lit(1)).alias("rows"), _sum(F.pmod(h, F.lit(1 << 31))).alias("sum_hash"), F.bit_xor(h).alias("xor_hash")]


def snapshot_key(df):
    """df's files by path, size and change time: the key of a file snapshot."""
    m = F.col("_metadata")
    files = df.select(m["file_path"].alias("p"), m["file_size"].alias("s"), m["file_modification_time"].alias("t")).distinct()
    key = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("rows", "sum_hash", "xor_hash")]), 256)
    return files.agg(*cell_fingerprint({c: F.col(c) for c in ("p", "s", "t")})).select(key.alias("snapshot_key"))
