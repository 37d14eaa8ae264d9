"""Append-only tables: insert if absent, conflicts, latest-wins, carry-forward, submissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .latest import latest_per_key


def insert_if_absent(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key isn't there, once each: what an append has to write."""
    return incoming.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def conflicting(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose stored row differs from the incoming one in any other column."""
    rest = [c for c in incoming.columns if c not in keys]
    j = existing.alias("e").join(incoming.alias("i"), keys)
    same = F.lit(True)
    for c in rest:
        same = same & F.col(f"e.{c}").eqNullSafe(F.col(f"i.{c}"))
    return j.where(~same).select(*keys).distinct()


def require_none(df: DataFrame, error: str) -> None:
    """Raise if df has a row: the assertion form of an integrity rule."""
    if not df.isEmpty():
        raise ValueError(error)


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The table after a latest-wins merge; of equal versions the incoming row stays."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return latest_per_key(both, keys, [F.col(version).desc(), F.col("_new").desc()]).drop("_new")


def carry_forward(current: DataFrame, prior: DataFrame, key: str, value: str) -> DataFrame:
    """current with a value that only the prior revision has proven."""
    old = prior.groupBy(key).agg(F.max(value).alias("_old"))
    j = current.join(old, key, "left")
    return j.withColumn("carried", F.col(value).isNull() & F.col("_old").isNotNull()).withColumn(value, F.coalesce(value, "_old")).drop("_old")


def submissions(requests: DataFrame, key: str, payload: str, order: str) -> DataFrame:
    """Per request: ACCEPTED (first of its key), REPEATED (same payload) or CONFLICT."""
    first = requests.groupBy(key).agg(F.min_by(F.struct(payload, order), order).alias("_f"))
    j = requests.join(first, key)
    state = F.when(F.col(order) == F.col("_f")[order], "ACCEPTED").when(F.col(payload).eqNullSafe(F.col("_f")[payload]), "REPEATED").otherwise("CONFLICT")
    return j.withColumn("state", state).drop("_f")


def work_items(df: DataFrame, parts: list[str]) -> DataFrame:
    """df with the ledger key over the columns that make work the same work."""
    from ..functions.hashes import record_hash

    return df.withColumn("work_key", record_hash({p: F.col(p) for p in parts}))


def apply_overlay(base: DataFrame, overlay: DataFrame, key: str, column: str) -> DataFrame:
    """base with column replaced where the overlay says apply."""
    o = overlay.select(key, F.col("apply").alias("_apply"), F.col("value").alias("_value"))
    j = base.join(o, key, "left")
    return j.withColumn(column, F.when(F.coalesce("_apply", F.lit(False)), F.col("_value")).otherwise(F.col(column))).drop("_apply", "_value")


def first_reason(*rules: tuple[str, Column], ok: str = "OK") -> Column:
    """The name of the first rule that holds."""
    out = None
    for name, test in rules:
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(ok)


def pending_manifests(pending: DataFrame, batch: list[str], order: list[str]) -> DataFrame:
    """Per batch the manifest of its open references: a JSON text, named by its own hash, so equal work has one name.

    A batch is bounded where it is planned (see paging); its manifest is one row.
    """
    rest = [c for c in pending.columns if c not in batch]
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.to_json(F.struct(*sorted(rest)), {"ignoreNullFields": "false"}).alias("_json")))), lambda x: x["_json"])
    body = F.concat(F.lit('{"references":['), F.array_join(lines, ","), F.lit("]}"))
    out = pending.groupBy(*batch).agg(F.count("*").alias("references"), body.alias("body"))
    return out.withColumn("manifest_id", F.concat(F.lit("image-manifest:"), F.sha2("body", 256)))


def pinned(inputs: DataFrame, now: DataFrame, key: str, pins: list[str]) -> DataFrame:
    """Inputs with what has changed since they were pinned: the names of differing pins, or MISSING."""
    j = inputs.alias("i").join(now.alias("n"), key, "left")
    there = F.lit(False)
    for p in pins:
        there = there | F.col(f"n.{p}").isNotNull()
    changed = F.array_compact(F.array(*[F.when(~F.col(f"i.{p}").eqNullSafe(F.col(f"n.{p}")), F.lit(p)) for p in pins]))
    return j.select(key, F.when(~there, F.array(F.lit("MISSING"))).otherwise(changed).alias("changed"))


def input_state(size: Column, digest: Column, wanted: Column, most: int) -> Column:
    """Whether an import may be read: IMPORT_INPUT_SIZE_LIMIT, IMPORT_INPUT_HASH_MISMATCH or OK, in this order."""
    return F.when(size > most, "IMPORT_INPUT_SIZE_LIMIT").when(~digest.eqNullSafe(wanted), "IMPORT_INPUT_HASH_MISMATCH").otherwise("OK")


def rebuilt(projection: DataFrame, derived: DataFrame, keys: list[str]) -> DataFrame:
    """keys and state of a projection against one derived anew: SAME, CHANGED, MISSING (not in the projection) or EXTRA."""
    from ..functions.hashes import record_hash

    hashed = lambda df, name: df.select(*keys, record_hash({c: F.col(c).cast("string") for c in sorted(df.columns)}).alias(name))
    j = hashed(projection, "_have").join(hashed(derived, "_want"), keys, "full_outer")
    state = F.when(F.col("_have").isNull(), "MISSING").when(F.col("_want").isNull(), "EXTRA").when(F.col("_have") == F.col("_want"), "SAME").otherwise("CHANGED")
    return j.select(*keys, state.alias("state"))
