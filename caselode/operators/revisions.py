"""Versioned documents: current revisions, histories, receipts and replay, staging, integrity, prior evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashes import record_hash
from .latest import latest_per_key
from .sinks import write_sinks


def current(documents: DataFrame, revisions: DataFrame) -> DataFrame:
    """documents (doc, current_revision) with the row of that revision (doc, revision, ...)."""
    return documents.join(revisions.withColumnRenamed("revision", "current_revision"), ["doc", "current_revision"])


def find(documents: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """Keys with their document: one, none (NOT_FOUND) or several (NOT_UNIQUE)."""
    per = documents.groupBy(*by).agg(F.countDistinct("doc").alias("_n"), F.min("doc").alias("_d"))
    j = keys.join(per, by, "left")
    state = F.when(F.col("_n").isNull(), "NOT_FOUND").when(F.col("_n") > 1, "NOT_UNIQUE").otherwise("FOUND")
    return j.withColumn("state", state).withColumn("doc", F.when(F.col("_n") == 1, F.col("_d"))).drop("_n", "_d")


def is_prefix(snapshot: DataFrame, log: DataFrame) -> DataFrame:
    """One row: whether a snapshot's events (sequence, ...) are exactly the log's first ones."""
    cols = snapshot.columns
    last = snapshot.agg(F.max("sequence").alias("_last"))
    upto = log.join(F.broadcast(last)).where(F.col("sequence") <= F.coalesce("_last", F.lit(-1))).select(*cols)
    extra = snapshot.exceptAll(upto).unionByName(upto.exceptAll(snapshot))
    return extra.agg((F.count("*") == 0).alias("is_prefix"))


def preserve(versions: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New content versions (source, id, sha256) and a receipt for every response (source, id, body, received_at)."""
    hashed = incoming.withColumn("sha256", F.sha2("body", 256))
    fresh = hashed.select("source", "id", "sha256", "body").dropDuplicates(["source", "id", "sha256"]).join(versions.select("source", "id", "sha256"), ["source", "id", "sha256"], "left_anti")
    receipts = hashed.select("source", "id", "sha256", "received_at", record_hash({"s": F.col("source"), "i": F.col("id"), "h": F.col("sha256"), "t": F.col("received_at").cast("string")}).alias("receipt_id"))
    return fresh, receipts


def replay(requests: DataFrame, receipts: DataFrame, blobs: DataFrame) -> DataFrame:
    """Responses without a network: the newest receipt (url, status, sha256, received_at) of each request's URL.

    States: REPLAYED, NO_RECEIPT, BAD_STATUS, BODY_MISSING, BODY_CHANGED.
    """
    last = latest_per_key(receipts, ["url"], [F.desc("received_at"), F.desc("sha256")])
    j = requests.join(last, "url", "left").join(blobs.select("sha256", "body"), "sha256", "left")
    state = (
        F.when(F.col("received_at").isNull(), "NO_RECEIPT")
        .when(F.col("status") != 200, "BAD_STATUS")
        .when(F.col("body").isNull(), "BODY_MISSING")
        .when(F.sha2("body", 256) != F.col("sha256"), "BODY_CHANGED")
        .otherwise("REPLAYED")
    )
    return j.withColumn("state", state).withColumn("body", F.when(F.col("state") == "REPLAYED", F.col("body")))


def stage(rows: DataFrame, checks: list[tuple[str, Column]], batch: str = "batch") -> DataFrame:
    """rows with STAGED or FAILED and the code of the first check that a row fails; one bad row fails itself only."""
    code = F.lit(None).cast("string")
    for name, test in reversed(checks):
        code = F.when(~F.coalesce(test, F.lit(False)), F.lit(name)).otherwise(code)
    return rows.withColumn("code", code).withColumn("status", F.when(F.col("code").isNull(), "STAGED").otherwise("FAILED"))


def batch_totals(staged: DataFrame, batch: str = "batch") -> DataFrame:
    return staged.groupBy(batch).agg(F.count("*").alias("rows"), F.count_if(F.col("status") == "STAGED").alias("staged"), F.count_if(F.col("status") == "FAILED").alias("failed"))


def integrity(manifests: DataFrame, blobs: DataFrame, parts: list[str]) -> DataFrame:
    """Reasons why manifests (doc, <part>_sha256 ...) can't be trusted: hashes that no blob (sha256, body) has or that differ."""
    one = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(f"{p}_sha256").alias("sha256")) for p in parts]))
    long = manifests.select("doc", one.alias("x")).select("doc", "x.*")
    j = long.join(blobs.select("sha256", (F.sha2("body", 256) == F.col("sha256")).alias("_ok")), "sha256", "left")
    why = F.when(F.col("sha256").isNull(), F.concat(F.lit("NO_HASH:"), "part")).when(F.col("_ok").isNull(), F.concat(F.lit("MISSING:"), "part")).when(~F.col("_ok"), F.concat(F.lit("CHANGED:"), "part"))
    return j.groupBy("doc").agg(F.array_sort(F.array_compact(F.collect_list(why))).alias("reasons"))


def chain_revision(requested: DataFrame, children: DataFrame) -> DataFrame:
    """Which revision a stage works on: the newest child of an equal root, else the requested one."""
    newest = latest_per_key(children, ["root"], [F.desc("created_at"), F.desc("revision")]).select("root", F.col("revision").alias("_child"))
    return requested.join(newest, "root", "left").withColumn("revision", F.coalesce("_child", "revision")).drop("_child")


def build_revision(inputs: DataFrame, rule_version: str, columns: list[str]) -> DataFrame:
    """inputs with the memo key of a derived build: equal rules and inputs give an equal key."""
    return inputs.withColumn("build", record_hash({"rule": F.lit(rule_version)} | {c: F.col(c) for c in columns}))


def fan_out(rows: DataFrame, parts: dict[str, str], path: str) -> DataFrame:
    """One pass, several JSON outputs: `rows`, and for each part an array column of structs, unfolded with the first key; sink and rows of each."""
    keys = [c for c in rows.columns if c not in parts.values()]

    def unfolded(column: str) -> Column:
        names = rows.schema[column].dataType.elementType.names
        return F.transform(column, lambda x: F.struct(F.col(keys[0]), *[x[f].alias(f) for f in names]))

    return write_sinks(rows, {"rows": F.struct(*keys), **{n: unfolded(c) for n, c in parts.items()}}, path)


def put_blobs(bodies: DataFrame, store: str) -> DataFrame:
    """Append bodies to a content-addressed Parquet store; present ones aren't written again. (sha256, body)"""
    spark = bodies.sparkSession
    new = bodies.select(F.sha2("body", 256).alias("sha256"), "body").dropDuplicates(["sha256"])
    hpath = spark._jvm.org.apache.hadoop.fs.Path(store)
    if hpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hpath):
        new = new.join(spark.read.schema(new.schema).parquet(store).select("sha256"), "sha256", "left_anti")
    new.write.mode("append").parquet(store)
    return spark.read.schema(new.schema).parquet(store)
