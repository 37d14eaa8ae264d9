"""Reconciliation of an inventory with imports and readers; membership and status joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def membership(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys in both, only left, only right."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(1)), right.select(key).distinct().withColumn("_r", F.lit(1))
    j = a.join(b, key, "full_outer")
    return j.agg(F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("both"), F.count_if(F.col("_r").isNull()).alias("left_only"), F.count_if(F.col("_l").isNull()).alias("right_only"))


def reconcile(inventory: DataFrame, imports: DataFrame, readers: DataFrame) -> DataFrame:
    """Per inventory row: MISSING, ERROR or STAGED_VERIFIED, with reasons and the readers' history.

    inventory (position, body_hash), imports (position, status), readers
    (position, reader_id, body_hash, created_at). The latest reader of an equal
    body counts; others are counted as history.
    """
    w = Window.partitionBy("position").orderBy(F.col("created_at").desc(), F.col("reader_id").desc())
    j = readers.join(inventory.select("position", F.col("body_hash").alias("_want")), "position")
    same = j.where(F.col("body_hash") == F.col("_want")).withColumn("_k", F.row_number().over(w)).where("_k = 1").select("position", "reader_id")
    history = j.groupBy("position").agg(F.count("*").alias("revisions"), F.count_if(F.col("body_hash") != F.col("_want")).alias("other_bodies"))
    out = inventory.join(imports.select("position", F.col("status").alias("import_status")), "position", "left").join(same, "position", "left").join(history, "position", "left")
    why = F.array_compact(F.array(F.when(F.col("import_status").isNull(), "NOT_IMPORTED"), F.when(F.col("import_status") == "QUARANTINED", "QUARANTINED"), F.when(F.col("reader_id").isNull(), "NO_READER")))
    state = F.when(F.col("revisions").isNull(), "MISSING").when(F.size(why) > 0, "ERROR").otherwise("STAGED_VERIFIED")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return out.select("position", state.alias("status"), "reader_id", zero("revisions").alias("revisions"), zero("other_bodies").alias("other_bodies"), F.array_join(why, ",").alias("reasons"))


def is_complete(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("rows"), F.count_if(F.col("status") == "STAGED_VERIFIED").alias("verified"), F.coalesce(F.bool_and(F.col("status") == "STAGED_VERIFIED"), F.lit(True)).alias("complete"))


def state_counts(rows: DataFrame, state: str, vocabulary: list[str], *aggs) -> DataFrame:
    """Counts per state of a closed vocabulary, states without rows too."""
    domain = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v) for v in vocabulary])).alias(state))
    got = rows.groupBy(state).agg(F.count("*").alias("n"), *aggs)
    return domain.join(got, state, "left").fillna(0)


def content_links(files: DataFrame, cells: DataFrame, file: str, text: str) -> DataFrame:
    """Cells with the file of equal text, by hash: the smallest one, and how many files have that text.

    One row a cell: equal texts are a class with a representative and members,
    not all their pairs. The files' side has one row a text, so a hot text is
    hot on one side only, which adaptive skew joins split.
    """
    classes = files.groupBy(F.sha2(text, 256).alias("_h")).agg(F.min(file).alias(file), F.count("*").alias("members"))
    return cells.withColumn("_h", F.sha2(text, 256)).drop(text).join(classes, "_h").drop("_h")


def id_set_status(rows: DataFrame, left: str, right: str) -> DataFrame:
    """rows with the intersection of two id sets, else their union, and which of them it is."""
    both, either = F.array_intersect(left, right), F.array_union(left, right)
    state = F.when(F.size(both) > 0, "AGREED").when(F.size(either) > 0, "PARTIAL").otherwise("NONE")
    return rows.withColumn("ids", F.when(F.size(both) > 0, both).otherwise(either)).withColumn("id_state", state)


def theta_semi(rows: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """Rows with a span of the same key around their time; an open span reaches on. The key makes it an equi-join."""
    s = spans.select(F.col(key).alias("_k"), F.col(start).alias("_s"), F.col(end).alias("_e"))
    cond = (F.col(key) == F.col("_k")) & (F.col(at) >= F.col("_s")) & (F.col("_e").isNull() | (F.col(at) <= F.col("_e")))
    return rows.join(s, cond, "left_semi")


def text_coverage(cells: DataFrame, files: DataFrame, cell: str, file: str, text: str, folder: str) -> DataFrame:
    """folder, status and counts of cells and files by content: MATCHED, CELL_ONLY or FILE_ONLY; equal texts are one class.

    A cell is in the folder of the smallest file with its text; those without a file are in none.
    """
    of = lambda df, *aggs: df.groupBy(F.sha2(text, 256).alias("_h")).agg(*aggs)
    a = of(cells, F.count(cell).alias("cells"))
    b = of(files, F.count(file).alias("files"), F.min_by(folder, file).alias("folder"))
    j = a.join(b, "_h", "full_outer")
    status = F.when(F.col("files").isNull(), "CELL_ONLY").when(F.col("cells").isNull(), "FILE_ONLY").otherwise("MATCHED")
    return j.groupBy("folder", status.alias("status")).agg(F.count("*").alias("texts"), F.coalesce(F.sum("cells"), F.lit(0)).alias("cells"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"))


def bindings(receipts: DataFrame, readers: DataFrame, key: str, digest: str) -> DataFrame:
    """Readers (reader, order, key, digest) with how their receipt (key, digest) binds: BOUND, BODY_DIFFERS, UNBOUND, SEVERAL_SOURCES or DUPLICATE_ORDER."""
    per = receipts.groupBy(key).agg(F.countDistinct(digest).alias("_n"), F.min(digest).alias("_d"))
    times = readers.groupBy("reader", "order").agg(F.count("*").alias("_times"))
    j = readers.join(per, key, "left").join(times, ["reader", "order"])
    state = F.when(F.col("_times") > 1, "DUPLICATE_ORDER").when(F.col("_n").isNull(), "UNBOUND").when(F.col("_n") > 1, "SEVERAL_SOURCES").when(F.col(digest) != F.col("_d"), "BODY_DIFFERS").otherwise("BOUND")
    return j.withColumn("state", state).drop("_n", "_d", "_times")


def prepared(wanted: DataFrame, current: DataFrame, stored: DataFrame, key: str, value: str) -> DataFrame:
    """wanted keys with the best evidence there is: the current value, else the stored one, else none; source says CURRENT, STORED or FETCH."""
    one = lambda df, name: df.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias(name))
    j = wanted.select(key).distinct().join(one(current, "_c"), key, "left").join(one(stored, "_s"), key, "left")
    source = F.when(F.col("_c").isNotNull(), "CURRENT").when(F.col("_s").isNotNull(), "STORED").otherwise("FETCH")
    return j.select(key, source.alias("source"), F.coalesce("_c", "_s").alias(value))
