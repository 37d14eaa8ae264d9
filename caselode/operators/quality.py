"""Quality issues of documents: categories, inspection, summaries, dispatch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Categories, and the codes and HTTP states that a retry may mend.
CATEGORIES = ["RETRYABLE", "LOGIC_REQUIRED", "REVIEW", "NOT_PROVIDED", "PENDING"]
TRANSIENT = ["LAWGO_TRANSPORT_ERROR", "LAWGO_TRANSPORT_FAILED", "LAWGO_SERVICE_UNAVAILABLE", "IMAGE_TRANSPORT_ERROR", "SOURCE_TRANSPORT_ERROR", "IMAGE_NETWORK_ERROR"]
TRANSIENT_HTTP = r"^((IMAGE|LAWGO|SOURCE)_)?HTTP_(408|429|500|502|503|504)$"
FIELD_CATEGORY = {"ERROR": "LOGIC_REQUIRED", "REVIEW": "REVIEW", "NOT_PROCESSED": "PENDING", "NOT_PROVIDED": "NOT_PROVIDED"}


def is_transient(code: Column) -> Column:
    return code.isin(TRANSIENT) | code.rlike(TRANSIENT_HTTP)


def field_issues(fields: DataFrame) -> DataFrame:
    """(doc, category, code, location) of fields (doc, name, status) that aren't present."""
    category = reduce(lambda acc, kv: acc.when(F.col("status") == kv[0], kv[1]), list(FIELD_CATEGORY.items())[1:], F.when(F.col("status") == "ERROR", "LOGIC_REQUIRED"))
    return fields.select("doc", category.alias("category"), F.concat(F.lit("FIELD_"), "status").alias("code"), F.col("name").alias("location")).where("category is not null")


def image_issues(images: DataFrame) -> DataFrame:
    """Of images (doc, reference, status, code) not acquired."""
    code = F.coalesce("code", "status")
    category = F.when(is_transient(code), "RETRYABLE").when(F.col("status") == "PENDING", "PENDING").otherwise("LOGIC_REQUIRED")
    return images.where("status <> 'ACQUIRED'").select("doc", category.alias("category"), code.alias("code"), F.concat(F.lit("image:"), "reference").alias("location"))


def statute_issues(statutes: DataFrame) -> DataFrame:
    """Of statute links (doc, reference, status, code, version_status)."""
    code = F.coalesce("code", "status")
    failed = F.col("status") == "FAILED"
    category = F.when(failed & is_transient(code), "RETRYABLE").when(failed, "LOGIC_REQUIRED").when(F.col("status") == "AMBIGUOUS", "REVIEW").otherwise("PENDING")
    kept = F.col("status") == "PRESERVED"
    rows = statutes.where(~kept | ~F.col("version_status").eqNullSafe("VERIFIED"))
    return rows.select(
        "doc",
        F.when(kept, "REVIEW").otherwise(category).alias("category"),
        F.when(kept, "STATUTE_VERSION_UNVERIFIED").otherwise(code).alias("code"),
        F.concat(F.lit("statute:"), "reference").alias("location"),
    )


def link_issues(links: DataFrame) -> DataFrame:
    """Of provider links (doc, status) that aren't exact."""
    category = F.when(F.col("status").isin("CONFLICT", "AMBIGUOUS"), "REVIEW").otherwise("PENDING")
    return links.where("status <> 'EXACT'").select("doc", category.alias("category"), F.concat(F.lit("LAWGO_"), "status").alias("code"), F.lit("lawgo").alias("location"))


def inspect(fields=None, images=None, statutes=None, links=None) -> DataFrame:
    """All issues of all documents, as a union of branches."""
    parts = [f(x) for f, x in ((field_issues, fields), (image_issues, images), (statute_issues, statutes), (link_issues, links)) if x is not None]
    return reduce(DataFrame.unionByName, parts)


def summary(issues: DataFrame) -> DataFrame:
    """Per category, the empty ones too: documents with an issue, and issues."""
    all_categories = issues.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in CATEGORIES])).alias("category"))
    got = issues.groupBy("category").agg(F.countDistinct("doc").alias("cases"), F.count("*").alias("locations"))
    return all_categories.join(got, "category", "left").select("category", F.coalesce("cases", F.lit(0)).cast("bigint").alias("cases"), F.coalesce("locations", F.lit(0)).cast("bigint").alias("locations"))


def document_state(fields: DataFrame) -> DataFrame:
    """INCOMPLETE over REVIEW over VALIDATED, per document."""
    rank = F.when(F.col("status").isin("ERROR", "NOT_PROCESSED"), 2).when(F.col("status") == "REVIEW", 1).otherwise(0)
    top = fields.groupBy("doc").agg(F.max(rank).alias("_r"))
    return top.select("doc", F.element_at(F.array(F.lit("VALIDATED"), F.lit("REVIEW"), F.lit("INCOMPLETE")), F.col("_r") + 1).alias("state"))


def only_category(issues: DataFrame, category: str) -> DataFrame:
    """Documents with an issue of the category, with just those issues."""
    return issues.where(F.col("category") == category).groupBy("doc").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))


def dispatch(items: DataFrame, latest: DataFrame, busy: DataFrame) -> DataFrame:
    """Why a reprocessing request (doc, revision, retryable, inputs_present) is skipped, or DISPATCH."""
    j = items.join(latest.select("doc", F.col("revision").alias("_latest")), "doc", "left").join(busy.select("doc", F.lit(True).alias("_busy")).distinct(), "doc", "left")
    why = (
        F.when(F.col("_latest").isNull(), "INPUT_INVALID")
        .when(F.col("_latest") != F.col("revision"), "STALE")
        .when(F.col("_busy"), "BUSY")
        .when(~F.col("retryable"), "NO_RETRYABLE_FAILURE")
        .when(~F.col("inputs_present"), "DEPENDENCY_MISSING")
        .otherwise("DISPATCH")
    )
    return j.withColumn("decision", why).drop("_latest", "_busy")


def audit(scope: DataFrame, inputs: DataFrame, issues: DataFrame) -> DataFrame:
    """Issues of a frozen scope (doc, revision); a document whose input (doc, revision, valid) isn't as frozen has one issue instead.

    That issue says why: INPUT_MISSING, INPUT_REVISION_CHANGED or INPUT_INVALID.
    """
    now = inputs.select("doc", F.col("revision").alias("_now"), F.col("valid").alias("_valid"))
    why = F.when(F.col("_now").isNull(), "INPUT_MISSING").when(F.col("_now") != F.col("revision"), "INPUT_REVISION_CHANGED").when(~F.coalesce("_valid", F.lit(False)), "INPUT_INVALID")
    judged = scope.join(now, "doc", "left").select("doc", why.alias("why"))
    own = issues.join(judged.where("why is null").select("doc"), "doc", "left_semi")
    return own.unionByName(judged.where("why is not null").select("doc", F.lit("LOGIC_REQUIRED").alias("category"), F.col("why").alias("code"), F.lit("input").alias("location")))
