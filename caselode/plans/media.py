"""Image references, acquisitions, provider links and fields over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents, fields, images, links, paging
from .registry import query


@query(
    "d21_reference_status",
    "SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN 'UNRESOLVED' WHEN p_size > 40 THEN 'ID_MISMATCH' WHEN p_size < 10 THEN 'NAME_ONLY' ELSE 'RESOLVED' END AS status FROM part",
)
def _(t):
    explicit = F.when(F.col("p_type") == "SMALL", "UNRESOLVED")
    url = F.when(F.col("p_size") >= 10, F.col("p_brand"))
    return t.part.select("p_partkey", images.reference_status(explicit, F.col("p_size") > 40, F.col("p_name"), url).alias("status"))


@query(
    "d22_acquisition_accounting",
    """SELECT doc_id, CASE WHEN (sum(coalesce(n, 0)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)) > 60000 THEN 'SKIPPED' WHEN n IS NULL THEN 'FAILED' ELSE 'ACQUIRED' END AS outcome
       FROM (SELECT doc_id, source, CASE WHEN lang <> 'de' THEN n_chars END AS n FROM documents)""",
)
def _(t):
    rows = t.documents.select("doc_id", F.col("source").alias("chunk"), F.when(F.col("lang") != "de", F.col("n_chars")).alias("n"))
    return images.accounting(rows, "doc_id", "doc_id", "n", 60_000).select("doc_id", "outcome")


@query(
    "d39_provider_state",
    """SELECT o_orderkey, CASE WHEN outcome IS NULL THEN 'NEVER_ATTEMPTED' WHEN outcome IN ('ACQUIRED', 'FAILED') THEN outcome ELSE 'OTHER' END AS state FROM orders LEFT JOIN
       (SELECT user_id, CASE event_type WHEN 'purchase' THEN 'ACQUIRED' WHEN 'error' THEN 'FAILED' ELSE 'SKIPPED' END AS outcome FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) ON o_custkey = user_id""",
)
def _(t):
    tries = t.events.select(F.col("user_id").alias("o_custkey"), "event_id", F.when(F.col("event_type") == "purchase", "ACQUIRED").when(F.col("event_type") == "error", "FAILED").otherwise("SKIPPED").alias("outcome"))
    return images.provider_state(t.orders, tries, "o_custkey", "event_id").select("o_orderkey", "state")


@query(
    "d40_fresh_requests",
    "SELECT l_partkey, row_number() OVER (ORDER BY k, l_partkey) - 1 AS ordinal FROM (SELECT l_partkey, min(l_orderkey) AS k FROM lineitem WHERE l_partkey NOT IN (SELECT doc_id FROM labels) GROUP BY l_partkey)",
)
def _(t):
    done = t.labels.select(F.col("doc_id").alias("l_partkey"))
    return images.plan_acquisition(t.lineitem.select("l_partkey", "l_orderkey"), done, "l_partkey", "l_orderkey").select("l_partkey", "ordinal")


@query(
    "p17_mapping_reason",
    "SELECT p_partkey, CASE WHEN p_size < 5 THEN 'NO_MAPPING' WHEN p_size < 20 THEN 'SEVERAL_MAPPINGS' WHEN p_type = 'SMALL' THEN 'NAME_DIFFERS' WHEN p_size > 45 THEN 'NO_SIZE' ELSE 'EXACT' END AS reason FROM part",
)
def _(t):
    size = F.col("p_size")
    names = F.when(size < 5, F.expr("cast(array() as array<string>)")).when(size < 20, F.array("p_name", "p_brand")).otherwise(F.array("p_name", "p_name"))
    file = F.when(F.col("p_type") == "SMALL", F.col("p_brand")).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", images.mapping_reason(names, file, F.when(size <= 45, size)).alias("reason"))


@query(
    "d23_link_plan",
    """WITH j AS (SELECT s.s_suppkey, s.s_nationkey AS mine, c.c_custkey, c.c_nationkey AS theirs FROM supplier s LEFT JOIN customer c ON c.c_custkey % 50 = s.s_suppkey AND c.c_mktsegment = 'BUILDING'),
       p AS (SELECT s_suppkey, count(c_custkey) AS n, count(*) FILTER (WHERE mine = theirs) AS eq, min(c_custkey) FILTER (WHERE mine = theirs) AS hit FROM j GROUP BY s_suppkey)
       SELECT s_suppkey, CASE WHEN n = 0 THEN 'UNMATCHED' WHEN n > 20 OR eq > 1 THEN 'AMBIGUOUS' WHEN eq = 0 AND n > 1 THEN 'AMBIGUOUS' WHEN eq = 0 THEN 'CONFLICT' ELSE 'EXACT' END AS status,
              CASE WHEN n BETWEEN 1 AND 20 AND eq = 1 THEN hit END AS candidate FROM p""",
)
def _(t):
    docs = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("place"))
    from pyspark.sql.window import Window

    cand = t.customer.where("c_mktsegment = 'BUILDING'").select((F.col("c_custkey") % 50).alias("s_suppkey"), F.col("c_custkey").alias("candidate"), F.col("c_nationkey").alias("place"))
    cand = cand.withColumn("total", F.count("*").over(Window.partitionBy("s_suppkey")))
    return links.link_plan(docs, cand, "s_suppkey", ["place"]).select("s_suppkey", "status", "candidate")


@query(
    "h9_metadata_fields",
    """SELECT doc, name, value, coalesce(status, 'NOT_PROVIDED') AS status FROM (SELECT c_custkey::varchar AS doc, n AS name FROM customer, unnest(['label', 'segment']) AS u(n))
       LEFT JOIN (SELECT c_custkey::varchar AS doc, 'label' AS name, c_name AS value, 'PRESENT' AS status FROM customer UNION ALL SELECT c_custkey::varchar, 'segment', c_mktsegment, 'PRESENT' FROM customer WHERE c_mktsegment <> 'BUILDING') USING (doc, name)""",
)
def _(t):
    rows = t.customer.withColumn("seg", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")))
    got = fields.metadata_fields(rows, "c_custkey", {"label": "c_name", "segment": "seg"})
    return fields.complete(got, t.customer, "c_custkey", ["label", "segment"]).select("doc", "name", "value", "status")


@query(
    "h9_wide_fields",
    "SELECT c_custkey::varchar AS doc, c_name AS label, c_mktsegment AS segment FROM customer",
)
def _(t):
    return fields.wide(fields.metadata_fields(t.customer, "c_custkey", {"label": "c_name", "segment": "c_mktsegment"}), ["label", "segment"])


@query("h11_heading_anomalies", "SELECT c_custkey::varchar AS doc, 'LOGIC_REQUIRED' AS category, 'HEADING_WITHOUT_FIELD' AS code, 'segment' AS location FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(t):
    rows = t.customer.withColumn("seg", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")))
    got = fields.metadata_fields(rows, "c_custkey", {"segment": "seg"})
    heads = t.customer.select(F.col("c_custkey").cast("string").alias("doc"), F.explode(F.array(F.lit("SEG"), F.lit("other"))).alias("label"))
    return fields.anomalies(got, heads, {"SEG": "segment"})


@query(
    "w11_bounded_restore",
    """SELECT sha, n, running FROM (SELECT sha, n, (sum(n) OVER (ORDER BY sha))::BIGINT AS running FROM (
         SELECT sha, n FROM (SELECT sha256(text) AS sha, min(n_chars) AS n FROM documents GROUP BY 1) WHERE sha NOT IN (SELECT sha256(text) FROM documents WHERE source = 'src0') ORDER BY sha LIMIT 60)) WHERE running <= 90000""",
)
def _(t):
    from ..sources.backup import missing_blobs

    digest = F.sha2("text", 256).alias("sha256")
    want = t.documents.groupBy(digest).agg(F.min("n_chars").alias("size_bytes"))
    some = missing_blobs(want, t.documents.where("source = 'src0'").select(digest), 0, 60, 90_000)
    return some.select(F.col("sha256").alias("sha"), F.col("size_bytes").alias("n"), "running")


@query("l11_chronological", "SELECT doc_id, row_number() OVER (ORDER BY o_orderdate, doc_id) - 1 AS ordinal FROM documents JOIN orders ON doc_id = o_orderkey")
def _(t):
    dated = t.documents.join(t.orders, F.col("doc_id") == F.col("o_orderkey")).select("doc_id", "o_orderdate")
    return paging.numbered(dated, ["o_orderdate", "doc_id"]).select("doc_id", "ordinal")
