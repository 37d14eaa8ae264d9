"""Versions, receipts, staging, writers, readers and forms of siblings over the test tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import hashes
from ..operators import documents, ledger, paging, revisions
from ..operators.sinks import read_sink
from ..session import ship
from ..sources import backup, tables
from ..storage import scratch_path
from .registry import query


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def expected(columns: str, rows) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS v({columns})"


def listed(x: Column) -> Column:
    return F.array_join(x, ",")


# -- versions, receipts, staging ----------------------------------------------


@query("d10_insert_versions", "SELECT source, doc_id::VARCHAR AS id, sha256(text) AS sha256 FROM documents WHERE doc_id % 3 <> 0 GROUP BY ALL")
def _(t):
    d = t.documents.select("source", F.col("doc_id").cast("string").alias("id"), F.col("text").alias("body"), F.lit(1).alias("received_at"))
    have = d.where("id % 3 = 0").select("source", "id", F.sha2("body", 256).alias("sha256"))
    fresh, _ = revisions.preserve(have, d.unionByName(d))
    return fresh.drop("body")


@query("d19_receipts", "SELECT source, count(*) AS n, count(DISTINCT doc_id) AS ids FROM documents GROUP BY source")
def _(t):
    d = t.documents.select("source", F.col("doc_id").cast("string").alias("id"), F.col("text").alias("body"), F.lit(1).alias("received_at"))
    _, receipts = revisions.preserve(d.limit(0).select("source", "id", F.lit("").alias("sha256")), d)
    return receipts.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("receipt_id").alias("ids"))


@query("d11_find_documents", "SELECT source, lang, CASE WHEN n = 1 THEN 'FOUND' WHEN n IS NULL THEN 'NOT_FOUND' ELSE 'NOT_UNIQUE' END AS state FROM (SELECT DISTINCT source FROM documents) CROSS JOIN (VALUES ('en'), ('xx')) AS l(lang) LEFT JOIN (SELECT source, lang, count(DISTINCT doc_id) AS n FROM documents GROUP BY ALL) USING (source, lang)")
def _(t):
    d = t.documents.withColumnRenamed("doc_id", "doc")
    wanted = d.select("source").distinct().select("source", F.explode(F.array(F.lit("en"), F.lit("xx"))).alias("lang"))
    return revisions.find(d, wanted, ["source", "lang"]).select("source", "lang", "state")


@query("d12_snapshot_prefix", expected("n, is_prefix", [(0, True), (1, False), (2, True)]))
def _(t):
    log = t.events.select(F.col("event_id").alias("sequence"), "user_id")
    shots = [log.where("sequence <= 40"), log.where("sequence <= 40 and sequence <> 7"), log.limit(0)]
    out = [revisions.is_prefix(s, log).select(F.lit(n).alias("n"), "is_prefix") for n, s in enumerate(shots)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("d54_replayed", "SELECT doc_id::VARCHAR AS url, CASE WHEN doc_id % 5 = 0 THEN 'NO_RECEIPT' WHEN doc_id % 5 = 1 THEN 'BAD_STATUS' WHEN doc_id % 5 = 2 THEN 'BODY_MISSING' WHEN doc_id % 5 = 3 THEN 'BODY_CHANGED' ELSE 'REPLAYED' END AS state FROM documents")
def _(t):
    d = t.documents.select(F.col("doc_id"), F.col("doc_id").cast("string").alias("url"), F.concat_ws(":", F.col("doc_id").cast("string"), "text").alias("body"))
    r = d.where("doc_id % 5 <> 0").select("url", F.when(F.col("doc_id") % 5 == 1, 500).otherwise(200).alias("status"), F.sha2("body", 256).alias("sha256"), F.lit(2).alias("received_at"))
    older = r.withColumn("received_at", F.lit(1)).withColumn("status", F.lit(404))
    blobs = d.where("doc_id % 5 <> 2").select(F.sha2("body", 256).alias("sha256"), F.when(F.col("doc_id") % 5 == 3, "other").otherwise(F.col("body")).alias("body"))
    return revisions.replay(d.select("url"), r.unionByName(older), blobs).select("url", "state")


@query("d20_staging", "SELECT source, count(*) AS rows, count(*) FILTER (n_chars > 500 AND lang <> 'fr') AS staged, count(*) FILTER (NOT (n_chars > 500 AND lang <> 'fr')) AS failed FROM documents GROUP BY source")
def _(t):
    return revisions.batch_totals(revisions.stage(t.documents, [("TOO_SHORT", F.col("n_chars") > 500), ("LANGUAGE", F.col("lang") != "fr")]), "source")


@query("d20_failure_codes", "SELECT doc_id, CASE WHEN NOT n_chars > 500 THEN 'TOO_SHORT' WHEN lang = 'fr' THEN 'LANGUAGE' END AS code FROM documents")
def _(t):
    return revisions.stage(t.documents, [("TOO_SHORT", F.col("n_chars") > 500), ("LANGUAGE", F.col("lang") != "fr")]).select("doc_id", "code")


@query("d46_integrity", "SELECT doc_id::VARCHAR AS doc, CASE doc_id % 4 WHEN 0 THEN 'NO_HASH:text' WHEN 1 THEN 'MISSING:text' WHEN 2 THEN 'CHANGED:text' ELSE '' END AS reasons FROM documents")
def _(t):
    body = F.concat_ws(":", F.col("doc_id").cast("string"), "text")
    d = t.documents.select("doc_id", body.alias("body"))
    manifests = d.select(F.col("doc_id").cast("string").alias("doc"), F.when(F.col("doc_id") % 4 != 0, F.sha2("body", 256)).alias("text_sha256"))
    blobs = d.where("doc_id % 4 <> 1").select(F.sha2("body", 256).alias("sha256"), F.when(F.col("doc_id") % 4 == 2, "other").otherwise(F.col("body")).alias("body"))
    return revisions.integrity(manifests, blobs, ["text"]).select("doc", listed(F.col("reasons")).alias("reasons"))


@query("d55_chained_revisions", "SELECT conv_id AS root, coalesce(arg_max(turn, struct_pack(a := turn % 3, b := turn)) FILTER (role = 'assistant'), -1)::BIGINT AS revision FROM conversations GROUP BY conv_id")
def _(t):
    c = t.conversations.select(F.col("conv_id").alias("root"), F.col("turn").cast("bigint").alias("revision"), "role")
    asked = c.select("root").distinct().withColumn("revision", F.lit(-1).cast("bigint"))
    return revisions.chain_revision(asked, c.where("role = 'assistant'").withColumn("created_at", F.col("revision") % 3)).select("root", "revision")


@query("d24_build_keys", "SELECT count(DISTINCT struct_pack(a := lang, b := source)) AS builds, count(*) AS rows FROM documents")
def _(t):
    return revisions.build_revision(t.documents, "rules-1", ["lang", "source"]).agg(F.countDistinct("build").alias("builds"), F.count("*").alias("rows"))


# -- writers and readers of the shared folder ------------------------------------


@query("w1_publish", "SELECT doc_id, lang FROM documents")
def _(t):
    return tables.publish(t.documents.select("doc_id", "lang"), scratch_path(t.pages.sparkSession, "publish"), 64)


@query("w5_content_addressed", "SELECT sha256(text) AS sha256, length(any_value(text))::BIGINT AS n FROM documents GROUP BY 1")
def _(t):
    store = scratch_path(t.pages.sparkSession, "blobs")
    bodies = t.documents.select(F.col("text").alias("body"))
    revisions.put_blobs(bodies.limit(20), store)
    stored = revisions.put_blobs(bodies, store)  # present ones are not written again
    return stored.select("sha256", F.length("body").cast("bigint").alias("n"))


@query("w3_fan_out", "SELECT doc_id, w AS word FROM (SELECT doc_id, unnest(string_split(source || ' ' || lang, ' ')) AS w FROM documents)")
def _(t):
    spark = t.pages.sparkSession
    path = scratch_path(spark, "fan")
    words = F.transform(F.split(F.concat_ws(" ", "source", "lang"), " "), lambda w: F.struct(w.alias("word")))
    revisions.fan_out(t.documents.select("doc_id", words.alias("words")), {"words": "words"}, path)
    return read_sink(spark, path, "words", "doc_id long, word string")


@query("w10_backup", expected('"table", rows, state', [("region", 5, "VERIFIED"), ("nation", 25, "VERIFIED")]))
def _(t):
    spark = t.pages.sparkSession
    target = scratch_path(spark, "backup")
    listed_there = backup.backup(spark, {n: f"{t._folder}/{n}.parquet" for n in ("region", "nation")}, target)
    return listed_there.select("table", "rows").join(backup.verify(spark, target), "table")


@query("r9_json_rows", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def _(t):
    spark = t.pages.sparkSession
    path = scratch_path(spark, "json")
    t.documents.select("doc_id", "text", F.sha2("text", 256).alias("sha256")).write.json(path)
    return tables.json_rows(spark, path, T.StructType.fromDDL("doc_id long, text string, sha256 string"), "doc_id", "text", "sha256").drop("text")


@query("r10_csv_rows", "SELECT page_id, url FROM pages")
def _(t):
    spark = t.pages.sparkSession
    path = scratch_path(spark, "csv")
    t.pages.select("page_id", "url").write.option("header", True).csv(path)
    return tables.csv_rows(spark, path, T.StructType.fromDDL("page_id long, url string"))


@query("r11_text_files", "SELECT count(*) AS lines, count(DISTINCT c_custkey) AS keys FROM customer")
def _(t):
    spark = t.pages.sparkSession
    path = scratch_path(spark, "text")
    t.customer.select(F.col("c_custkey").cast("string")).repartition(3).write.text(path)
    lines = tables.text_files(spark, path, "part-*").select(F.explode(F.split(F.trim("text"), "\n")).alias("line"))
    return lines.where("trim(line) <> ''").agg(F.count("*").alias("lines"), F.countDistinct(F.trim(F.regexp_replace("line", r"\s", ""))).alias("keys"))


# -- counts and forms of siblings -------------------------------------------------


@query("j2_artifact_blobs", "SELECT d.doc_id, length(b.text)::BIGINT AS size FROM documents d JOIN (SELECT sha256(text) AS h, any_value(text) AS text FROM documents GROUP BY 1) b ON sha256(d.text) = b.h")
def _(t):
    artifacts = t.documents.select("doc_id", F.sha2("text", 256).alias("sha256"))
    blobs = t.documents.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.length(F.any_value("text")).cast("bigint").alias("size"))
    return artifacts.join(blobs, "sha256").select("doc_id", "size")


@query("j8_using_joins", "SELECT o_orderkey, l_linenumber, p_brand FROM (SELECT o_orderkey AS k, o_orderkey FROM orders) JOIN (SELECT l_orderkey AS k, l_linenumber, l_partkey AS p FROM lineitem) USING (k) JOIN (SELECT p_partkey AS p, p_brand FROM part) USING (p)")
def _(t):
    o = t.orders.select(F.col("o_orderkey").alias("k"), "o_orderkey")
    li = t.lineitem.select(F.col("l_orderkey").alias("k"), "l_linenumber", F.col("l_partkey").alias("p"))
    return o.join(li, "k").join(t.part.select(F.col("p_partkey").alias("p"), "p_brand"), "p").select("o_orderkey", "l_linenumber", "p_brand")


@query("a2_group_count", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def _(t):
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"))


@query("a9_rows_with", "SELECT count(*) AS rows, count(*) FILTER (n_chars > 1000) AS rows_with_long, sum(n_chars)::BIGINT AS chars FROM documents")
def _(t):
    return t.documents.agg(F.count("*").alias("rows"), F.count_if(F.col("n_chars") > 1000).alias("rows_with_long"), F.sum("n_chars").alias("chars"))


@query("a24_reconciled", "SELECT count(*) AS rows FROM documents")
def _(t):
    ledger.require_none(t.documents.where("doc_id is null"), "NULL_ID")
    return t.documents.agg(F.count("*").alias("rows"))


@query("v6_latest_receipt", "SELECT event_type AS wave, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS receipt FROM events GROUP BY event_type")
def _(t):
    from ..operators import latest

    return latest.latest_per_key(t.events.select(F.col("event_type").alias("wave"), F.col("event_id").alias("receipt"), "ts"), ["wave"], [F.desc("ts"), F.desc("receipt")]).drop("ts")


@query("l12_candidate_slice", "SELECT doc_id, false AS exhausted FROM documents ORDER BY doc_id LIMIT 10 OFFSET 30")
def _(t):
    rows = paging.page(t.documents.select("doc_id"), [F.asc("doc_id")], 30, 11).withColumn("k", F.monotonically_increasing_id())
    some = paging.top(rows, [F.asc("doc_id")], 10).drop("k")
    left = t.documents.count() > 40
    return some.withColumn("exhausted", F.lit(not left))


@query("d3_sorted_delta", "SELECT event_id, user_id FROM (SELECT event_id, user_id, lag(user_id) OVER (ORDER BY event_id) AS prior FROM events) WHERE user_id <= prior")
def _(t):
    from ..operators import delta

    return delta.validate_sorted(t.events.select("event_id", F.col("user_id").alias("source_id")), "event_id").select("event_id", F.col("source_id").alias("user_id"))


@query("f23_content_revisions", "SELECT count(DISTINCT struct_pack(a := text, b := lang)) AS revisions FROM documents")
def _(t):
    return t.documents.select(hashes.record_hash({"text": F.col("text"), "lang": F.col("lang")}).alias("h")).agg(F.countDistinct("h").alias("revisions"))


@query("f27_snapshot_keys", "SELECT 1::BIGINT AS keys, 64::INT AS length")
def _(t):
    key = hashes.snapshot_key(t.documents)
    return key.agg(F.countDistinct("snapshot_key").alias("keys"), F.max(F.length("snapshot_key")).alias("length"))


@query("d48_positional_links", "SELECT user_id, event_id AS position, CASE WHEN event_id % 3 = 0 THEN 'RIGHT_ONLY' WHEN event_id % 5 = 0 THEN 'LEFT_ONLY' ELSE 'PAIRED' END AS pairing FROM events WHERE event_id % 15 <> 0")
def _(t):
    e = t.events.select("user_id", F.col("event_id").alias("position"))
    a, b = e.where("position % 3 <> 0").withColumn("old", F.lit(1)), e.where("position % 5 <> 0").withColumn("new", F.lit(1))
    return documents.positional_join(a, b, ["user_id", "position"]).select("user_id", "position", "pairing")


#: Operation, entity, target and key of each customer's events; customers of the first segment lack the fourth.
_EVENTS = [("CREATE", "a", None, "k1"), ("CREATE", "b", None, "k2"), ("CREATE", "c", None, "k1"), ("MERGE", "a", "b", None), ("SPLIT", "b", "d", "k1"), ("RELINK", None, "b", "k1"), ("RELINK", None, "b", "k9"), ("CREATE", "a", None, "k3"), ("SPLIT", "b", "a", "k2")]


@query(
    "d9_replay_cases",
    """SELECT c_custkey AS component, unnest(['a', 'b', 'd']) AS entity, unnest(['MERGED', 'ACTIVE', 'ACTIVE']) AS state, unnest(['b', '', '']) AS merged_into, unnest(['', 'k1,k2', '']) AS keys, 4::BIGINT AS rejected FROM customer WHERE c_mktsegment <> 'BUILDING'
       UNION ALL SELECT c_custkey, unnest(['a', 'b']), 'ACTIVE', '', unnest(['', 'k1,k2']), 5 FROM customer WHERE c_mktsegment = 'BUILDING'""",
)
def _(t):
    from ..operators import identity

    ship(t.customer.sparkSession)
    text = lambda x: F.lit(x).cast("string")
    events = F.array(*[F.struct(F.lit(k).alias("sequence"), *[text(x).alias(n) for x, n in zip(e, ("operation", "entity", "target", "key"), strict=True)]) for k, e in enumerate(_EVENTS)])
    rows = t.customer.select(F.col("c_custkey").alias("component"), "c_mktsegment", F.inline(events))
    return identity.replay(rows.where("not (c_mktsegment = 'BUILDING' and sequence = 3)").drop("c_mktsegment"))
