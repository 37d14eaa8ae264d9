"""The job queue and other state operators, over the test tables read as jobs, batches and pins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys
from ..operators import ledger, links, queue, reports, search, waves
from ..session import ship
from .registry import query

NOW = "1995-06-17 00:00:00"
_JOBS = """(SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'O' THEN 'QUEUED' ELSE 'RUNNING' END AS status, o_orderdate::TIMESTAMP AS created_at,
  o_orderdate::TIMESTAMP AS available_at, o_orderdate::TIMESTAMP + to_days((o_orderkey % 7)::INT) AS lease_until, (o_orderkey % 4)::INT AS failures, 3 AS max_attempts,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey - 1 END AS needs, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey + 1 END AS follow_up FROM orders)"""


def jobs(t):
    o, at = t.orders, F.col("o_orderdate").cast("timestamp")
    n = F.col("o_orderkey")
    return o.select(
        n.alias("job_id"),
        F.col("o_orderpriority").alias("kind"),
        F.when(F.col("o_orderstatus") == "F", "SUCCEEDED").when(F.col("o_orderstatus") == "O", "QUEUED").otherwise("RUNNING").alias("status"),
        at.alias("created_at"),
        at.alias("available_at"),
        F.timestamp_micros(F.unix_micros(at) + (n % 7) * 86_400_000_000).alias("lease_until"),
        F.lit(None).cast("string").alias("worker"),
        F.lit(1).alias("attempts"),
        (n % 4).cast("int").alias("failures"),
        F.lit(3).alias("max_attempts"),
        F.lit(None).cast("string").alias("error_code"),
        F.when(n % 3 == 0, n - 1).alias("needs"),
        F.when(n % 5 == 0, n + 1).alias("follow_up"),
    )


def now():
    return F.lit(NOW).cast("timestamp")


@query(
    "d29_expired_leases",
    f"""SELECT job_id, CASE WHEN lost AND failures + 1 >= max_attempts THEN 'FAILED' WHEN lost THEN 'QUEUED' ELSE status END AS status, (failures + lost::INT)::INT AS failures, CASE WHEN lost THEN 'LEASE_EXPIRED' END AS error_code
        FROM (SELECT *, status = 'RUNNING' AND lease_until <= TIMESTAMP '{NOW}' AS lost FROM {_JOBS})""",
)
def _(t):
    return queue.expired(jobs(t), now()).select("job_id", "status", "failures", "error_code")


_READY = f"""SELECT j.job_id, j.created_at FROM {_JOBS} j WHERE j.status = 'QUEUED' AND j.available_at <= TIMESTAMP '{NOW}' AND (j.needs IS NULL OR EXISTS (SELECT 1 FROM {_JOBS} d WHERE d.job_id = j.needs AND d.status IN ('SUCCEEDED', 'FAILED')
   AND (d.follow_up IS NULL OR EXISTS (SELECT 1 FROM {_JOBS} c WHERE c.job_id = d.follow_up AND c.status IN ('SUCCEEDED', 'FAILED')))))"""


@query("d28_ready_jobs", f"SELECT job_id FROM ({_READY})")
def _(t):
    return queue.ready(jobs(t), now()).select("job_id")


@query("d28_next_job", f"SELECT job_id FROM ({_READY}) ORDER BY created_at, job_id LIMIT 1")
def _(t):
    return queue.next_job(jobs(t).where("status <> 'RUNNING'"), now()).select("job_id")


@query("d30_drain_status", f"SELECT true AS draining, count(*) FILTER (status = 'RUNNING' AND NOT lease_until <= TIMESTAMP '{NOW}') AS running, count(*) FILTER (status = 'RUNNING' AND NOT lease_until <= TIMESTAMP '{NOW}') = 0 AS ready_to_stop FROM {_JOBS}")
def _(t):
    return queue.drain_status(jobs(t), now(), True)


@query("d30_workers_alive", "SELECT user_id AS worker FROM (SELECT user_id, max(ts) AS beat, (SELECT max(ts) FROM events) AS last FROM events GROUP BY user_id) WHERE user_id % 7 <> 0 AND beat > last - INTERVAL 60 SECOND")
def _(t):
    last = t.events.agg(F.max("ts")).first()[0]
    beats = t.events.groupBy(F.col("user_id").alias("worker")).agg(F.max("ts").alias("heartbeat_at"))
    workers = beats.withColumn("stopped_at", F.when(F.col("worker") % 7 == 0, F.col("heartbeat_at")))
    return queue.workers_alive(workers, F.lit(last).cast("timestamp")).select("worker")


@query("d71_bounded_parameters", "SELECT p_partkey, concat_ws(',', CASE WHEN p_size IS NULL OR p_size < 5 OR p_size > 40 THEN 'p_size' END, CASE WHEN p_retailprice IS NULL OR p_retailprice > 1500 THEN 'p_retailprice' END) AS invalid FROM part")
def _(t):
    return queue.bounded(t.part, {"p_size": (5, 40), "p_retailprice": (None, 1500)}).select("p_partkey", F.array_join("invalid", ",").alias("invalid"))


@query("d75_blob_keys", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'INVALID_STORAGE_KEY' ELSE 'VALID' END AS state FROM documents")
def _(t):
    digest = F.sha2("text", 256)
    good = F.concat(F.lit("blobs/"), F.left(digest, F.lit(2)), F.lit("/"), digest)
    key = F.when(F.col("doc_id") % 9 == 0, F.concat(good, F.lit("/../x"))).when(F.col("doc_id") % 9 == 3, F.upper(good)).when(F.col("doc_id") % 9 == 6, F.concat(F.lit("blobs/zz/"), digest)).otherwise(good)
    return t.documents.select("doc_id", keys.blob_key_state(key).alias("state"))


@query(
    "d47_reproved_links",
    """SELECT doc_id, CASE WHEN s.h IS NULL THEN 'NEW' WHEN f.h IS NULL THEN 'NOT_FOUND_AGAIN' WHEN s.h = f.h THEN 'SAME' ELSE 'EVIDENCE_DIFFERS' END AS state
       FROM (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 5 <> 0) s FULL JOIN (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE text END) AS h FROM documents WHERE doc_id % 4 <> 0) f USING (doc_id)""",
)
def _(t):
    d = t.documents
    stored = d.where("doc_id % 5 <> 0").select("doc_id", F.sha2("text", 256).alias("h"))
    found = d.where("doc_id % 4 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("text")), 256).alias("h"))
    return links.reproved(stored, found, ["doc_id"], ["h"])


@query(
    "d51_pending_manifests",
    """SELECT lang, count(*) AS references, 'image-manifest:' || sha256('{"references":[' || string_agg('{"doc_id":' || doc_id || ',"source":"' || source || '"}', ',' ORDER BY doc_id) || ']}') AS manifest_id FROM documents WHERE n_chars > 4000 GROUP BY lang""",
)
def _(t):
    open_ones = t.documents.where("n_chars > 4000").select("lang", "doc_id", "source")
    return ledger.pending_manifests(open_ones, ["lang"], ["doc_id"]).drop("body")


@query(
    "d50_pinned_inputs",
    "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'MISSING' ELSE concat_ws(',', CASE WHEN doc_id % 3 = 0 THEN 'sha256' END, CASE WHEN doc_id % 2 = 0 THEN 'size' END) END AS changed FROM documents",
)
def _(t):
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("size"))
    now_there = d.where("doc_id % 11 <> 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "other").otherwise(F.col("sha256")).alias("sha256"), F.when(F.col("doc_id") % 2 == 0, -1).otherwise(F.col("size")).alias("size"))
    return ledger.pinned(d, now_there, "doc_id", ["sha256", "size"]).select("doc_id", F.array_join("changed", ",").alias("changed"))


@query("d74_input_states", "SELECT doc_id, CASE WHEN strlen(text) > 5000 THEN 'IMPORT_INPUT_SIZE_LIMIT' WHEN doc_id % 4 = 0 THEN 'IMPORT_INPUT_HASH_MISMATCH' ELSE 'OK' END AS state FROM documents")
def _(t):
    digest = F.sha2("text", 256)
    wanted = F.when(F.col("doc_id") % 4 != 0, digest)
    return t.documents.select("doc_id", ledger.input_state(F.octet_length("text"), digest, wanted, 5000).alias("state"))


@query("d69_hit_items", "SELECT page_id, url AS display_title, CASE WHEN contains(lower(url), '/a') THEN 'current_reader_title' ELSE 'current_reader_html' END AS matched FROM pages WHERE contains(lower(url), '/a') OR contains(lower(html), '/a')")
def _(t):
    ship(t.pages.sparkSession)
    return search.hit_items(t.pages, "/A", "url", "html").select("page_id", "display_title", F.element_at("matched_columns", 1).alias("matched"))


@query(
    "d41_baseline",
    """WITH m AS (SELECT lang, count(*) AS rows, count(*) FILTER (n_chars > 1000) AS long, count(*) FILTER (source = 'src0') AS hot, count(DISTINCT source) AS sources, false AS total FROM documents GROUP BY lang
                  UNION ALL SELECT NULL, count(*), count(*) FILTER (n_chars > 1000), count(*) FILTER (source = 'src0'), count(DISTINCT source), true FROM documents)
       SELECT lang, total, measure, n FROM (UNPIVOT m ON rows, long, hot, sources INTO NAME measure VALUE n)""",
)
def _(t):
    tests = {"long": F.col("n_chars") > 1000, "hot": F.col("source") == "src0"}
    return reports.baseline(t.documents, ["lang"], tests, {"sources": F.col("source")})


@query(
    "d45_source_differences",
    """SELECT doc_id, CASE WHEN o.doc_id IS NULL THEN 'THEIRS_ONLY' WHEN s.doc_id IS NULL THEN 'OURS_ONLY' WHEN o.lang IS DISTINCT FROM s.lang OR o.source IS DISTINCT FROM s.source THEN 'DIFFERENT' ELSE 'SAME' END AS state,
              concat_ws(',', CASE WHEN o.doc_id IS NOT NULL AND s.doc_id IS NOT NULL AND o.lang IS DISTINCT FROM s.lang THEN 'lang' END, CASE WHEN o.doc_id IS NOT NULL AND s.doc_id IS NOT NULL AND o.source IS DISTINCT FROM s.source THEN 'source' END) AS differing
       FROM (SELECT doc_id, lang, source FROM documents WHERE doc_id % 5 <> 0) o FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang END AS lang, CASE WHEN doc_id % 3 = 0 THEN 'other' ELSE source END AS source FROM documents WHERE doc_id % 4 <> 0) s USING (doc_id)""",
)
def _(t):
    d = t.documents.select("doc_id", "lang", "source")
    theirs = d.where("doc_id % 4 <> 0").select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 3 == 0, "other").otherwise(F.col("source")).alias("source"))
    return reports.source_differences(d.where("doc_id % 5 <> 0"), theirs, "doc_id", ["lang", "source"]).select("doc_id", "state", F.array_join(F.coalesce("differing", F.expr("cast(array() as array<string>)")), ",").alias("differing"))


@query("d61_registered", "SELECT user_id, event_id, CASE WHEN event_type IN ('signup', 'purchase') THEN ts END AS ts FROM events")
def _(t):
    e = t.events
    registry = e.select("event_id", "ts", F.to_json(F.struct(F.col("event_type").alias("kind"))).alias("metadata"))
    return reports.registered(e.select("user_id", "event_id"), registry, "event_id", ["ts"], ["signup", "purchase"]).select("user_id", "event_id", "ts")


@query("d33_staged_jobs", "SELECT doc_id::VARCHAR AS item, kind, doc_id || ':' || kind AS job_id, CASE WHEN prior IS NOT NULL THEN doc_id || ':' || prior END AS needs FROM documents, (VALUES ('FETCH', NULL), ('IMAGES', 'FETCH'), ('REFRESH', 'IMAGES'), ('ENRICH', 'REFRESH'), ('FIELDS', 'ENRICH')) AS v(kind, prior)")
def _(t):
    return waves.staged(t.documents, "doc_id")


@query("d62_open_batches", "SELECT DISTINCT source AS batch, 'v2' AS input FROM documents WHERE source NOT IN ('src1', 'src3')")
def _(t):
    plan = t.documents.select(F.col("source").alias("batch"), F.lit("v2").alias("input")).distinct()
    done = plan.withColumn("status", F.when(F.col("batch") == "src2", "FAILED").otherwise("SUCCEEDED")).withColumn("input", F.when(F.col("batch") == "src0", "v1").otherwise("v2"))
    return waves.open_batches(plan, done.where("batch in ('src0', 'src1', 'src2', 'src3')"))
