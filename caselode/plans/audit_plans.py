"""Readers, writers, preparations and audits over the test tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import cells
from ..functions import html as H
from ..functions import markup as M
from ..operators import case_fields, contracts, coverage, documents, fields, images, ledger, links, profile, quality, reports, revisions
from ..session import ship
from ..sources import details, tables, windows
from ..sources.listing import HttpStatus
from ..sources.migrations import Step, migrate
from ..sources.versions import Tables
from ..storage import materialize, scratch_path
from .markup_plans import _LONG, ORDERS, cases, made, of_customers, of_orders, of_pages, pages
from .registry import query
from .store_plans import _served

# -- readers -----------------------------------------------------------------------


@query("r7_described", "SELECT (row_number() OVER () - 1)::INT AS position, column_name AS name FROM (DESCRIBE documents)")
def _(t):
    return tables.described(t.documents).select("position", "name")


_REGISTRY = "SELECT sha256('text: ' || text) AS sha256, min(doc_id) AS doc_id FROM documents GROUP BY 1"


@query("r12_verified_blobs", f"SELECT sha256, CASE doc_id % 5 WHEN 0 THEN 'MISSING' WHEN 1 THEN 'BLOB_INTEGRITY_FAILED' ELSE 'VERIFIED' END AS state FROM ({_REGISTRY})")
def _(t):
    """Texts as content-addressed files; some are gone, some hold other bytes than they are named by."""
    ship(t.documents.sparkSession)
    folder = scratch_path(t.documents.sparkSession, "blobs")
    texts = t.documents.select("doc_id", F.concat(F.lit("text: "), "text").alias("text"))  # Spark lists no empty files
    registry = texts.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min("doc_id").alias("doc_id"), F.max(F.octet_length("text")).cast("bigint").alias("size_bytes"), F.any_value("text").alias("text"))
    body = F.when(F.col("doc_id") % 5 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    materialize(tables.put_files(registry.where("doc_id % 5 <> 0").withColumn("body", body), "sha256", "body", folder), "put")
    return tables.verified_blobs(t.documents.sparkSession, folder, registry.select("sha256", "size_bytes")).select("sha256", "state")


@query("w5_files_once", f"SELECT count(*)::BIGINT AS files, 0::BIGINT AS again FROM ({_REGISTRY})")
def _(t):
    """What is stored is not written a second time."""
    ship(t.documents.sparkSession)
    folder, texts = scratch_path(t.documents.sparkSession, "blobs"), t.documents.select("text").distinct().withColumn("sha256", F.sha2("text", 256))
    first, second = (materialize(tables.put_files(texts, "sha256", "text", folder), "put") for _ in range(2))
    written = lambda df, name: df.agg(F.count_if("written").alias(name))
    return written(first, "files").join(written(second, "again"))  # one row each


def told_detail(url: str) -> bytes:
    """A transport for the query: details by number, some of them wrong."""
    ident = int(url.rsplit("/", 1)[1])
    if ident % 10 == 1:
        raise HttpStatus(404)
    if ident % 10 == 2:
        return f"<detail><id>{ident + 1}</id><body>x</body></detail>".encode()
    if ident % 10 == 3:
        return json.dumps({"id": ident, "body": "  "}).encode()
    if ident % 10 == 4:
        return b'{"id": 1, "id": 1}'
    return f"<detail><id>{ident}</id><body>body {ident}</body><court>c</court></detail>".encode()


@query("r18_details", "SELECT doc_id::VARCHAR AS id, CASE doc_id % 10 WHEN 1 THEN 'HTTP_404' WHEN 2 THEN 'DETAIL_ID_MISMATCH' WHEN 3 THEN 'DETAIL_BODY_EMPTY' WHEN 4 THEN 'UNREADABLE' ELSE 'OK' END AS state, CASE WHEN doc_id % 10 NOT IN (1, 2, 3, 4) THEN 'body ' || doc_id END AS body FROM documents")
def _(t):
    ship(t.documents.sparkSession)
    got = details.details(t.documents, "doc_id", "caselode.plans.audit_plans:told_detail", "x/{id}", "id", "body")
    return got.select("id", "state", F.when(F.col("state") == "OK", F.col("body")).alias("body"))


_TRIED: dict[str, int] = {}


def told_at_last(url: str) -> bytes:
    """A transport for the query that answers some ids only when they are asked a third time, and some never."""
    ident = int(url.rsplit("/", 1)[1])
    _TRIED[url] = _TRIED.get(url, 0) + 1
    if ident % 50 == 1 or (ident % 50 == 2 and _TRIED[url] % 3):
        raise HttpStatus(503)
    if ident % 50 == 3:
        raise HttpStatus(400)
    return json.dumps({"detail": {"id": ident, "body": f"at try {_TRIED[url]}", "n": 1}}).encode()


@query("r16_retried_details", "SELECT doc_id::VARCHAR AS id, CASE doc_id % 50 WHEN 1 THEN 'HTTP_503' WHEN 3 THEN 'HTTP_400' ELSE 'OK' END AS state, CASE WHEN doc_id % 50 NOT IN (1, 3) THEN '{\"id\": ' || doc_id || ', \"n\": 1}' END AS metadata FROM documents")
def _(t):
    ship(t.documents.sparkSession)
    got = details.details(t.documents, "doc_id", "caselode.plans.audit_plans:told_at_last", "x/{id}", "id", "body", pause=0)
    return got.select("id", "state", "metadata")


def told_html(url: str) -> bytes:
    """A transport for the query: frames and articles by number."""
    kind, ident = url.split("/")[-2:]
    n = int(ident)
    if n % 20 == 3:
        return b"\xff\xfe<p>"
    if n % 20 == 4:
        return b"no tags"
    if n % 20 == 5 and kind == "frame":
        return b"<p>" + b"x" * details.CAP
    return f"<input id=precSeq value={n}><input id=precYd value=20010203><p>{kind}</p>".encode()


@query(
    "r20_provider_pages",
    """SELECT page_id::VARCHAR AS id, e AS endpoint, CASE WHEN page_id % 20 IN (3, 4) THEN 'NOT_HTML' WHEN page_id % 20 = 5 AND e = 'frame' THEN 'BODY_SIZE_LIMIT' ELSE 'OK' END AS state,
              CASE WHEN page_id % 20 NOT IN (3, 4) AND NOT (page_id % 20 = 5 AND e = 'frame') THEN page_id::VARCHAR END AS source_id FROM pages, (SELECT unnest(['frame', 'article']) AS e)""",
)
def _(t):
    """Frames and articles of each page, and what a frame says of itself."""
    ship(t.pages.sparkSession)
    got = details.html_pages(t.pages, "page_id", "caselode.plans.audit_plans:told_html", {"frame": "x/frame/{id}", "article": "x/article/{id}"})
    return got.select("id", "endpoint", "state", F.when(F.col("state") == "OK", M.frame_links_udf("go")(F.col("html"))["source_id"]).alias("source_id"))


@query("r19_replayed_pages", "SELECT url, CASE min(page_id) % 4 WHEN 0 THEN 'BODY_CHANGED' WHEN 1 THEN 'BAD_STATUS' ELSE 'REPLAYED' END AS state FROM pages GROUP BY url")
def _(t):
    """The newest of two receipts of each URL decides, and only with the body that it names."""
    p = t.pages.groupBy("url").agg(F.min("page_id").alias("page_id"), F.min_by("html", "page_id").alias("body"))
    body = F.concat_ws("|", "url", "body")
    receipts = p.select("url", F.when(F.col("page_id") % 4 == 1, 500).otherwise(200).alias("status"), F.sha2(body, 256).alias("sha256"), F.lit(2).alias("received_at"))
    older = receipts.withColumn("status", F.lit(404)).withColumn("received_at", F.lit(1))
    blobs = p.select(F.sha2(body, 256).alias("sha256"), F.when(F.col("page_id") % 4 == 0, "other").otherwise(body).alias("body"))
    return revisions.replay(p.select("url"), receipts.unionByName(older), blobs).select("url", "state")


_IMAGE = "CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN '00112233' WHEN 2 THEN '89504E470D0A1A0A' ELSE concat('89504E470D0A1A0A0000000D49484452', lpad(hex(n_chars * CASE WHEN doc_id % 6 = 3 THEN 100 ELSE 1 END), 8, '0'), lpad(hex(n_chars * 10), 8, '0')) END"


@query(
    "r21_image_states",
    "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'IMAGE_EMPTY' WHEN 1 THEN 'IMAGE_TYPE_UNKNOWN' WHEN 2 THEN 'IMAGE_TRUNCATED' ELSE CASE WHEN n_chars = 0 OR n_chars * CASE WHEN doc_id % 6 = 3 THEN 100 ELSE 1 END * n_chars * 10 > 25000000 THEN 'IMAGE_DIMENSIONS' ELSE 'OK' END END AS state, CASE WHEN doc_id % 6 > 2 THEN n_chars * CASE WHEN doc_id % 6 = 3 THEN 100 ELSE 1 END END AS width FROM documents",
)
def _(t):
    content = F.unhex(F.expr(_IMAGE))
    return t.documents.select("doc_id", images.image_state(content).alias("state"), images.dimensions(content)["width"].alias("width"))


@query("d68_listing_sample", "SELECT event_id::VARCHAR AS id FROM (SELECT event_id, ts, min(ts::DATE) OVER () AS first FROM events) WHERE ts::DATE < first + 7 ORDER BY event_id LIMIT 20")
def _(t):
    """The first rows of one window's pages, whose total and ids were checked."""
    options, spark = _served(t), t.events.sparkSession
    spark.dataSource.register(windows.WindowedListing)
    week = windows.windows(*map(windows.date.fromisoformat, (options["from"], options["to"])), 7)[0]
    rows = spark.read.format("windowed_listing").options(**options | {"to": week.last.isoformat()}).load()
    return rows.orderBy(F.col("id").cast("bigint")).limit(20).select("id")


# -- writers -----------------------------------------------------------------------


@query("w2_wide_fields", of_customers("SELECT count(*)::BIGINT AS rows, 61::BIGINT AS columns, count(*) FILTER (k < 2)::BIGINT AS with_docket FROM p"))
def _(t):
    """Sixty fields as columns, written and read back equal."""
    spark = t.customer.sparkSession
    back = tables.publish(case_fields.wide_case_fields(cases(t)), scratch_path(spark, "wide"))
    return back.agg(F.count("*").alias("rows"), F.lit(len(back.columns)).cast("bigint").alias("columns"), F.count("case_no").alias("with_docket"))


@query("w4_published_once", "SELECT count(*)::BIGINT AS rows, round(sum(o_totalprice), 1) AS total, true AS refused FROM orders")
def _(t):
    """A table appears whole, and never in the place of another."""
    spark, path = t.orders.sparkSession, scratch_path(t.orders.sparkSession, "published")
    back = tables.publish(t.orders, path, rows_per_file=5000)
    try:
        tables.publish(t.orders, path)
        refused = False
    except Exception:  # noqa: BLE001 - Spark's own error for a path that exists
        refused = True
    return back.agg(F.count("*").alias("rows"), F.round(F.sum("o_totalprice"), 1).alias("total")).withColumn("refused", F.lit(refused))


@query("w7_saved_versions", "SELECT source, count(DISTINCT text)::BIGINT AS versions, 2 * count(*)::BIGINT AS receipts FROM documents GROUP BY source")
def _(t):
    """Each response has its receipt; each body of a source is a version once."""
    d = t.documents.select("source", F.col("source").alias("id"), F.col("text").alias("body"), F.lit(1).alias("received_at"))
    twice = d.unionByName(d.withColumn("received_at", F.lit(2)))
    fresh, receipts = revisions.preserve(d.limit(0).select("source", "id", F.lit("").alias("sha256")), twice)
    return fresh.groupBy("source").agg(F.count("*").alias("versions")).join(receipts.groupBy("source").agg(F.count("*").alias("receipts")), "source")


@query("w8_saved_manifests", "SELECT lang, count(*)::BIGINT AS references, true AS named_by_content FROM documents WHERE n_chars > 3000 GROUP BY lang")
def _(t):
    """Manifests of large documents in a content-addressed store, found by their names."""
    spark = t.documents.sparkSession
    wanted = ledger.pending_manifests(t.documents.where("n_chars > 3000").select("lang", "doc_id"), ["lang"], ["doc_id"])
    stored = revisions.put_blobs(wanted.select("body"), scratch_path(spark, "manifests"))
    found = wanted.withColumn("sha256", F.split_part("manifest_id", F.lit(":"), F.lit(2))).join(stored.select("sha256", F.col("body").alias("kept")), "sha256")
    return found.select("lang", "references", (F.sha2("kept", 256) == F.col("sha256")).alias("named_by_content"))


@query("w12_migrated", "SELECT o_orderpriority AS priority, count(*)::BIGINT AS orders, round(sum(o_totalprice), 1) AS total, 3::BIGINT AS applied, 0::BIGINT AS again FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL")
def _(t):
    """Three numbered changes of a table; a second run finds all of them in the history."""
    spark = t.orders.sparkSession
    store = Tables(spark, scratch_path(spark, "migrated"))
    steps = [
        Step(1, "load", "orders", "all orders", lambda _: t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")),
        Step(2, "rename", "orders", "o_orderpriority is priority", lambda df: df.withColumnRenamed("o_orderpriority", "priority")),
        Step(3, "trim", "orders", "without status P", lambda df: df.where("o_orderstatus <> 'P'")),
    ]
    applied, again = len(migrate(store, steps)), len(migrate(store, steps))
    out = store.pin().table("orders").groupBy("priority").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 1).alias("total"))
    return out.select("*", F.lit(applied).cast("bigint").alias("applied"), F.lit(again).cast("bigint").alias("again"))


@query(
    "d72_changed_rows",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 8 THEN 'X' WHEN o_orderstatus = 'P' THEN 'U' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 100 = 8 THEN 0 ELSE o_totalprice END AS price,
              (SELECT count(*) FROM orders WHERE o_orderstatus = 'P')::BIGINT AS returned, (SELECT count(*) FROM orders WHERE o_orderkey % 10 = 7)::BIGINT AS deleted FROM orders WHERE o_orderkey % 10 <> 7""",
)
def _(t):
    """INSERT ... SELECT, UPDATE ... RETURNING, DELETE and an upsert on a versioned table, published as one version."""
    spark = t.orders.sparkSession
    store = Tables(spark, scratch_path(spark, "changed"))
    rows = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    first = store.change()
    first.replace("orders", rows.where("status <> 'P'"))
    first.publish()
    change = store.change()
    change.append("orders", rows.where("status = 'P'"))
    returned = change.update("orders", F.col("status") == "P", {"status": F.lit("U")})
    deleted = change.delete("orders", F.col("o_orderkey") % 10 == 7)
    change.upsert("orders", rows.where("o_orderkey % 100 = 8").withColumn("status", F.lit("X")).withColumn("price", F.lit(0.0)), ["o_orderkey"])
    change.publish()
    return store.pin().table("orders").select("*", F.lit(returned.count()).cast("bigint").alias("returned"), F.lit(deleted).cast("bigint").alias("deleted"))


# -- fields, links and images ----------------------------------------------------------


@query("h10_parties_and_judges", of_pages("""SELECT page_id, '{"원고":"' || w || '","피고":"' || i || '"}' AS parties, '대법관' AS role, w || '(재판장)' AS names FROM p"""))
def _(t):
    page = "concat('<p>【원고】 다른 이</p><p>【피고】 ', i, '</p><p>【원고】 ', w, '</p><p>【주 문】 기각</p><p>대법관 ', w, '(재판장)</p>')"
    parse = H.page_sections_udf(["주문"], [], fields.PARTY)
    seen = pages(t, page).select("page_id", parse(F.col("page")).alias("x"))
    signed = fields.signature(F.col("x.visible"))
    return seen.select("page_id", F.to_json(fields.by_label(F.col("x.visible"), fields.parties_in(F.col("x.sections")))).alias("parties"), signed["role"].alias("role"), signed["names"].alias("names"))


_WITH_IMAGE = f"""concat(w, {_LONG}, '<img src="x', i, '.png">', {_LONG})"""


@query(
    "h19_image_links",
    of_pages(
        f"""SELECT page_id AS source, sha256(sha256({_WITH_IMAGE}) || ':' || a || ':' || (a + 17 + length(i))) AS legacy_reference, sha256(sha256('<p>' || {_WITH_IMAGE}) || ':' || (a + 3) || ':' || (a + 20 + length(i))) AS current_reference
            FROM (SELECT *, length(w) + length({_LONG}) AS a FROM p)"""
    ),
)
def _(t):
    """Images of an old and a new page that stand for each other, with the ids of both places."""
    near = lambda page: documents.tag_occurrences(pages(t, page), "page_id", "page", "img").select(F.col("page_id").alias("source"), F.col("target").alias("file"), F.right("before", F.lit(30)).alias("before"), F.left("after", F.lit(30)).alias("after"), "order", "reference_id")
    old, new = near(_WITH_IMAGE), near(f"concat('<p>', {_WITH_IMAGE})")
    match = documents.match_occurrences(old.drop("reference_id"), new.drop("reference_id"))
    of = lambda df, order, name: df.select("source", F.col("order").alias(order), F.col("reference_id").alias(name))
    return match.join(of(old, "legacy_order", "legacy_reference"), ["source", "legacy_order"]).join(of(new, "current_order", "current_reference"), ["source", "current_order"]).select("source", "legacy_reference", "current_reference")


@query(
    "d49_assembled_images",
    """WITH a AS (SELECT l_partkey AS url, arg_max(l_returnflag, struct_pack(a := l_shipdate, b := l_orderkey, c := l_linenumber, d := l_suppkey)) AS flag FROM lineitem GROUP BY 1)
       SELECT p_partkey AS url, CASE WHEN flag = 'A' THEN 'ACQUIRED' WHEN p_partkey % 3 = 0 THEN 'ACQUIRED' WHEN flag IS NULL THEN 'NEVER_ATTEMPTED' WHEN flag = 'N' THEN 'FAILED' ELSE 'OTHER' END AS state, (flag IS NULL OR flag <> 'A') AND p_partkey % 3 = 0 AS carried FROM part LEFT JOIN a ON url = p_partkey""",
)
def _(t):
    """Parts as images: their latest line decides, and some are proven from before."""
    flag = F.col("l_returnflag")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")
    attempts = t.lineitem.select(F.col("l_partkey").alias("url"), F.when(flag == "A", "ACQUIRED").when(flag == "N", "FAILED").otherwise("OTHER").alias("outcome"), F.when(flag == "A", "blob").alias("blob"), order.alias("at"))
    references = t.part.select(F.col("p_partkey").alias("url"))
    prior = references.where("url % 3 = 0").withColumn("blob", F.lit("old"))
    return images.assembled(references, attempts, prior, "url", "at", "blob").select("url", "state", "carried")


@query(
    "d65_staged_manifest",
    """SELECT l_partkey AS url, min(l_orderkey) AS first, count(*)::BIGINT AS mentions, bool_or(l_returnflag = 'R') AND bool_or(l_returnflag <> 'R') AS disagree FROM lineitem GROUP BY 1 ORDER BY first, url LIMIT 500""",
)
def _(t):
    rows = t.lineitem.select(F.col("l_partkey").alias("url"), "l_orderkey", F.when(F.col("l_returnflag") == "R", images.MISMATCH).otherwise(images.RESOLVED).alias("status"))
    return images.manifest(rows, "url", "l_orderkey", "status", 500)


@query("d66_prepared_sources", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'CURRENT' WHEN doc_id % 5 = 0 THEN 'STORED' ELSE 'FETCH' END AS source, CASE WHEN doc_id % 3 = 0 THEN sha256(text) WHEN doc_id % 5 = 0 THEN 'old' || doc_id END AS body FROM documents")
def _(t):
    d = t.documents
    current = d.where("doc_id % 3 = 0").select("doc_id", F.sha2("text", 256).alias("body"))
    stored = d.where("doc_id % 5 = 0").select("doc_id", F.concat(F.lit("old"), "doc_id").alias("body"))
    return coverage.prepared(d, current, stored, "doc_id", "body")


@query("d67_first_samples", "SELECT l_linenumber, l_orderkey FROM (SELECT l_linenumber, l_orderkey, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_orderkey, l_partkey, l_suppkey) AS n FROM lineitem) WHERE n = 1 ORDER BY l_linenumber LIMIT 3")
def _(t):
    one = profile.samples_per_category(t.lineitem.withColumn("at", F.struct("l_orderkey", "l_partkey", "l_suppkey")), "l_linenumber", "at", 1)
    return one.orderBy("l_linenumber").limit(3).select("l_linenumber", "l_orderkey")


# -- audits ------------------------------------------------------------------------


@query(
    "d59_reader_bindings",
    """WITH r AS (SELECT conv_id, count(DISTINCT role) AS n, min(role) AS first FROM conversations WHERE conv_id % 5 <> 0 GROUP BY 1), o AS (SELECT *, count(*) OVER (PARTITION BY conv_id, CASE WHEN conv_id % 7 = 0 THEN 0 ELSE turn END) AS times FROM conversations)
       SELECT o.conv_id AS reader, turn, CASE WHEN times > 1 THEN 'DUPLICATE_ORDER' WHEN n IS NULL THEN 'UNBOUND' WHEN n > 1 THEN 'SEVERAL_SOURCES' WHEN role <> first THEN 'BODY_DIFFERS' ELSE 'BOUND' END AS state FROM o LEFT JOIN r USING (conv_id)""",
)
def _(t):
    c = t.conversations
    receipts = c.where("conv_id % 5 <> 0").select(F.col("conv_id").alias("key"), F.col("role").alias("digest"))
    order = F.when(F.col("conv_id") % 7 == 0, 0).otherwise(F.col("turn"))
    readers = c.select(F.col("conv_id").alias("reader"), order.alias("order"), F.col("conv_id").alias("key"), F.col("role").alias("digest"), "turn")
    return coverage.bindings(receipts, readers, "key", "digest").select("reader", "turn", "state")


@query(
    "d43_text_coverage",
    """WITH c AS (SELECT text, count(*) AS cells FROM documents WHERE doc_id % 4 <> 0 GROUP BY 1), f AS (SELECT text, count(*) AS files, arg_min(source, doc_id) AS folder FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1)
       SELECT folder, CASE WHEN files IS NULL THEN 'CELL_ONLY' WHEN cells IS NULL THEN 'FILE_ONLY' ELSE 'MATCHED' END AS status, count(*)::BIGINT AS texts, coalesce(sum(cells), 0)::BIGINT AS cells, coalesce(sum(files), 0)::BIGINT AS files FROM c FULL JOIN f USING (text) GROUP BY ALL""",
)
def _(t):
    return coverage.text_coverage(t.documents.where("doc_id % 4 <> 0"), t.documents.where("doc_id % 3 <> 0"), "doc_id", "doc_id", "text", "source")


_TITLE = "CASE k WHEN 1 THEN '대법원' WHEN 2 THEN concat(y, '. ', mo, '. ', d, '. 2001. 2. 4.') ELSE concat('대법원 ', y, '. ', mo, '. ', d, '. 선고') END"


@query(
    "d44_repair_overlay",
    of_orders("SELECT o_orderkey, CASE k WHEN 1 THEN 'MISSING_TITLE_DATE' WHEN 2 THEN 'AMBIGUOUS_TITLE' WHEN 3 THEN 'TITLE_NOT_CONFIRMED_IN_HTML' ELSE 'READY' END AS status, CASE WHEN k IN (0, 4, 5) THEN make_date(y::INT, mo::INT, d::INT) ELSE DATE '1900-01-01' END::VARCHAR AS day FROM p"),
)
def _(t):
    """Proposals from titles, and the table with those applied that are ready."""
    rows = made(t, "orders", "o_orderkey", ORDERS, title=_TITLE, page=f"CASE WHEN k = 3 THEN c ELSE {_TITLE} END")
    base = rows.select("o_orderkey", F.lit("1900-01-01").cast("date").alias("day"))
    overlay = reports.date_overlay(rows, "o_orderkey", "title", "page")
    return ledger.apply_overlay(base, overlay, "o_orderkey", "day").join(overlay.select("o_orderkey", "status"), "o_orderkey").select("o_orderkey", "status", F.col("day").cast("string").alias("day"))


@query(
    "d25_quality_audit",
    """SELECT doc_id::VARCHAR AS doc, CASE WHEN doc_id % 9 = 0 THEN 'INPUT_MISSING' WHEN doc_id % 9 = 1 THEN 'INPUT_REVISION_CHANGED' WHEN doc_id % 9 = 2 THEN 'INPUT_INVALID' ELSE 'FIELD_REVIEW' END AS code, CASE WHEN doc_id % 9 < 3 THEN 'LOGIC_REQUIRED' ELSE 'REVIEW' END AS category
       FROM documents WHERE lang = 'en' AND (doc_id % 9 < 3 OR n_chars < 800)""",
)
def _(t):
    """English documents as a frozen scope; what has changed since is an issue in place of its own."""
    d, n = t.documents.withColumn("doc", F.col("doc_id").cast("string")), F.col("doc_id") % 9
    scope = d.where("lang = 'en'").select("doc", F.lit(1).alias("revision"))
    inputs = d.where(n > 0).select("doc", F.when(n == 1, 2).otherwise(1).alias("revision"), (n != 2).alias("valid"))
    issues = quality.field_issues(d.where("n_chars < 800").select("doc", F.lit("REVIEW").alias("status"), F.lit("text").alias("name")))
    return quality.audit(scope, inputs, issues).select("doc", "code", "category")


@query("d76_unprocessed_fields", of_customers("SELECT i AS doc, CASE WHEN k = 2 THEN 'NOT_PROCESSED' ELSE 'HAS_REVISION' END AS state, CASE WHEN k = 2 THEN 60 ELSE 0 END::BIGINT AS unprocessed FROM p"))
def _(t):
    """Documents without a revision read as sixty fields that were not processed."""
    every = cases(t)
    have = case_fields.case_fields(every.where("title is not null")).where("status <> 'NOT_PROCESSED'")
    rows = fields.complete(have, every, "doc", case_fields.NAMES, "NOT_PROCESSED")
    per = rows.groupBy("doc").agg(F.count_if(F.col("status") == "NOT_PROCESSED").alias("unprocessed"))
    return per.select("doc", F.when(F.col("unprocessed") == 60, "NOT_PROCESSED").otherwise("HAS_REVISION").alias("state"), "unprocessed")


@query("d15_rebuilt_projection", "SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN 'MISSING' WHEN doc_id % 8 = 1 THEN 'CHANGED' WHEN doc_id % 8 = 2 THEN 'EXTRA' ELSE 'SAME' END AS state FROM documents")
def _(t):
    d = t.documents.select("doc_id", "lang", F.sha2("text", 256).alias("sha256"))
    stored = d.where("doc_id % 8 <> 0").withColumn("lang", F.when(F.col("doc_id") % 8 == 1, F.lit(None)).otherwise(F.col("lang")))
    return ledger.rebuilt(stored, d.where("doc_id % 8 <> 2"), ["doc_id"])


@query("d70_history", "SELECT event_id, (row_number() OVER (ORDER BY ts DESC, event_id DESC))::INT AS rank FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def _(t):
    return reports.history(t.events, "ts", "event_id").select("event_id", "rank")


@query("d70_status_histogram", "SELECT s AS status, coalesce(n, 0)::BIGINT AS n, coalesce(done, 0)::BIGINT AS done FROM (SELECT unnest(['F', 'O', 'P', 'X']) AS s) LEFT JOIN (SELECT o_orderstatus AS s, count(*) AS n, count(*) FILTER (o_totalprice > 100000) AS done FROM orders GROUP BY 1) USING (s)")
def _(t):
    rows = t.orders.withColumnRenamed("o_orderstatus", "status")
    return coverage.state_counts(rows, "status", ["F", "O", "P", "X"], F.count_if(F.col("o_totalprice") > 100_000).alias("done"))


@query("d73_unsorted_catalog", "SELECT event_id AS position FROM (SELECT event_id, k, lag(k) OVER (ORDER BY event_id) AS before FROM (SELECT event_id, lpad((event_id - CASE WHEN event_id % 50 = 7 THEN 3 WHEN event_id % 50 = 9 THEN 1 ELSE 0 END)::VARCHAR, 12, '0') AS k FROM events)) WHERE k <= before")
def _(t):
    """A catalog must ascend without repeats: the rows that break it."""
    from ..operators import delta

    n = F.col("event_id")
    moved = n - F.when(n % 50 == 7, 3).when(n % 50 == 9, 1).otherwise(0)
    rows = t.events.select(n.alias("position"), F.lpad(moved.cast("string"), 12, "0").alias("source_id"))
    return delta.validate_sorted(rows, "position").select("position")


# -- contracts of batches and cells --------------------------------------------------------


@query(
    "c14_batch_inputs",
    """SELECT doc_id, concat_ws(',', CASE WHEN count(*) OVER (PARTITION BY CASE WHEN doc_id % 20 = 3 THEN doc_id - 1 ELSE doc_id END) > 1 THEN 'DUPLICATE_POSITION' END, CASE WHEN strlen(text) = 0 THEN 'EMPTY_INPUT' END, CASE WHEN strlen(text) > 5000 THEN 'INPUT_SIZE_LIMIT' END, CASE WHEN doc_id % 6 = 0 THEN 'INPUT_HASH_MISMATCH' END) AS errors FROM documents""",
)
def _(t):
    position = F.when(F.col("doc_id") % 20 == 3, F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    d = t.documents.withColumn("position", position)
    times = d.groupBy("position").agg(F.count("*").alias("times"))
    real = F.sha2("text", 256)
    wanted = F.when(F.col("doc_id") % 6 == 0, "other").otherwise(real)
    return d.join(times, "position").select("doc_id", F.array_join(contracts.batch_input(F.col("position"), F.col("times"), F.octet_length("text"), F.lit(5000), wanted, real), ",").alias("errors"))


@query("c15_stored_cells", "SELECT 'documents' AS \"table\", count(*)::BIGINT AS rows, count(*)::BIGINT AS kept FROM documents UNION ALL SELECT 'orders', count(*), count(*) FROM orders UNION ALL SELECT 'lineitem', count(*), count(*) FROM lineitem")
def _(t):
    """Every cell comes back from its tagged form: rows, and rows of which all cells do."""
    out = None
    for name in ("documents", "orders", "lineitem"):
        df = getattr(t, name)
        kept = F.lit(True)
        for f in df.schema:
            x = F.col(f.name) if f.dataType.typeName() in ("string", "long", "integer") else F.col(f.name).cast("string")
            kind = f.dataType if f.dataType.typeName() in ("string", "long", "integer") else cells.T.StringType()
            kept = kept & contracts.stored_cell(kind, x)
        one = df.agg(F.count("*").alias("rows"), F.count_if(kept).alias("kept")).select(F.lit(name).alias("table"), "rows", "kept")
        out = one if out is None else out.unionByName(one)
    return out


@query("c13_row_bundle", "SELECT count(*)::BIGINT AS rows, true AS complete, 5::BIGINT AS columns, count(DISTINCT struct_pack(doc_id, text, lang, source, n_chars))::BIGINT AS bodies FROM documents")
def _(t):
    """A bundle of rows: positions from 0 without a gap, and the same columns in each."""
    spark = t.documents.sparkSession
    from ..operators.paging import numbered

    rows = materialize(numbered(t.documents, ["doc_id"]), "bundle")
    position = next(c for c in rows.columns if c not in t.documents.columns)
    body = tables.row_bundle(t.documents, "doc_id")
    whole = profile.sequence_complete(rows.withColumn(position, F.col(position) - F.lit(rows.agg(F.min(position)).first()[0])), position).select("complete")
    names = F.size(F.json_object_keys("body"))
    return body.agg(F.count("*").alias("rows"), F.max(names).cast("bigint").alias("columns"), F.countDistinct("sha256").alias("bodies")).join(whole).select("rows", "complete", "columns", "bodies")  # one row each
