"""Scans, search and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cells, dates, keys, text, urls
from ..operators import ledger, quality, search
from ..operators.search_index import index_of
from ..sources import tables
from .registry import query

WORD = "pathetic"
NUMBER = "555-"


@query(
    "p2_any_column_search",
    f"""SELECT doc_id, concat_ws(',', CASE WHEN contains(text, '{NUMBER}') THEN 'text' END, CASE WHEN contains(lang, '{NUMBER}') THEN 'lang' END,
               CASE WHEN contains(source, '{NUMBER}') THEN 'source' END) AS matched
        FROM documents WHERE contains(text, '{NUMBER}') OR contains(lang, '{NUMBER}') OR contains(source, '{NUMBER}')
                          OR contains(doc_id::varchar, '{NUMBER}') OR contains(n_chars::varchar, '{NUMBER}')""",
)
def _(t):
    return search.search(t.documents, NUMBER).select("doc_id", F.array_join("matched_columns", ",").alias("matched"))


@query(
    "p4_matched_columns",
    """SELECT o_orderkey, concat_ws(',', CASE WHEN contains(o_orderkey::varchar, '77') THEN 'o_orderkey' END, CASE WHEN contains(o_custkey::varchar, '77') THEN 'o_custkey' END) AS matched
       FROM orders WHERE contains(o_orderkey::varchar, '77') OR contains(o_custkey::varchar, '77')""",
)
def _(t):
    cols = ["o_orderkey", "o_custkey"]
    return search.search(t.orders, "77", columns=cols).select("o_orderkey", F.array_join("matched_columns", ",").alias("matched"))


@query("f1_casefold_search", f"SELECT doc_id, length(text)::BIGINT AS n FROM documents WHERE contains(replace(lower(text), 'ß', 'ss'), '{WORD}')")
def _(t):
    return search.search(t.documents.select("doc_id", "text"), WORD.upper(), columns=["text"]).select("doc_id", F.length("text").cast("bigint").alias("n"))


@query("p3_literal_search", "SELECT page_id, url FROM pages WHERE contains(html, '&amp;')")
def _(t):
    return t.pages.where(text.contains_folded(F.col("html"), "&") & text.like_literal(F.col("html"), "&amp;")).select("page_id", "url")


SEARCHED = ["text", "lang", "source"]


@query("d16_index_build", "SELECT count(*)::BIGINT AS rows, true AS ready FROM documents")
def _(t):
    index = index_of(t.documents, "doc_id", SEARCHED)
    return index.rows().agg(F.count("row").alias("rows")).withColumn("ready", F.lit(index.ready()))


@query("d16_search_projection", f"SELECT doc_id, 'text' AS matched FROM documents WHERE contains(replace(lower(text), 'ß', 'ss'), '{WORD}')")
def _(t):
    hits = index_of(t.documents, "doc_id", SEARCHED).search(WORD.title())
    return hits.select(F.col("key").alias("doc_id"), F.array_join("matched_columns", ",").alias("matched"))


@query(
    "p2_index_search",
    f"""SELECT doc_id, concat_ws(',', CASE WHEN contains(text, '{NUMBER}') THEN 'text' END, CASE WHEN contains(lang, '{NUMBER}') THEN 'lang' END, CASE WHEN contains(source, '{NUMBER}') THEN 'source' END) AS matched
        FROM documents WHERE contains(text, '{NUMBER}') OR contains(lang, '{NUMBER}') OR contains(source, '{NUMBER}')""",
)
def _(t):
    hits = index_of(t.documents, "doc_id", SEARCHED).search(NUMBER)
    return hits.select(F.col("key").alias("doc_id"), F.array_join("matched_columns", ",").alias("matched"))


@query("f1_index_short", "SELECT doc_id, concat_ws(',', CASE WHEN contains(replace(lower(text), 'ß', 'ss'), 'de') THEN 'text' END, CASE WHEN lang = 'de' THEN 'lang' END) AS matched FROM documents WHERE contains(replace(lower(text), 'ß', 'ss'), 'de') OR lang = 'de'")
def _(t):
    hits = index_of(t.documents, "doc_id", SEARCHED).search("DE")  # shorter than a trigram: the folded rows are read
    return hits.select(F.col("key").alias("doc_id"), F.array_join("matched_columns", ",").alias("matched"))


@query("l6_prefix_search", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER () AS rn, lang FROM documents) WHERE contains(lang, 'e') ORDER BY rn LIMIT 30")
def _(t):
    return index_of(t.documents, "doc_id", ["lang"]).search("E", limit=30).select(F.col("key").alias("doc_id"))


@query("d18_title_first", "SELECT page_id, 'title' AS matched FROM pages WHERE contains(lower(url), 'utm_source')")
def _(t):
    return search.title_first(t.pages, "utm_source", "url", "html").select("page_id", "matched")


@query("r1_full_scan", "SELECT * FROM customer")
def _(t):
    return t.customer


@query("r2_projected_scan", "SELECT l_orderkey, l_quantity FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_quantity")


@query("r3_point_lookup", "SELECT doc_id, n_chars, 'FOUND' AS lookup FROM documents WHERE doc_id = 17")
def _(t):
    return tables.point_lookup(t.documents, "doc_id", 17).select("doc_id", "n_chars", "lookup")


@query(
    "r4_multi_lookup",
    """SELECT w.doc_id, CASE WHEN n IS NULL THEN 'ROW_NOT_FOUND' WHEN n > 1 THEN 'DUPLICATE_POSITION' ELSE 'FOUND' END AS lookup
       FROM (SELECT DISTINCT conv_id AS doc_id FROM conversations) w LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY doc_id) USING (doc_id)""",
)
def _(t):
    return tables.lookup_many(t.labels, t.conversations.select(F.col("conv_id").alias("doc_id")), "doc_id")


@query(
    "r5_row_as_fields",
    """SELECT s_suppkey, name, value, 'LEGACY_STORED' AS status FROM (
         SELECT s_suppkey, 's_name' AS name, s_name AS value FROM supplier UNION ALL SELECT s_suppkey, 's_nationkey', s_nationkey::varchar FROM supplier)""",
)
def _(t):
    return tables.as_fields(t.supplier.drop("s_acctbal"), "s_suppkey")


@query(
    "p1_cell_precedence",
    """SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name ELSE p_size::varchar END AS shown FROM part""",
)
def _(t):
    cell = F.struct(F.when(F.col("p_size") > 25, F.col("p_name")).alias("text"), F.col("p_size").cast("bigint").alias("integer"))
    df = t.part.select("p_partkey", cell.alias("c"))
    return df.select("p_partkey", cells.text_of(df.schema["c"].dataType, F.col("c")).alias("shown"))


@query(
    "d57_tagged_cells",
    """SELECT c_custkey, 'string' AS original_type, 'STRING' AS encoding, c_name AS shown FROM customer
       UNION ALL SELECT c_custkey, 'int', 'INTEGER', c_nationkey::varchar FROM customer""",
)
def _(t):
    df = t.customer.select("c_custkey", "c_name", "c_nationkey")
    both = F.array(*[cells.tag(f.dataType, F.col(f.name)) for f in df.schema if f.name != "c_custkey"])
    return df.select("c_custkey", F.explode(both).alias("c")).select("c_custkey", "c.original_type", "c.encoding", cells.untag(F.col("c")).alias("shown"))


@query(
    "p5_distinct_texts",
    """SELECT p_partkey, CASE WHEN split_part(p_name, ' ', 1) = split_part(p_name, ' ', 2) THEN split_part(p_name, ' ', 1) ELSE p_name END AS shown FROM part""",
)
def _(t):
    first, second = (F.split_part(F.col("p_name"), F.lit(" "), F.lit(k)) for k in (1, 2))
    return t.part.select("p_partkey", F.array_join(search.case_numbers(first, F.concat(second, F.lit(" ")), F.lit("  ")), " ").alias("shown"))


@query("p6_unwrap_json", """SELECT event_id, regexp_extract(props, '"k": ?([0-9]+)', 1)::BIGINT AS k FROM events""")
def _(t):
    wrapped = F.replace(F.col("props"), F.lit('"k"'), F.lit('"value"'))
    return t.events.select("event_id", cells.wrapped_value(wrapped).cast("bigint").alias("k"))


@query("p7_ilike", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RED%'")
def _(t):
    return t.part.where(F.col("p_name").ilike("%RED%")).select("p_partkey", "p_name")


@query("p8_escaped_like", "SELECT doc_id FROM documents WHERE contains(text, '%%%')")
def _(t):
    return t.documents.where(text.like_literal(F.col("text"), "%%%")).select("doc_id")


@query("p9_position_lower", "SELECT page_id FROM pages WHERE strpos(lower(url), lower('BLOG')) > 0")
def _(t):
    return t.pages.where(F.instr(F.lower("url"), "blog") > 0).select("page_id")


@query("p10_json_path", """SELECT event_id, event_type FROM events WHERE json_extract_string(props, '$.k')::BIGINT >= 50""")
def _(t):
    return t.events.where(F.get_json_object("props", "$.k").cast("bigint") >= 50).select("event_id", "event_type")


@query("p11_any_of", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name IN ('ASIA', 'EUROPE'))")
def _(t):
    wanted = t.region.where(F.col("r_name").isin("ASIA", "EUROPE"))
    return t.nation.join(wanted, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi").select("n_nationkey", "n_name")


@query("p12_or_subquery", "SELECT doc_id FROM documents WHERE lang = 'de' OR doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(t):
    toxic = t.labels.where("toxic = 1").select("doc_id").distinct().withColumn("toxic", F.lit(True))
    return t.documents.join(toxic, "doc_id", "left").where((F.col("lang") == "de") | F.col("toxic")).select("doc_id")


@query("p13_date_window", "SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1997-01-01' AND DATE '1997-03-31'")
def _(t):
    day = F.to_date("o_orderdate")
    return t.orders.where(dates.in_window(day, "1997-01-01", "1997-03-31")).select("o_orderkey", day.cast("string").alias("day"))


@query(
    "p15_transient_codes",
    """SELECT code, regexp_matches(code, '^((IMAGE|LAWGO|SOURCE)_)?HTTP_(408|429|500|502|503|504)$') AS transient
       FROM (SELECT DISTINCT 'HTTP_' || (400 + p_size * 4)::varchar AS code FROM part)""",
)
def _(t):
    code = F.concat(F.lit("HTTP_"), (F.lit(400) + F.col("p_size") * 4).cast("string"))
    return t.part.select(code.alias("code")).distinct().withColumn("transient", quality.is_transient(F.col("code")))


@query(
    "p16_url_valid",
    """SELECT page_id, regexp_matches(url, '^https?://') AND NOT contains(url, '#') AS safe,
              regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages""",
)
def _(t):
    return t.pages.select("page_id", urls.is_safe(F.col("url")).alias("safe"), urls.part(F.col("url"), "HOST").alias("host"))


@query(
    "f30_url_parts",
    """SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path,
              CASE WHEN contains(url, 'page=') THEN regexp_extract(url, '[?&]page=([^&#]*)', 1) END AS page FROM pages""",
)
def _(t):
    return t.pages.select("page_id", urls.part(F.col("url"), "PATH").alias("path"), urls.part(F.col("url"), "QUERY", "page").alias("page"))


@query(
    "p17_first_reason",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'CLOSED' WHEN o_totalprice < 10000 THEN 'SMALL' WHEN o_orderpriority = '5-LOW' THEN 'LOW' ELSE 'OK' END AS reason FROM orders""",
)
def _(t):
    rules = (("CLOSED", F.col("o_orderstatus") == "F"), ("SMALL", F.col("o_totalprice") < 10000), ("LOW", F.col("o_orderpriority") == "5-LOW"))
    return t.orders.select("o_orderkey", ledger.first_reason(*rules).alias("reason"))


@query("p18_id_validity", "SELECT c_custkey, CASE WHEN c_custkey = 0 THEN 'SENTINEL' WHEN c_nationkey = 3 THEN 'PADDED' ELSE 'VALID' END AS state FROM customer")
def _(t):
    written = F.concat(F.col("c_custkey").cast("string"), F.when((F.col("c_nationkey") == 3) & (F.col("c_custkey") != 0), " ").otherwise(""))
    return t.customer.select("c_custkey", keys.source_id_state(written).alias("state"))


@query(
    "p20_body_state",
    "SELECT doc_id, CASE WHEN text IS NULL THEN 'ERROR' WHEN lower(trim(text)) IN ('', 'empty', 'no_info', 'none') THEN 'EMPTY_OR_SENTINEL' ELSE 'OBSERVED' END AS state FROM documents",
)
def _(t):
    return t.documents.select("doc_id", cells.body_state(F.col("text")).alias("state"))


@query(
    "p21_quarantine",
    "SELECT event_id, CASE WHEN event_type = 'error' THEN 'QUARANTINED' ELSE 'PRESERVED' END AS status FROM events",
)
def _(t):
    from pyspark.sql import types as T

    line = F.when(F.col("event_type") == "error", F.concat(F.lit("{"), "event_type")).otherwise(F.col("props"))
    kind = T.StructType([T.StructField("k", T.LongType())])
    return tables.quarantined(None, t.events.select("event_id", line.alias("value")), kind).select("event_id", "status")


BLANKS = "[ \\t\\n\\r\\f\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


@query("f2_strip", f"SELECT doc_id, length(regexp_replace(regexp_replace(text, '^{BLANKS}', ''), '{BLANKS}$', ''))::BIGINT AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", F.length(text.strip(F.col("text"))).cast("bigint").alias("n"))


@query("f3_compact", "SELECT doc_id, sha256(regexp_replace(text, '[ \\t\\n\\r\\f\\x0b]+', '', 'g')) AS h FROM documents")
def _(t):
    return t.documents.select("doc_id", F.sha2(text.compact(F.col("text")), 256).alias("h"))


@query("f4_collapse", "SELECT doc_id, sha256(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'))) AS h FROM documents")
def _(t):
    return t.documents.select("doc_id", F.sha2(text.collapse(F.col("text")), 256).alias("h"))


@query("f10_label", "SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN 'SMALL · ' || p_brand ELSE p_type || ' · SMALL · ' || p_brand END AS label FROM part")
def _(t):
    return t.part.select("p_partkey", text.label_join(F.col("p_type"), F.lit("SMALL"), F.lit(None).cast("string"), F.col("p_brand")).alias("label"))


@query("f33_context", "SELECT doc_id, substr(text, 11, 20) AS piece, substr(text, 1, 10) AS before, substr(text, 31, 30) AS after FROM documents")
def _(t):
    a, b = F.lit(10), F.lit(30)
    before, after = text.context(F.col("text"), a, b, 30)
    return t.documents.select("doc_id", text.slice_of(F.col("text"), a, b).alias("piece"), before.alias("before"), after.alias("after"))


@query("f38_brief", "SELECT doc_id, CASE WHEN length(text) > 30 THEN left(text, 30) || '…(' || length(text) || ')' ELSE text END AS brief FROM documents")
def _(t):
    return t.documents.select("doc_id", text.brief(F.col("text"), 30).alias("brief"))


@query("f36_newlines", "SELECT doc_id, (length(replace(replace(text, chr(13)||chr(10), chr(10)), chr(13), chr(10))))::BIGINT AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", F.length(text.newlines(F.col("text"))).cast("bigint").alias("n"))


@query("d56_search_text", "SELECT p_partkey, p_name || chr(10) || p_brand || chr(10) || p_type AS search_text FROM part")
def _(t):
    return t.part.select("p_partkey", text.search_text(F.col("p_name"), F.lit(None).cast("string"), F.col("p_brand"), F.col("p_type")).alias("search_text"))


@query("f11_date_parse", "SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day FROM orders")
def _(t):
    d = F.col("o_orderdate")
    written = F.when(F.col("o_orderstatus") == "F", F.date_format(d, "yyyyMMdd")).when(F.col("o_orderstatus") == "O", F.date_format(d, "yyyy.MM.dd")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    return t.orders.select("o_orderkey", dates.parse_date(written).cast("string").alias("day"))


@query("f12_cited_date", "SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day FROM orders")
def _(t):
    cited = F.concat(F.lit("court "), F.date_format("o_orderdate", "yyyy. M. d."), F.lit(" 98da1"))
    return t.orders.select("o_orderkey", dates.cited_date(cited).cast("string").alias("day"))


@query("f13_date_agreement", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_shipdate::DATE::VARCHAR END AS day FROM lineitem")
def _(t):
    a = F.date_format("l_shipdate", "yyyyMMdd")
    b = F.when(F.col("l_returnflag") == "R", F.date_format(F.date_add("l_shipdate", 1), "yyyy.MM.dd")).otherwise(F.date_format("l_shipdate", "yyyy.MM.dd"))
    return t.lineitem.select("l_orderkey", "l_linenumber", dates.agreed_date(a, b, F.lit("")).cast("string").alias("day"))


@query("f14_day_digits", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS digits FROM orders")
def _(t):
    return t.orders.select("o_orderkey", dates.day_digits(F.date_format("o_orderdate", "yyyy. MM. dd.")).alias("digits"))


@query("f20_date_state", "SELECT o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 'VALID' WHEN 'O' THEN 'INVALID' ELSE 'MISSING' END AS state, count(*) AS n FROM orders GROUP BY ALL")
def _(t):
    x = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyyMMdd")).when(F.col("o_orderstatus") == "O", "20261340")
    return t.orders.select("o_orderstatus", dates.date_state(x).alias("state")).groupBy("o_orderstatus", "state").agg(F.count("*").alias("n"))


@query(
    "f6_docket_aliases",
    "SELECT p_partkey, '98다' || p_partkey || ',98다' || (p_partkey + 1) AS aliases FROM part WHERE p_size <> 7 UNION ALL SELECT p_partkey, '' FROM part WHERE p_size = 7",
)
def _(t):
    k = F.col("p_partkey")
    raw = F.concat(F.lit("98다"), k.cast("string"), F.when(F.col("p_size") == 7, F.lit(", x")).otherwise(F.concat(F.lit(" , "), (k + 1).cast("string"))))
    return t.part.select("p_partkey", F.array_join(keys.docket_aliases(raw), ",").alias("aliases"))


@query(
    "f7_decision_keys",
    """SELECT o_orderkey, 'court' || o_custkey AS court, '98다' || (o_orderkey + 1) AS case_number, '판결' AS kind FROM orders WHERE o_orderstatus = 'F'""",
)
def _(t):
    court = F.concat(F.lit("court"), F.col("o_custkey").cast("string"))
    docket = F.concat(F.lit("98다"), (F.col("o_orderkey") + 1).cast("string"))
    kind = F.when(F.col("o_orderstatus") == "F", " 전원합의체판결 ").otherwise("other")
    return t.orders.select("o_orderkey", F.inline(keys.decision_keys(court, docket, kind)))


@query("f8_docket_symbol", "SELECT p_partkey, '다' AS symbol FROM part")
def _(t):
    return t.part.select("p_partkey", keys.docket_symbol(F.concat(F.lit("대법원 2001다"), F.col("p_partkey").cast("string"), F.lit(" 판결"))).alias("symbol"))


@query("f15_disposition", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '결정' ELSE '판결' END AS disposition FROM orders")
def _(t):
    x = F.concat(F.date_format("o_orderdate", "yyyy. M. d."), F.when(F.col("o_orderstatus") == "F", " 결정 ★").otherwise(" 판결"))
    return t.orders.select("o_orderkey", keys.disposition(x).alias("disposition"))


@query("f22_content_hash", "SELECT doc_id, sha256(text) AS h FROM documents")
def _(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("h"))


@query("f24_canonical_id", "SELECT c_custkey, 'kc:' || sha256(('canonical-allocation-1'::BLOB || '\\x00'::BLOB || c_name::BLOB)) AS id FROM customer")
def _(t):
    from ..functions.hashes import canonical_id

    return t.customer.select("c_custkey", canonical_id(F.col("c_name")).alias("id"))


@query(
    "f26_record_hash",
    """SELECT s_suppkey, sha256('name=' || length(s_name) || ':' || s_name || chr(10) || 'nation=' || length(s_nationkey::varchar) || ':' || s_nationkey || chr(10)) AS h FROM supplier""",
)
def _(t):
    from ..functions.hashes import record_hash

    return t.supplier.select("s_suppkey", record_hash({"nation": F.col("s_nationkey"), "name": F.col("s_name")}).alias("h"))


@query("f37_ids_in_name", "SELECT c_custkey, regexp_extract(c_name, '([0-9]+)$', 1)::BIGINT AS id FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.regexp_extract("c_name", "([0-9]+)$", 1).cast("bigint").alias("id"))


@query("f46_strict_counts", "SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE event_id END AS n FROM events")
def _(t):
    x = F.when(F.col("event_type") == "error", "-1").otherwise(F.col("event_id").cast("string"))
    return t.events.select("event_id", keys.count_of(x).alias("n"))


@query("f43_json_elements", "SELECT o_orderpriority, part, count(*) AS n FROM orders, unnest(['a', o_orderstatus]) AS u(part) GROUP BY ALL")
def _(t):
    js = F.to_json(F.array(F.lit("a"), F.col("o_orderstatus")))
    return t.orders.select("o_orderpriority", F.explode(F.from_json(js, "array<string>")).alias("part")).groupBy("o_orderpriority", "part").agg(F.count("*").alias("n"))


@query("c18_scalar_contracts", "SELECT page_id, CASE WHEN contains(url, '#') THEN 'safe_url' ELSE '' END AS reasons FROM pages")
def _(t):
    from ..operators import contracts as C

    out = C.reasons(text=C.not_blank(F.col("html")), digest=C.digest(F.sha2("html", 256)), count=C.count_value(F.col("page_id")), safe_url=C.safe_url(F.col("url")))
    return t.pages.select("page_id", F.array_join(out, ",").alias("reasons"))


@query("c3_span_contract", "SELECT doc_id, length(text) >= 12 AS holds FROM documents")
def _(t):
    from ..operators import contracts as C

    return t.documents.select("doc_id", F.coalesce(C.span_holds(F.col("text"), F.lit(4), F.lit(12), F.substring("text", 5, 8)), F.lit(False)).alias("holds"))
