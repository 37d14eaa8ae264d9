"""Joins, aggregates, set operations and table checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashes
from ..operators import coverage, delta, documents, graph, identity, ledger, profile, quality
from .registry import query

BIG = "::BIGINT"


@query("j1_inner_two_keys", "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate")
def _(t):
    li, o = t.lineitem, t.orders
    return li.join(o, (li.l_orderkey == o.o_orderkey) & (li.l_shipdate >= o.o_orderdate)).select("l_orderkey", "l_linenumber", "o_custkey")


@query(
    "j3_current_revision",
    "SELECT c.conv_id, c.turn, c.role FROM conversations c JOIN (SELECT conv_id, max(turn) AS current FROM conversations GROUP BY conv_id) d ON c.conv_id = d.conv_id AND c.turn = d.current",
)
def _(t):
    current = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    return t.conversations.join(current, ["conv_id", "turn"]).select("conv_id", "turn", "role")


@query(
    "j4_four_way",
    """SELECT n_name, r_name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'B' ELSE 'X' END AS seg, count(*) AS n
       FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
)
def _(t):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    seg = F.when(F.col("c_mktsegment") == "BUILDING", "B").otherwise("X")
    return j.groupBy("n_name", "r_name", seg.alias("seg")).agg(F.count("*").alias("n"))


@query("j5_root_self_join", "SELECT a.conv_id, a.turn, b.role AS root_role FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = 0")
def _(t):
    root = t.conversations.where("turn = 0").select("conv_id", F.col("role").alias("root_role"))
    return t.conversations.join(root, "conv_id", "left").select("conv_id", "turn", "root_role")


@query("j6_anti_unindexed", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id")


@query("j7_missing_distinct", "SELECT count(DISTINCT source)::BIGINT AS sources FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def _(t):
    return t.documents.join(t.labels, "doc_id", "left_anti").agg(F.countDistinct("source").alias("sources"))


@query(
    "j9_dependency_gate",
    "SELECT o_orderkey FROM orders o WHERE o_orderstatus = 'O' AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_linestatus = 'F') AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R')",
)
def _(t):
    key = [F.col("o_orderkey") == F.col("l_orderkey")]
    done = t.lineitem.where("l_linestatus = 'F'")
    return t.orders.where("o_orderstatus = 'O'").join(done, key, "left_semi").join(t.lineitem.where("l_returnflag = 'R'"), key, "left_anti").select("o_orderkey")


@query("j10_explode_left", "SELECT rule, count(doc_id) AS n FROM (VALUES ('en'), ('de'), ('xx')) v(rule) LEFT JOIN documents ON lang = rule GROUP BY rule")
def _(t):
    rules = t.region.sparkSession.range(1).select(F.explode(F.array(F.lit("en"), F.lit("de"), F.lit("xx"))).alias("rule"))
    return rules.join(t.documents, F.col("rule") == F.col("lang"), "left").groupBy("rule").agg(F.count("doc_id").alias("n"))


@query(
    "j11_interval_semi",
    """SELECT event_id FROM events e WHERE EXISTS (SELECT 1 FROM (SELECT user_id, min(ts) AS s, CASE WHEN count(*) > 5 THEN max(ts) END AS f FROM events WHERE event_type = 'error' GROUP BY user_id) x
       WHERE x.user_id = e.user_id AND e.ts >= x.s AND (x.f IS NULL OR e.ts <= x.f))""",
)
def _(t):
    spans = t.events.where("event_type = 'error'").groupBy("user_id").agg(F.min("ts").alias("s"), F.when(F.count("*") > 5, F.max("ts")).alias("f"))
    return coverage.theta_semi(t.events, spans, "user_id", "ts", "s", "f").select("event_id")


_CHAIN = "SELECT conv_id * 1000 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent FROM conversations"


def _chain(t):
    return t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.col("turn") - 1).alias("parent"))


@query(
    "j12_descendants",
    f"""WITH RECURSIVE n AS ({_CHAIN}), d(root, node, depth) AS (SELECT id, id, 0 FROM n WHERE parent IS NULL UNION ALL SELECT d.root, n.id, d.depth + 1 FROM d JOIN n ON n.parent = d.node)
        SELECT root, node, depth FROM d WHERE depth > 0""",
)
def _(t):
    nodes = _chain(t)
    return graph.descendants(nodes, nodes.where("parent is null").select("id"))


@query("j13_cycle_check", "SELECT conv_id * 1000 + turn AS id FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING max(turn) = 1)")
def _(t):
    two = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("top")).where("top = 1")
    looped = t.conversations.join(two, "conv_id").where("turn = 0").select((F.col("conv_id") * 1000).alias("id"), (F.col("conv_id") * 1000 + 1).alias("loop"))
    nodes = _chain(t).join(looped, "id", "left").select("id", F.coalesce("parent", "loop").alias("parent"))
    return graph.in_cycle(nodes)


@query(
    "j15_positional_join",
    "SELECT pairing, count(*) AS n FROM (SELECT CASE WHEN a.turn IS NULL THEN 'RIGHT_ONLY' WHEN b.turn IS NULL THEN 'LEFT_ONLY' ELSE 'PAIRED' END AS pairing FROM (SELECT conv_id, turn FROM conversations WHERE role = 'user') a FULL JOIN (SELECT conv_id, turn - 1 AS turn FROM conversations WHERE role = 'assistant') b ON a.conv_id = b.conv_id AND a.turn = b.turn) GROUP BY pairing",
)
def _(t):
    users = t.conversations.where("role = 'user'").select("conv_id", "turn")
    others = t.conversations.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"))
    return documents.positional_join(users, others, ["conv_id", "turn"]).groupBy("pairing").agg(F.count("*").alias("n"))


@query(
    "j16_two_lookups",
    "SELECT l_orderkey, l_linenumber, p_brand, s_nationkey FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey",
)
def _(t):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"), "left").join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left").select("l_orderkey", "l_linenumber", "p_brand", "s_nationkey")


@query(
    "j17_carry_forward",
    "SELECT d.doc_id, coalesce(CASE WHEN d.lang = 'en' THEN d.source END, 'q' || l.quality) AS value, d.lang <> 'en' AND l.quality IS NOT NULL AS carried FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def _(t):
    now = t.documents.select("doc_id", F.when(F.col("lang") == "en", F.col("source")).alias("value"))
    prior = t.labels.select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("value"))
    return ledger.carry_forward(now, prior, "doc_id", "value").select("doc_id", "value", "carried")


@query(
    "j18_text_links",
    "SELECT p_partkey, CASE WHEN n IS NULL THEN 'UNLINKED' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'PRESERVED' END AS status, CASE WHEN n = 1 THEN k END AS target FROM part LEFT JOIN (SELECT p_name, count(DISTINCT p_brand) AS n, min(p_brand) AS k FROM part WHERE p_type = 'SMALL' GROUP BY p_name) USING (p_name)",
)
def _(t):
    links = t.part.where("p_type = 'SMALL'").select("p_name", "p_brand")
    return documents.unique_links(t.part, links, "p_partkey", "p_name", "p_brand").select("p_partkey", "status", "target")


@query(
    "j19_membership",
    "SELECT count(*) FILTER (WHERE a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL)::BIGINT AS \"both\", count(*) FILTER (WHERE b.doc_id IS NULL)::BIGINT AS left_only, count(*) FILTER (WHERE a.doc_id IS NULL)::BIGINT AS right_only FROM (SELECT DISTINCT doc_id FROM documents) a FULL JOIN (SELECT DISTINCT doc_id FROM labels) b ON a.doc_id = b.doc_id",
)
def _(t):
    return coverage.membership(t.documents, t.labels, "doc_id")


_INV = "SELECT doc_id AS position, sha256(text) AS body_hash FROM documents"


@query(
    "j20_coverage",
    """WITH i AS (SELECT doc_id AS position, source AS body_hash FROM documents), m AS (SELECT doc_id AS position, CASE WHEN toxic = 1 THEN 'QUARANTINED' ELSE 'PRESERVED' END AS st FROM labels),
       r AS (SELECT conv_id AS position, turn, CASE WHEN role = 'user' THEN 'src0' ELSE 'src1' END AS body_hash FROM conversations),
       h AS (SELECT i.position, count(*) AS revisions, count(*) FILTER (WHERE r.body_hash <> i.body_hash) AS other, max(r.turn) FILTER (WHERE r.body_hash = i.body_hash) AS reader_id FROM r JOIN i USING (position) GROUP BY i.position)
       SELECT position, CASE WHEN revisions IS NULL THEN 'MISSING' WHEN st IS NULL OR st = 'QUARANTINED' OR reader_id IS NULL THEN 'ERROR' ELSE 'STAGED_VERIFIED' END AS status, reader_id,
              coalesce(revisions, 0)::BIGINT AS revisions, coalesce(other, 0)::BIGINT AS other_bodies,
              concat_ws(',', CASE WHEN st IS NULL THEN 'NOT_IMPORTED' END, CASE WHEN st = 'QUARANTINED' THEN 'QUARANTINED' END, CASE WHEN reader_id IS NULL THEN 'NO_READER' END) AS reasons
       FROM i LEFT JOIN m USING (position) LEFT JOIN h USING (position)""",
)
def _(t):
    inv = t.documents.select(F.col("doc_id").alias("position"), F.col("source").alias("body_hash"))
    imports = t.labels.select(F.col("doc_id").alias("position"), F.when(F.col("toxic") == 1, "QUARANTINED").otherwise("PRESERVED").alias("status"))
    body = F.when(F.col("role") == "user", "src0").otherwise("src1")
    readers = t.conversations.select(F.col("conv_id").alias("position"), F.col("turn").alias("reader_id"), body.alias("body_hash"), F.col("turn").alias("created_at"))
    return coverage.reconcile(inv, imports, readers)


@query("j21_target_subset", "SELECT conv_id, turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = c.conv_id AND d.text = c.text)")
def _(t):
    docs = t.documents.select(F.col("doc_id").alias("conv_id"), "text")
    return t.conversations.join(docs, ["conv_id", "text"], "left_anti").select("conv_id", "turn")


@query("j22_hash_join", "SELECT doc_id, class_id, members FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id, count(*) OVER (PARTITION BY text) AS members FROM documents)")
def _(t):
    files = t.documents.select(F.col("doc_id").alias("class_id"), "text")
    return coverage.content_links(files, t.documents.select("doc_id", "text"), "class_id", "text").select("doc_id", "class_id", "members")


@query(
    "j23_set_status",
    "SELECT o_custkey, CASE WHEN len(list_intersect(a, b)) > 0 THEN 'AGREED' WHEN len(a) + len(b) > 0 THEN 'PARTIAL' ELSE 'NONE' END AS id_state FROM (SELECT o_custkey, list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'F') AS a0, list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'O') AS b0, coalesce(a0, []) AS a, coalesce(b0, []) AS b FROM orders GROUP BY o_custkey)",
)
def _(t):
    side = lambda s: F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority")))
    rows = t.orders.groupBy("o_custkey").agg(side("F").alias("a"), side("O").alias("b"))
    return coverage.id_set_status(rows, "a", "b").select("o_custkey", "id_state")


@query(
    "j24_agreement",
    "SELECT field, state, count(*) AS count FROM (SELECT 'lang' AS field, CASE WHEN a.lang = b.lang THEN 'same' ELSE 'different' END AS state FROM documents a JOIN (SELECT doc_id, CASE WHEN quality = 1 THEN 'en' ELSE 'de' END AS lang, CASE WHEN toxic = 1 THEN NULL ELSE 'src0' END AS source FROM labels) b USING (doc_id) UNION ALL SELECT 'source', CASE WHEN b.source IS NULL THEN 'missing' WHEN a.source = b.source THEN 'same' ELSE 'different' END FROM documents a JOIN (SELECT doc_id, CASE WHEN toxic = 1 THEN NULL ELSE 'src0' END AS source FROM labels) b USING (doc_id)) GROUP BY ALL",
)
def _(t):
    theirs = t.labels.select("doc_id", F.when(F.col("quality") == 1, "en").otherwise("de").alias("lang"), F.when(F.col("toxic") != 1, "src0").alias("source"))
    return identity.agreement(t.documents.select("doc_id", "lang", "source"), theirs, "doc_id", ["lang", "source"])


@query("j26_table_differences", "SELECT doc_id, lang, 'left' AS side FROM documents WHERE lang = 'fr' UNION ALL SELECT doc_id, 'xx', 'right' FROM documents WHERE lang = 'fr'")
def _(t):
    a = t.documents.select("doc_id", "lang")
    return profile.differences(a, a.withColumn("lang", F.when(F.col("lang") == "fr", "xx").otherwise(F.col("lang"))))


@query("d58_cell_differences", "SELECT doc_id, 'lang' AS \"column\", lang AS \"left\", 'xx' AS \"right\" FROM documents WHERE lang = 'fr'")
def _(t):
    a = t.documents.select("doc_id", "lang", "source")
    return profile.cell_differences(a, a.withColumn("lang", F.when(F.col("lang") == "fr", "xx").otherwise(F.col("lang"))), "doc_id")


@query("j27_scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def _(t):
    return t.orders.join(F.broadcast(t.orders.agg(F.avg("o_totalprice").alias("mean")))).where("o_totalprice > mean").select("o_orderkey")


@query("a1_count", "SELECT count(*) AS n FROM lineitem")
def _(t):
    return t.lineitem.agg(F.count("*").alias("n"))


@query("a3_counts_distinct", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY ALL")
def _(t):
    return t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))


@query("a4_filtered_counts", "SELECT count(*) FILTER (WHERE l_returnflag = 'R') AS returned, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem")
def _(t):
    return t.lineitem.agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))


@query("a5_sum_or_zero", "SELECT coalesce(sum(n_chars), 0)::BIGINT AS chars FROM documents WHERE lang = 'xx'")
def _(t):
    return t.documents.where("lang = 'xx'").agg(F.coalesce(F.sum("n_chars"), F.lit(0)).cast("bigint").alias("chars"))


@query("a6_conditional_sums", "SELECT source, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'de') AS de FROM documents GROUP BY source")
def _(t):
    return t.documents.groupBy("source").agg(F.count_if(F.col("lang") == "en").alias("en"), F.count_if(F.col("lang") == "de").alias("de"))


@query("a7_counter", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"))


@query("a10_exact_distinct", "SELECT count(DISTINCT sha256(text)) AS texts, count(DISTINCT source) AS sources FROM documents")
def _(t):
    return t.documents.agg(F.countDistinct(F.sha2("text", 256)).alias("texts"), F.countDistinct("source").alias("sources"))


@query("a11_samples_per_category", "SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM documents QUALIFY rank <= 10")
def _(t):
    return profile.samples_per_category(t.documents.select("lang", "doc_id"), "lang", "doc_id")


@query("a12_multi_map", "SELECT o_custkey, string_agg(o_orderkey::varchar, ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY o_custkey")
def _(t):
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("orders"))


@query("a13_duplicate_groups", "SELECT sha256(text) AS h, count(*) AS n, count(*) - 1 AS extra FROM documents GROUP BY h HAVING count(*) > 1")
def _(t):
    return identity.duplicate_groups(t.documents.select(F.sha2("text", 256).alias("h")), ["h"])


@query("a14_candidate_groups", "SELECT o_custkey, o_orderpriority, count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_ids, count(DISTINCT o_orderdate) = 1 AS one_day FROM orders GROUP BY ALL HAVING n_ids > 1")
def _(t):
    return identity.candidate_groups(t.orders, ["o_custkey", "o_orderpriority"], "o_orderkey", "o_orderdate")


@query("a15_cardinality", "SELECT (SELECT count(*) FROM (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1)) AS left_with_many, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS left_keys, (SELECT count(*) FROM (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) > 1)) AS right_with_many, (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS right_keys")
def _(t):
    return identity.cardinality(t.lineitem, "l_partkey", "l_suppkey")


@query("a16_coverage", "SELECT CASE WHEN lang = 'en' AND source = 'src0' THEN 'both' WHEN lang = 'en' THEN 'left' WHEN source = 'src0' THEN 'right' ELSE 'neither' END AS state, count(*) AS count FROM documents GROUP BY state")
def _(t):
    return identity.coverage_counts(t.documents, F.col("lang") == "en", F.col("source") == "src0")


@query("a17_topk_freq", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 12")
def _(t):
    return t.documents.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(12)


@query("a18_duplicate_kinds", "SELECT o_custkey, count(*) AS n, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN 'SAME_CITATION' WHEN count(DISTINCT o_orderdate) = 1 THEN 'SAME_DATE' ELSE 'DIFFERENT' END AS kind FROM orders GROUP BY o_custkey HAVING n > 1")
def _(t):
    return identity.classify_duplicates(t.orders, ["o_custkey"], "o_orderpriority", "o_orderdate")


@query("a19_date_compare", "SELECT CASE WHEN l_returnflag = 'N' THEN 'missing' WHEN l_shipdate = o_orderdate THEN 'same' ELSE 'different' END AS state, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY state")
def _(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    state = F.when(F.col("l_returnflag") == "N", "missing").when(F.col("l_shipdate") == F.col("o_orderdate"), "same").otherwise("different")
    return j.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query(
    "a20_type_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{k}' AS type, count({c}) AS present, count(DISTINCT {c}) AS distinct_values, min(c_custkey) FILTER (WHERE {c} IS NOT NULL) AS first_position, max(length({c}::varchar))::INT AS longest FROM customer"
        for c, k in (("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_mktsegment", "string"))
    ),
)
def _(t):
    return profile.type_profile(t.customer.drop("c_acctbal"), "c_custkey")


@query(
    "a21_missing_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {k} AS kind, count(*) AS rows FROM part GROUP BY kind"
        for c, k in (
            ("p_partkey", "CASE WHEN p_partkey = 0 THEN 'NUMERIC_ZERO' ELSE 'PRESENT' END"),
            ("p_name", "CASE WHEN trim(p_name) = '' THEN 'BLANK' ELSE 'PRESENT' END"),
            ("p_brand", "'PRESENT'"),
            ("p_type", "'PRESENT'"),
            ("p_size", "CASE WHEN p_size = 0 THEN 'NUMERIC_ZERO' ELSE 'PRESENT' END"),
            ("p_retailprice", "CASE WHEN p_retailprice = 0 THEN 'NUMERIC_ZERO' ELSE 'PRESENT' END"),
        )
    ),
)
def _(t):
    return profile.missing_profile(t.part)


@query("p19_missing_taxonomy", "SELECT CASE WHEN doc_id = 0 THEN 'NUMERIC_ZERO' ELSE 'PRESENT' END AS id_kind, CASE WHEN text IS NULL THEN 'NULL' WHEN trim(text) = '' THEN 'BLANK' ELSE 'PRESENT' END AS text_kind, count(*) AS n FROM documents GROUP BY ALL")
def _(t):
    from pyspark.sql import types as T

    from ..functions.cells import missing_kind

    d = t.documents
    return d.groupBy(missing_kind(T.LongType(), F.col("doc_id")).alias("id_kind"), missing_kind(T.StringType(), F.col("text")).alias("text_kind")).agg(F.count("*").alias("n"))


def _cell_sql(*names: str) -> str:
    return " || ".join(f"'{n}=' || coalesce(length({n}::VARCHAR) || ':' || {n}::VARCHAR, '-') || chr(10)" for n in sorted(names))


@query("a22_fingerprint", f"SELECT count(*) AS rows, (sum(n) % 2305843009213693952)::BIGINT AS sum_hash, bit_xor(n) AS xor_hash FROM (SELECT ('0x' || substr(sha256({_cell_sql('doc_id', 'text', 'lang', 'source', 'n_chars')}), 1, 12))::BIGINT AS n FROM documents)")
def _(t):
    return t.documents.agg(*hashes.cell_fingerprint({c: F.col(c) for c in t.documents.columns}))


@query("a23_set_hash", "SELECT lang, sha256(string_agg(source, chr(10) ORDER BY source)) AS h FROM (SELECT DISTINCT lang, source FROM documents) GROUP BY lang")
def _(t):
    return t.documents.groupBy("lang").agg(hashes.set_hash(F.col("source")).alias("h"))


@query("a25_sequence_complete", "SELECT count(*) AS n, min(o_orderkey) = 0 AND max(o_orderkey) = count(*) - 1 AND count(DISTINCT o_orderkey) = count(*) AS complete FROM orders")
def _(t):
    return profile.sequence_complete(t.orders, "o_orderkey")


@query("a26_state_rollup", "SELECT o_custkey AS doc, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'INCOMPLETE' WHEN bool_or(o_orderstatus = 'O') THEN 'REVIEW' ELSE 'VALIDATED' END AS state FROM orders GROUP BY o_custkey")
def _(t):
    status = F.when(F.col("o_orderstatus") == "P", "ERROR").when(F.col("o_orderstatus") == "O", "REVIEW").otherwise("PRESENT")
    return quality.document_state(t.orders.select(F.col("o_custkey").alias("doc"), status.alias("status")))


@query("a27_ingestion_state", "SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'NEEDS_ATTENTION' WHEN bool_or(o_orderstatus = 'P') THEN 'PROCESSING' ELSE 'FINISHED' END AS roll_up FROM orders GROUP BY o_custkey")
def _(t):
    return graph.roll_up(t.orders, ["o_custkey"], "o_orderstatus", ["F"], ["P"])


@query("a28_state_counts", "SELECT o_orderstatus, coalesce(n, 0)::BIGINT AS n, coalesce(customers, 0)::BIGINT AS customers FROM (VALUES ('F'), ('O'), ('P'), ('X')) v(o_orderstatus) LEFT JOIN (SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1) USING (o_orderstatus)")
def _(t):
    return coverage.state_counts(t.orders, "o_orderstatus", ["F", "O", "P", "X"], F.countDistinct("o_custkey").alias("customers"))


@query("a29_status_matrix", "SELECT source, count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'es') AS es, count(*) FILTER (WHERE lang = 'fr') AS fr FROM documents GROUP BY source")
def _(t):
    return t.documents.groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).count().fillna(0)


@query("a30_dup_hash", "SELECT count(*) AS dup_groups, coalesce(sum(n - 1), 0)::BIGINT AS extra_copies FROM (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)")
def _(t):
    g = identity.duplicate_groups(t.documents.select(F.sha2("text", 256).alias("h")), ["h"])
    return g.agg(F.count("*").alias("dup_groups"), F.coalesce(F.sum("extra"), F.lit(0)).cast("bigint").alias("extra_copies"))


@query("a31_distinct", "SELECT DISTINCT user_id FROM events")
def _(t):
    return t.events.select("user_id").distinct()


@query("u1_union_all", "SELECT doc_id AS id, 'd' AS kind FROM documents UNION ALL SELECT page_id, 'p' FROM pages")
def _(t):
    return t.documents.select(F.col("doc_id").alias("id"), F.lit("d").alias("kind")).unionByName(t.pages.select(F.col("page_id").alias("id"), F.lit("p").alias("kind")))


@query("u2_union_distinct", "SELECT doc_id AS id FROM labels UNION SELECT conv_id FROM conversations")
def _(t):
    return t.labels.select(F.col("doc_id").alias("id")).union(t.conversations.select("conv_id")).distinct()


@query("u3_id_sets", "SELECT 'both' AS part, id FROM (SELECT doc_id AS id FROM labels INTERSECT SELECT page_id FROM pages) UNION ALL SELECT 'left', id FROM (SELECT doc_id AS id FROM labels EXCEPT SELECT page_id FROM pages)")
def _(t):
    a, b = t.labels.select(F.col("doc_id").alias("id")), t.pages.select(F.col("page_id").alias("id"))
    return a.intersect(b).select(F.lit("both").alias("part"), "id").unionByName(a.subtract(b).select(F.lit("left").alias("part"), "id"))


@query("u4_subset", "SELECT count(*) = 0 AS is_subset FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def _(t):
    return t.labels.select("doc_id").subtract(t.documents.select("doc_id")).agg((F.count("*") == 0).alias("is_subset"))


@query("u5_array_sets", "SELECT o_custkey, len(list_filter(a, lambda x: NOT list_contains(b, x)))::INT AS only_f FROM (SELECT o_custkey, coalesce(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'F'), []) AS a, coalesce(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'O'), []) AS b FROM orders GROUP BY 1)")
def _(t):
    side = lambda s: F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority")))
    return t.orders.groupBy("o_custkey").agg(side("F").alias("a"), side("O").alias("b")).select("o_custkey", F.size(F.array_except("a", "b")).alias("only_f"))


@query("u6_unexpected", "SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return t.conversations.join(t.labels, F.col("conv_id") == F.col("doc_id"), "left_anti").select("conv_id", "turn")


@query("d5_source_catalog", "SELECT count(DISTINCT c_custkey) FILTER (WHERE c_custkey <> 0 AND c_nationkey <> 3)::BIGINT AS distinct_ids, count(*) FILTER (WHERE c_custkey = 0 OR c_nationkey = 3)::BIGINT AS rejected, count(*)::BIGINT AS rows FROM customer")
def _(t):
    written = F.concat(F.col("c_custkey").cast("string"), F.when((F.col("c_nationkey") == 3) & (F.col("c_custkey") != 0), " ").otherwise(""))
    return delta.catalog(t.customer, written)
