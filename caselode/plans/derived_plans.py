"""Functions and contracts over values made from the test tables' own.

Inputs are SQL that Spark and DuckDB read alike, so each is written once; what
must come out is DuckDB's own SQL over the same inputs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells, dates, html, keys, markup, text, urls
from ..operators import contracts, images
from ..session import ship
from .registry import query

KEYS = {"documents": "doc_id", "orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "pages": "page_id", "supplier": "s_suppkey"}


def derived(name: str, table: str, inputs: dict[str, str], build, want: str) -> None:
    """A query of each row's key and `got`: build(input columns) as text; want: the same as SQL over the inputs."""
    key, made = KEYS[table], ", ".join(f"{e} AS {c}" for c, e in inputs.items())

    def run(t):
        df = getattr(t, table)
        ship(df.sparkSession)
        given = df.select(key, *[F.expr(e).alias(c) for c, e in inputs.items()])
        return given.select(key, build(*[F.col(c) for c in inputs]).cast("string").alias("got"))

    query(name, f"SELECT {key}, CAST({want} AS STRING) AS got FROM (SELECT {key}, {made} FROM {table})")(run)


def listed(x: Column) -> Column:
    return F.array_join(x, ",")


def any_of(*named: tuple[str, str]) -> str:
    """Names of the conditions that hold, in order, as SQL."""
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for cond, name in named) + ")"


# -- names and dockets -----------------------------------------------------------

derived(
    "f5_decision_kinds",
    "orders",
    {"x": "CASE o_orderkey % 9 WHEN 0 THEN ' 전원합의체판결 ' WHEN 1 THEN concat('판', ' ', '결') WHEN 2 THEN NULL WHEN 3 THEN '중간판결' WHEN 4 THEN '재결  ' WHEN 5 THEN '전원합의체결정' WHEN 6 THEN o_orderpriority WHEN 7 THEN '명령' ELSE '결정' END"},
    keys.decision_kind,
    "CASE WHEN trim(x) IN ('판결', '결정', '명령', '재결', '중간판결') THEN trim(x) WHEN trim(x) LIKE '전원합의체__' THEN substr(trim(x), 6) END",
)
derived(
    "f17_display_courts",
    "customer",
    {"x": "concat(substr(c_mktsegment, 1, 3), CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE '' END, substr(c_mktsegment, 4))"},
    lambda x: keys.display_court(x, {"BUILDING": "House", "MACHINERY": "Works"}),
    "CASE replace(x, ' ', '') WHEN 'BUILDING' THEN 'House' WHEN 'MACHINERY' THEN 'Works' ELSE x END",
)
_A, _B = "lpad(CAST(o_custkey % 90000 AS STRING), 5, '0')", "lpad(CAST(o_custkey % 90000 + 1 AS STRING), 5, '0')"
derived(
    "f7_decision_outcomes",
    "orders",
    {
        "m": f"CASE o_orderkey % 5 WHEN 0 THEN concat('2000다', {_A}, ',', {_B}) WHEN 1 THEN NULL WHEN 4 THEN {_A} ELSE concat('2000다', {_A}) END",
        "k": f"concat(CASE WHEN o_orderkey % 5 = 2 THEN '서울지법' ELSE '대법원' END, ':2000다', CASE WHEN o_orderkey % 5 IN (0, 3) THEN {_B} ELSE {_A} END, CASE WHEN o_orderkey % 5 = 0 THEN concat('/대법원:2000다', {_A}) ELSE '' END)",
        "d": "CASE WHEN o_orderstatus = 'P' THEN '기타' ELSE '판결' END",
        "n": "o_orderkey % 5",
        "a": _A,
        "b": _B,
    },
    lambda m, k, d, n, a, b: (
        lambda x: F.concat(x["state"], F.lit(":"), F.array_join(F.transform(x["keys"], lambda i: i["case_number"]), ","))
    )(keys.decision_outcome(F.lit("대법원"), d, F.when(m.isNotNull(), F.array(m)), F.transform(F.split(k, "/"), lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)).alias("court"), F.split_part(x, F.lit(":"), F.lit(2)).alias("case_number"))))),
    "CASE WHEN d = '기타' THEN 'UNKNOWN_KIND:' WHEN n = 2 THEN 'CONFLICTING_DECISION_COURT:' WHEN n = 4 THEN 'UNREADABLE_DOCKET:' WHEN n = 3 THEN 'CONFLICTING_DECISION_DOCKETS:' WHEN n = 0 THEN 'KEYS:2000다' || a || ',2000다' || b ELSE 'KEYS:2000다' || a END",
)
derived(
    "f45_exact_metadata",
    "orders",
    {
        "c": "CASE WHEN o_orderkey % 2 = 0 THEN '대 법원' ELSE '대법원' END",
        "d": f"concat('2000다', {_A}, ',', {_B})",
        "e": f"concat('2000다', {_B}, ',2000다', CASE WHEN o_orderkey % 3 = 0 THEN {_B} ELSE {_A} END)",
        "day": "concat(CAST(year(o_orderdate) AS STRING), '.', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '.', lpad(CAST(day(o_orderdate) AS STRING), 2, '0'))",
        "day2": "concat(CAST(year(o_orderdate) AS STRING), lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), lpad(CAST(CASE WHEN o_orderkey % 5 = 0 THEN 40 ELSE day(o_orderdate) END AS STRING), 2, '0'))",
        "s": "o_orderstatus",
    },
    lambda c, d, e, day, day2, s: keys.exact_metadata({"court": c, "dockets": d, "kind": F.lit("판결"), "day": day}, {"court": F.lit("대법원"), "dockets": e, "kind": F.when(s == "P", "결정").otherwise("전원합의체판결"), "day": day2}),
    # a repeated docket makes the list unreadable
    "s <> 'P' AND replace(day, '.', '') = day2 AND substr(e, 1, 10) <> substr(e, 12)",
)
derived(
    "c16_decision_keys",
    "orders",
    {
        "c": "CASE o_orderkey % 4 WHEN 0 THEN ' 대법원' WHEN 1 THEN NULL ELSE '대법원' END",
        "n": "CASE WHEN o_orderkey % 3 = 0 THEN concat('다', CAST(o_custkey AS STRING)) ELSE concat('2000다', CAST(o_custkey + 1 AS STRING)) END",
        "k": "CASE o_orderstatus WHEN 'F' THEN '판결' WHEN 'O' THEN '결정' ELSE '기타' END",
    },
    lambda c, n, k: listed(contracts.decision_key(c, n, k)),
    any_of(("c IS NULL OR c <> trim(c)", "COURT_SPELLING"), ("NOT regexp_full_match(n, '[0-9]{2,4}다[0-9]+')", "CASE_NUMBER_SPELLING"), ("k = '기타'", "UNKNOWN_KIND")),
)
derived(
    "d13_outcomes",
    "orders",
    {"s": "CASE o_orderkey % 4 WHEN 0 THEN 'EXACT' WHEN 1 THEN 'AMBIGUOUS' WHEN 2 THEN 'UNMATCHED' ELSE 'CONFLICT' END", "n": "o_custkey % 3", "c": "o_orderstatus = 'F'"},
    lambda s, n, c: contracts.exact_outcome(s, n.cast("int"), c),
    "CASE s WHEN 'EXACT' THEN n = 1 AND c WHEN 'UNMATCHED' THEN n = 0 WHEN 'AMBIGUOUS' THEN n > 1 ELSE true END",
)
derived("f39_id_texts", "orders", {"x": "CASE WHEN o_orderkey % 2 = 0 THEN floor(o_totalprice) ELSE o_totalprice END"}, keys.id_text, "CASE WHEN x = floor(x) THEN CAST(CAST(x AS BIGINT) AS STRING) ELSE CAST(x AS STRING) END")
derived(
    "f41_same_numbers",
    "documents",
    {"a": "concat('ImageId', CAST(doc_id AS STRING))", "b": "CASE doc_id % 4 WHEN 0 THEN concat('img', CAST(doc_id AS STRING), '.png') WHEN 1 THEN concat('img', CAST(doc_id + 1 AS STRING)) WHEN 2 THEN source ELSE lang END"},
    images.same_number,
    "regexp_extract(b, '[0-9]+') <> '' AND regexp_extract(a, '[0-9]+') = regexp_extract(b, '[0-9]+')",
)

# -- dates -------------------------------------------------------------------------

_Y, _M, _D = ("CAST(year(o_orderdate) AS STRING)", "CAST(month(o_orderdate) AS STRING)", "CAST(day(o_orderdate) AS STRING)")
_DOTTED = f"concat({_Y}, '. ', {_M}, '. ', {_D}, '.')"
_COMPACT = f"concat({_Y}, lpad({_M}, 2, '0'), lpad({_D}, 2, '0'))"
_ISO = f"concat({_Y}, '-', lpad({_M}, 2, '0'), '-', lpad({_D}, 2, '0'))"
derived(
    "f18_date_proposals",
    "orders",
    {
        "n": "o_orderkey % 8",
        "t": f"CASE o_orderkey % 8 WHEN 1 THEN '대법원' WHEN 2 THEN concat({_DOTTED}, ' 2001. 2. 4.') WHEN 3 THEN '2001. 2. 31.' WHEN 4 THEN '2072. 1. 1.' ELSE concat('대법원 ', {_DOTTED}, ' 선고') END",
        "h": f"CASE WHEN o_orderkey % 8 = 5 THEN o_orderpriority ELSE concat('<b>', {_Y}, '.', {_M}, '. ', {_D}, '.</b> 대법원 ', {_DOTTED}, ' 선고 ', o_orderpriority) END",
        "m": f"CASE o_orderkey % 8 WHEN 6 THEN '20011399' WHEN 7 THEN '18010204' WHEN 0 THEN {_COMPACT} END",
    },
    lambda n, t, h, m: dates.decision_date_status(t, h, m),
    "CASE n WHEN 1 THEN 'MISSING_TITLE_DATE' WHEN 2 THEN 'AMBIGUOUS_TITLE' WHEN 3 THEN 'INVALID_TITLE_DATE' WHEN 4 THEN 'SENTINEL_DATE' WHEN 5 THEN 'TITLE_NOT_CONFIRMED_IN_HTML' WHEN 6 THEN 'INVALID_METADATA' WHEN 7 THEN 'METADATA_CONFLICT' ELSE 'READY' END",
)
derived(
    "f19_closing_dates",
    "orders",
    {
        "n": "o_orderkey % 6",
        "t": f"CASE o_orderkey % 6 WHEN 0 THEN o_orderpriority WHEN 1 THEN concat('【변론종결일】', {_DOTTED}, ' 1066. 2. 4. 【이유】') WHEN 2 THEN concat('【변론종결】 ', {_Y}, '. 13. 1. 【이유】') ELSE concat('글 【변론 종결】 ', {_DOTTED}, ' 【이유】 ', o_orderpriority) END",
        "h": f"CASE WHEN o_orderkey % 6 = 3 THEN '' ELSE concat('글 【변론 종결】 ', {_DOTTED}, ' 【이유】 1066. 2. 4.') END",
        "e": f"CASE WHEN o_orderkey % 6 = 4 THEN '1801-01-01' WHEN o_custkey % 2 = 0 THEN {_ISO} END",
    },
    lambda n, t, h, e: dates.closing_date_status(t, h, e.cast("date")),
    "CASE n WHEN 0 THEN CASE WHEN e IS NULL THEN 'NOT_FOUND' ELSE 'EXISTING_DATE_NOT_REPRODUCED' END WHEN 1 THEN 'REVIEW_MULTIPLE' WHEN 2 THEN 'INVALID_DATE' WHEN 3 THEN 'NOT_CONFIRMED_IN_HTML' WHEN 4 THEN 'EXISTING_DATE_CONFLICT' ELSE 'READY' END",
)
derived(
    "f47_dated_spans",
    "orders",
    {"x": f"concat('선고 ', {_DOTTED}, ' 과 ', {_Y}, '. 2. 31.')", "d": _DOTTED, "y": _Y, "iso": _ISO},
    lambda x, d, y, iso: F.array_join(F.transform(dates.dated_spans_udf()(x), lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"), F.lit("="), F.coalesce(s["date"], F.lit("?")))), ";"),
    "'3-' || (3 + length(d)) || '=' || iso || ';' || (6 + length(d)) || '-' || (6 + length(d) + length(y) + 8) || '=?'",
)
derived(
    "f52_compact_days",
    "orders",
    {"x": f"CASE o_orderkey % 4 WHEN 0 THEN {_ISO} WHEN 1 THEN concat({_Y}, '0230') WHEN 2 THEN NULL ELSE {_COMPACT} END", "n": "o_orderkey % 4", "iso": _ISO},
    lambda x, n, iso: dates.compact_day(x),
    "CASE WHEN n = 3 THEN iso END",
)

# -- values, cells and text ------------------------------------------------------------

derived("f29_sorted_objects", "customer", {"x": """CASE c_custkey % 3 WHEN 0 THEN concat('{"b":', CAST(c_custkey AS STRING), ',"a":"', c_mktsegment, '"}') WHEN 1 THEN concat('[', CAST(c_custkey AS STRING), ']') ELSE c_name END""", "n": "c_custkey % 3", "k": "c_custkey", "s": "c_mktsegment"}, lambda x, n, k, s: cells.sorted_object(x), """CASE WHEN n = 0 THEN '{"a":"' || s || '","b":"' || k || '"}' ELSE x END""")
derived(
    "f48_large_integers",
    "orders",
    {"x": "CAST(o_orderkey AS DECIMAL(38,0)) * 10000000000000"},
    lambda x: F.concat(cells.tag(T.DecimalType(38, 0), x.cast("decimal(38,0)"))["encoding"], F.lit(":"), F.coalesce(cells.untag(cells.tag(T.DecimalType(38, 0), x.cast("decimal(38,0)"))), F.lit(""))),
    "CASE WHEN x > 9223372036854775807 THEN 'BIG_INTEGER:' ELSE 'INTEGER:' END || CAST(x AS DECIMAL(38,0))",
)
derived("f49_lenient_numbers", "orders", {"x": "CASE o_orderkey % 4 WHEN 0 THEN concat(' ', CAST(o_custkey AS STRING), ' ') WHEN 1 THEN o_orderpriority WHEN 2 THEN concat('-', CAST(o_custkey + 1 AS STRING)) ELSE '' END"}, cells.whole_number, "CASE WHEN regexp_full_match(trim(x), '-?[0-9]+') THEN CAST(trim(x) AS BIGINT) END")
derived("f49_scalar_texts", "customer", {"x": "CASE c_custkey % 3 WHEN 0 THEN '  ' WHEN 1 THEN concat(' ', c_name, ' ') ELSE c_name END"}, cells.scalar_text, "nullif(trim(x), '')")
derived("f51_wrapped_values", "customer", {"x": """CASE c_custkey % 3 WHEN 0 THEN concat('{"value": ', CAST(c_custkey AS STRING), '}') WHEN 1 THEN concat('{', c_name) ELSE CAST(c_custkey AS STRING) END""", "n": "c_custkey % 3", "k": "c_custkey"}, lambda x, n, k: cells.wrapped_value(x), "CASE WHEN n = 0 THEN CAST(k AS STRING) ELSE x END")
derived("f42_text_built_ins", "part", {"x": "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE concat(' ', p_type, ',', p_brand) END"}, lambda x: F.coalesce(F.split_part(F.trim(x), F.lit(","), F.lit(1)), F.lit("-")), "coalesce(split_part(trim(x), ',', 1), '-')")
derived(
    "f34_contexts",
    "documents",
    {"x": "coalesce(text, '')", "a": "CAST(floor(length(coalesce(text, '')) / 3) AS INT)", "b": "CAST(floor(length(coalesce(text, '')) / 3) AS INT) + 5"},
    lambda x, a, b: F.concat_ws("|", *text.context(x, a, b, 100)),
    "substr(x, greatest(a - 100, 0) + 1, a - greatest(a - 100, 0)) || '|' || substr(x, b + 1, 100)",
)
derived("c17_structured_spans", "documents", {"x": "text", "a": "doc_id % 50", "b": "doc_id % 50 + doc_id % 7", "p": "substr(text, CAST(doc_id % 50 AS INT) + 1, CAST(doc_id % 7 + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS INT))"}, lambda x, a, b, p: contracts.span_holds(x, a.cast("int"), b.cast("int"), p), "a >= 0 AND b > a AND b <= length(x) AND substr(x, (a + 1)::INT, (b - a)::INT) = p")

# -- URLs and files ------------------------------------------------------------------

_SITE = "regexp_extract(u, '^[a-z]+://[^/?#]*', 0)"
derived(
    "f31_joined_urls",
    "pages",
    {"n": "page_id % 6", "u": "url", "r": "CASE page_id % 6 WHEN 0 THEN concat('/a/', CAST(page_id AS STRING)) WHEN 1 THEN '//h.example/x' WHEN 2 THEN '#f' WHEN 3 THEN NULL WHEN 4 THEN '?q=1' ELSE 'https://z.example/y?k=v' END"},
    lambda n, u, r: urls.joined()(u, r),
    f"CASE n WHEN 0 THEN {_SITE} || r WHEN 1 THEN regexp_extract(u, '^[a-z]+:', 0) || r WHEN 2 THEN split_part(u, '#', 1) || r WHEN 4 THEN split_part(split_part(u, '#', 1), '?', 1) || r WHEN 5 THEN r END",
)
derived("f32_mapping_urls", "documents", {"a": "concat(source, ' ', CAST(doc_id AS STRING), '.png')", "b": "CASE doc_id % 3 WHEN 0 THEN concat(source, ' ', CAST(doc_id AS STRING), '.png') WHEN 1 THEN 'other.png' END"}, lambda a, b: urls.unique_mapping_url(F.array_compact(F.array(a, b)), "https://h/?f="), "CASE WHEN b IS NULL OR a = b THEN 'https://h/?f=' || replace(a, ' ', '+') END")
derived("f50_query_files", "documents", {"x": "CASE WHEN doc_id % 4 = 0 THEN 'https://h/p' ELSE concat('https://h/p?attachImgNm=', source, '%20', CAST(doc_id AS STRING), '.png&x=1') END"}, lambda x: urls.file_name(x, "attachImgNm"), "nullif(replace(regexp_extract(x, 'attachImgNm=([^&]*)', 1), '%20', ' '), '')")
derived(
    "f40_image_types",
    "documents",
    {"x": "concat(CASE doc_id % 7 WHEN 0 THEN 'FFD8FF' WHEN 1 THEN '89504E470D0A1A0A' WHEN 2 THEN '474946383961' WHEN 3 THEN '524946460000000057454250' WHEN 4 THEN '424D' WHEN 5 THEN '52494646' ELSE '' END, lpad(CAST(doc_id AS STRING), 8, '0'))", "n": "doc_id % 7"},
    lambda x, n: images.sniff(F.unhex(x)),
    "CASE n WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'gif' WHEN 3 THEN 'webp' WHEN 4 THEN 'bmp' END",
)
derived(
    "f44_article_params",
    "orders",
    {"n": "o_orderkey % 4", "law": "o_orderpriority", "article": "lpad(CAST(o_custkey AS STRING), 6, '0')", "context": f"CASE o_orderkey % 4 WHEN 0 THEN 'prec' WHEN 1 THEN concat('prec', {_COMPACT}) WHEN 2 THEN 'prec20010231' ELSE 'other' END", "day": "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE '20010203' END", "own": _COMPACT},
    lambda n, law, article, context, day, own: (lambda p: F.concat_ws("/", p["joNo"], p["lsNm"], p["lsId"], p["efYd"], p["mode"], p["lsClsCd"]))(urls.article_params(law, article, context, day)),
    "CASE WHEN n = 1 THEN concat_ws('/', article, law, context, own, '11', 'L') WHEN n = 0 AND day IS NOT NULL THEN concat_ws('/', article, law, 'prec' || day, day, '11', 'L') ELSE '' END",
)

# -- contracts ----------------------------------------------------------------------

derived(
    "c1_artifacts",
    "documents",
    {"i": "CAST(doc_id AS STRING)", "p": "CASE doc_id % 4 WHEN 0 THEN CAST(doc_id AS STRING) WHEN 1 THEN NULL ELSE CAST(doc_id - 1 AS STRING) END", "k": "CASE WHEN doc_id % 3 = 0 THEN '../x' ELSE concat('blobs/', source) END", "r": "CASE WHEN lang = 'en' THEN 'RESPONSE_BYTES' ELSE 'TEXT' END"},
    lambda i, p, k, r: listed(contracts.artifact(i, p, k, r)),
    any_of(("k = '../x'", "INVALID_STORAGE_KEY"), ("p = i", "SELF_PARENT_ARTIFACT"), ("p IS NULL AND r = 'TEXT'", "MISSING_PARENT_ARTIFACT")),
)
derived("c2_acquisitions", "documents", {"s": "CASE doc_id % 3 WHEN 0 THEN 'ACQUIRED' WHEN 1 THEN 'FAILED' ELSE 'PENDING' END", "a": "CASE WHEN lang = 'en' THEN source END", "f": "CASE WHEN doc_id % 5 < 3 THEN lang END"}, contracts.acquired_iff, "CASE s WHEN 'ACQUIRED' THEN a IS NOT NULL AND f IS NULL WHEN 'FAILED' THEN a IS NULL AND f IS NOT NULL ELSE a IS NULL AND f IS NULL END")
derived(
    "c4_blocks",
    "documents",
    {"b": "CAST(doc_id AS STRING)", "p": "CASE doc_id % 3 WHEN 0 THEN CAST(doc_id AS STRING) WHEN 1 THEN NULL ELSE '-1' END", "a": "source", "s": "CASE doc_id % 5 WHEN 0 THEN 'other' WHEN 1 THEN NULL ELSE source END", "k": "CASE WHEN lang = 'en' THEN 'text' ELSE 'image' END", "x": "CASE WHEN doc_id % 2 = 0 THEN lang END"},
    lambda *x: listed(contracts.block(*x)),
    any_of(("p = b", "SELF_PARENT_BLOCK"), ("s <> a", "BLOCK_ARTIFACT_MISMATCH"), ("k = 'image' AND x IS NULL", "MISSING_ASSET_REFERENCE")),
)
derived(
    "c4_fidelity",
    "documents",
    {"t": "CASE WHEN lang = 'en' THEN 'SCAN' ELSE 'FULL_TEXT' END", "v": "CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END", "n": "CAST(CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN doc_id % 2 ELSE 0 END AS INT)", "d": "CASE doc_id % 3 WHEN 0 THEN 'UNKNOWN' ELSE CASE WHEN doc_id % 5 = 0 THEN 'PARTIAL' ELSE 'COMPLETE' END END", "s": "CASE WHEN doc_id % 7 <> 0 THEN 'all' END", "o": "CASE WHEN doc_id % 11 <> 0 THEN true END"},
    lambda t, v, n, d, s, o: listed(contracts.fidelity(t, v, n, d, s, o, F.lit("NOT_YET_PROCESSED"))),
    any_of(("d <> 'UNKNOWN' AND s IS NULL", "MISSING_DETECTION_SCOPE"), ("v = false AND d <> 'COMPLETE'", "INCOMPLETE_NEGATIVE_DETECTION"), ("v = true AND n = 0", "CONFLICTING_VISUAL_COUNT"), ("t = 'SCAN' AND o IS NULL", "SCAN_REQUIRES_OCR")),
)
derived(
    "c7_gold",
    "documents",
    {"s": "CASE WHEN doc_id % 2 = 0 THEN 'ELIGIBLE' ELSE 'INELIGIBLE' END", "c": f"CASE WHEN doc_id % 3 = 0 THEN '{contracts.GOLD_CHECKS[0]}' ELSE '{','.join(contracts.GOLD_CHECKS)}' END", "b": "CASE WHEN doc_id % 5 = 0 THEN lang END"},
    lambda s, c, b: listed(contracts.gold(s, F.split(c, ","), F.array_compact(F.array(b)))),
    any_of(("s = 'ELIGIBLE' AND (length(c) - length(replace(c, ',', '')) <> 6 OR b IS NOT NULL)", "INCOMPLETE_GOLD_ASSESSMENT"), ("s = 'INELIGIBLE' AND b IS NULL", "MISSING_GOLD_BLOCKER")),
)
derived(
    "c8_evidence",
    "documents",
    {"t": "CASE WHEN doc_id % 7 <> 0 THEN text END", "a": "CAST(doc_id % 20 AS INT)", "b": "CAST(doc_id % 20 + 4 AS INT)", "q": "CASE WHEN doc_id % 3 = 0 THEN lang ELSE substr(text, CAST(doc_id % 20 AS INT) + 1, 4) END", "v": "doc_id % 5 <> 0"},
    lambda *x: listed(contracts.evidence(*x)),
    "CASE WHEN t IS NULL THEN concat_ws(',', 'EVIDENCE_SOURCE_NOT_LOADED', CASE WHEN NOT v THEN 'EVIDENCE_SOURCE_VERSION_MISMATCH' END) ELSE " + any_of(("NOT v", "EVIDENCE_SOURCE_VERSION_MISMATCH"), ("b > length(t) OR substr(t, a + 1, b - a) <> q", "TEXT_SPAN_MISMATCH")) + " END",
)
derived(
    "c9_inventories",
    "orders",
    {"c": "CASE o_orderstatus WHEN 'F' THEN 'COMPLETE' ELSE 'PARTIAL' END", "n": "CAST(o_custkey % 5 AS INT)", "t": "CAST(o_custkey % 5 + CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS INT)", "o": "CAST(o_custkey % 5 - CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END AS INT)", "b": "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END", "f": "CAST(CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS INT)", "s": "1", "e": "2", "r": "CAST(CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 2 END AS INT)"},
    lambda *x: listed(contracts.inventory(*x)),
    any_of(("n <> o", "INVENTORY_COUNT_MISMATCH"), ("r < e", "INVALID_INVENTORY_TIMES"), ("c = 'COMPLETE' AND (b IS NULL OR f > 0)", "UNPROVEN_COMPLETE_INVENTORY"), ("c = 'COMPLETE' AND n <> t", "INCOMPLETE_INVENTORY_COUNT")),
)
derived(
    "c10_legacy_records",
    "documents",
    {"i": "concat('legacy-row:', source, ':', CAST(doc_id + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS STRING))", "s": "source", "p": "doc_id", "k": "CASE WHEN doc_id % 3 = 0 THEN concat(lang, ',', lang) ELSE concat(lang, ',', source) END", "b": "CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END", "st": "'PRESERVED'"},
    lambda i, s, p, k, b, st: listed(contracts.legacy_record(i, s, p, F.split(k, ","), b, st)),
    any_of(("i <> 'legacy-row:' || s || ':' || p", "LEGACY_PRESERVATION_ID_MISMATCH"), ("split_part(k, ',', 1) = split_part(k, ',', 2)", "DUPLICATE_SOURCE_KEY"), ("b = ''", "LEGACY_BODY_STATE_MISMATCH")),
)
derived(
    "c12_check_rules",
    "orders",
    {"d": "CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE repeat(lpad(CAST(o_orderkey % 100000000 AS STRING), 8, '0'), 8) END", "n": "o_orderkey % 5 - 1", "r": "o_orderkey % 4", "u": "CASE WHEN o_orderkey % 7 = 0 THEN concat('ftp://', CAST(o_custkey AS STRING)) ELSE concat('https://a.example/', CAST(o_custkey AS STRING)) END", "s": "o_totalprice / 300000"},
    lambda d, n, r, u, s: listed(contracts.reasons(digest=contracts.digest(d), count=contracts.count_value(n), revision=contracts.revision_value(r), url=contracts.safe_url(u), score=contracts.score(s))),
    any_of(("NOT regexp_full_match(d, '[0-9a-f]{64}')", "digest"), ("n < 0", "count"), ("r < 1", "revision"), ("u LIKE 'ftp%'", "url"), ("s > 1 OR s < 0", "score")),
)

# -- small forms that run in Python -------------------------------------------------

derived("f35_common_evidence", "documents", {"a": "concat('[', source, ']', lang)", "b": "concat(lang, '<', source, '>')", "s": "source"}, lambda a, b, s: html.evidence_udf()(a, b), "s")
derived("f53_name_spans", "pages", {"h": """concat('가<img src=x name="', CAST(page_id AS STRING), '">', CASE WHEN page_id % 3 = 0 THEN 'x' ELSE '' END)""", "w": "CASE WHEN page_id % 4 = 0 THEN 'other' ELSE CAST(page_id AS STRING) END", "k": "page_id"}, lambda h, w, k: listed(html._each(lambda v: [str(x) for x in html.name_span(v.split("|")[0], 1, v.split("|")[0].rindex(">") + 1, v.split("|")[1]) or []], "array<string>")(F.concat_ws("|", h, w))), "CASE WHEN w = 'other' THEN '' ELSE '18,' || (18 + length(CAST(k AS STRING))) END")
derived("h14_article_tables", "pages", {"h": """concat('x<table summary="s"><tr><td>', url, '<table></table></td></tr></table>', CASE WHEN page_id % 3 = 0 THEN '<table summary="s"></table>' ELSE '<table></table>' END)""", "u": "url", "n": "page_id % 3"}, lambda h, u, n: html._each(lambda v: markup.one_table(v, "s"), "string")(h), """CASE WHEN n > 0 THEN '<table summary="s"><tr><td>' || u || '<table></table></td></tr></table>' END""")


def _tree(v: str) -> str:
    import json

    return json.dumps(markup.typed_tree([int(v), v, float("nan")]))


derived("f28_typed_trees", "customer", {"x": "CAST(c_custkey AS STRING)"}, lambda x: html._each(_tree, "string")(x), """'{"type": "builtins.list", "value": [{"type": "builtins.int", "value": ' || x || '}, {"type": "builtins.str", "value": "' || x || '"}, {"type": "builtins.float", "value": "nan"}]}'""")
