"""Operators on documents' markup, over pages made from the test tables' own texts.

The tables lack images, payloads and decisions' titles, so each query wraps
what a row has (a word of its title, its number, its URL, its day) in such
markup. The wrapping is SQL that Spark and DuckDB read alike; what must come
out is DuckDB's SQL over the same pieces.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import markup as M
from ..operators import case_fields, documents, fields, links
from ..session import ship
from ..storage import dealt
from .derived_plans import _COMPACT, _D, _M, _Y, derived
from .registry import query

#: A page's number, a word of its title, how many images and tables more it gets.
PIECES = {"i": "CAST(page_id AS STRING)", "w": "concat('t', regexp_extract(html, '<title>[^A-Za-z]*([A-Za-z]+)', 1))", "n": "CAST(page_id % 4 AS INT)", "m": "CAST(page_id % 3 AS INT)", "odd": "page_id % 2 = 1"}
ORDERS = {"i": "CAST(o_orderkey AS STRING)", "c": "CAST(o_custkey AS STRING)", "y": _Y, "mo": _M, "d": _D, "ymd": _COMPACT, "k": "o_orderkey % 6"}
OLD = (
    """concat('<strong>', w, ' [공2001,1]</strong><p>가 <img src="/a/', i, '.png" name="ImageId', i, '"> 나</p>','<a name="linkPrvs" jtable="&lt;table&gt;&lt;img src=q', i, '.png&gt;&lt;/table&gt;">민법  제', i, '조</a><a jtable="">형법</a><a jtable="실패', i, '">상법</a>',"""
    """'<table><tr><td colspan="2" rowspan="999" onclick="x()">표<img src="alert_img_01.png" alt="알림"></td></tr></table><template><img src="h.png"></template><script>var a = "<p>";</script>', repeat('<img src="k.png">', n), repeat('<table><tr><td>x</td></tr></table>', m))"""
)
NEW = """concat('<h2>', w, ': 확정</h2><div style="background:url(b', i, '.png)">가<img name="img', i, '">나</div><svg width=1></svg>')"""
BOTH = f"CASE WHEN odd THEN {NEW} ELSE {OLD} END"


def _select(pieces: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in pieces.items())


def made(t, table: str, key: str, pieces: dict[str, str], deal: str | None = None, **more: str):
    """key, the pieces, and further columns made of them; deal: the piece by which rows are dealt before the rest is made."""
    df = getattr(t, table)
    ship(df.sparkSession)
    rows = df.selectExpr(key, *[f"{e} AS {c}" for c, e in pieces.items()])
    return (rows if deal is None else dealt(rows, deal)).selectExpr("*", *[f"{e} AS {c}" for c, e in more.items()])


def pages(t, html: str):
    return made(t, "pages", "page_id", PIECES, page=html)


def of_pages(sql: str, html: str | None = None) -> str:
    """SQL over p: page_id, url, the pieces and, if asked for, the page."""
    inner = f"SELECT page_id, url, {_select(PIECES)} FROM pages"
    return f"WITH p AS (SELECT *{f', {html} AS page' if html else ''} FROM ({inner})) {sql}"


def of_orders(sql: str) -> str:
    return f"WITH p AS (SELECT o_orderkey, {_select(ORDERS)} FROM orders) {sql}"


@query(
    "h4_payload_links",
    of_pages(
        """SELECT page_id, 0 AS "order", 'PRESERVED' AS status, sha256('<table><img src=q' || i || '.png></table>') AS payload_sha256, length('<table><img src=q' || i || '.png></table>')::INT AS payload_characters, '민법 제' || i || '조' AS text FROM p
           UNION ALL SELECT page_id, 1, 'UNLINKED', sha256(''), 0, '형법' FROM p UNION ALL SELECT page_id, 2, 'LEGACY_FAILURE', sha256('실패' || i), (2 + length(i))::INT, '상법' FROM p"""
    ),
)
def _(t):
    return pages(t, OLD).select("page_id", F.inline(H.payload_links_udf()(F.col("page")))).drop("start", "end")


@query("h5_nested_images", of_pages("""SELECT page_id, 0 AS article_order, 0 AS "order", 'q' || i || '.png' AS target FROM p"""))
def _(t):
    return pages(t, OLD).select("page_id", F.inline(M.nested_images_udf()(F.col("page")))).select("page_id", "article_order", "order", "target")


@query(
    "h7_inspection",
    of_pages(
        """SELECT page_id, CASE WHEN odd THEN 0 ELSE 1 + m END::INT AS body_tables, CASE WHEN odd THEN 1 ELSE 3 + n END::INT AS image_occurrences, CASE WHEN odd THEN 1 ELSE 1 + n END::INT AS body_images, (NOT odd)::INT AS provider_ui_images, (NOT odd)::INT AS hidden_images,
                  0 AS table_body_images, odd::INT AS missing_src_body_images, CASE WHEN odd THEN 0 ELSE 3 END::INT AS statute_occurrences, (NOT odd)::INT AS preserved_statutes, (NOT odd)::INT AS failed_statutes, (NOT odd)::INT AS unlinked_statutes FROM p"""
    ),
)
def _(t):
    return pages(t, BOTH).select("page_id", H.inspection_udf()(F.col("page")).alias("i")).select("page_id", "i.*").drop("images")


_STATES = "SELECT page_id, o AS \"order\", CASE o WHEN 1 THEN 'PROVIDER_UI' WHEN 2 THEN 'HIDDEN' ELSE 'BODY' END AS category, o = 1 AS in_table, 'LEGACY_REFERENCE_REQUIRES_MAPPING' AS reference_status"


@query("h7_image_states", of_pages(f"{_STATES} FROM (SELECT page_id, unnest(range(3 + n))::INT AS o FROM p WHERE NOT odd) UNION ALL SELECT page_id, 0, 'BODY', false, 'MISSING_SRC' FROM p WHERE odd"))
def _(t):
    seen = pages(t, BOTH).select("page_id", H.inspection_udf()(F.col("page")).alias("i"))
    return seen.select("page_id", F.inline("i.images")).select("page_id", "order", "category", "in_table", "reference_status")


@query(
    "h15_visual_refs",
    of_pages(
        """SELECT page_id, 'attribute' AS kind, unnest(['/a/' || i || '.png', 'alert_img_01.png', 'h.png']) AS ref FROM p WHERE NOT odd UNION ALL SELECT page_id, 'attribute', 'k.png' FROM (SELECT page_id, unnest(range(n)) FROM p WHERE NOT odd)
           UNION ALL SELECT page_id, 'css', 'b' || i || '.png' FROM p WHERE odd UNION ALL SELECT page_id, 'element', unnest(['<img name="img' || i || '">', '<svg width=1>']) FROM p WHERE odd"""
    ),
)
def _(t):
    return pages(t, BOTH).select("page_id", F.inline(H.visual_refs_udf()(F.col("page")))).select("page_id", "kind", "ref")


@query(
    "h16_safe_html",
    of_pages(
        """SELECT page_id, CASE WHEN odd THEN '<h2>' || w || ': 확정</h2><div>가<img src="images/0" alt="img' || i || '">나</div>'
             ELSE '<strong>' || w || ' [공2001,1]</strong><p>가 <img src="images/0" alt="ImageId' || i || '"> 나</p><a href="#statute-0">민법  제' || i || '조</a><a href="#statute-1">형법</a><a href="#statute-2">상법</a><table><tr><td colspan="2">표<img src="images/1" alt="알림"></td></tr></table>'
                  || coalesce((SELECT string_agg('<img src="images/' || (3 + k) || '" alt="본문 이미지 ' || (4 + k) || '">', '' ORDER BY k) FROM unnest(range(n)) AS r(k)), '') || repeat('<table><tr><td>x</td></tr></table>', m) END AS safe FROM p"""
    ),
)
def _(t):
    return pages(t, BOTH).select("page_id", M.safe_html_udf()(F.col("page")).alias("safe"))


@query("h17_source_titles", of_pages("SELECT page_id, CASE WHEN NOT odd THEN w || ' [공2001,1]' END AS strong_title, CASE WHEN odd THEN w || ': 확정' END AS h2_title FROM p"))
def _(t):
    return pages(t, BOTH).select("page_id", M.source_title_udf("strong", True)(F.col("page")).alias("strong_title"), M.source_title_udf("h2")(F.col("page")).alias("h2_title"))


_AROUND = "concat('<p>', repeat(concat(w, ' '), 40), '</p><script>no</script><img><b>', repeat(concat(i, chr(10)), 50), '</b><img>')"


@query(
    "h18_image_contexts",
    of_pages("""SELECT page_id, 0 AS "order", right(repeat(w, 40), 120) AS before, left(repeat(i, 50), 120) AS after FROM p UNION ALL SELECT page_id, 1, right(repeat(w, 40) || repeat(i, 50), 120), '' FROM p"""),
)
def _(t):
    return pages(t, _AROUND).select("page_id", F.inline(M.contexts_udf()(F.col("page"))))


_FRAME = """replace(concat('<input id=precSeq value=', i, '><input id=precYd value=', CASE WHEN odd THEN '2001' ELSE '20010203' END, '><a onclick="go(`', w, '`,`', i, '`,`prec20010203`)">', w, ' <b>제', i, '조</b></a><a onclick="go(`민법`,`1`,`other`)">다른 것</a>'), '`', chr(39))"""


@query("h13_frame_links", of_pages("SELECT page_id, CASE WHEN odd THEN '2001' ELSE '20010203' END AS day, i AS source_id, CASE WHEN odd THEN 'STRUCTURE_CHANGED' ELSE 'OK' END AS state, w AS law, i AS article, 'prec20010203' AS context, w || ' 제' || i || '조' AS text FROM p"))
def _(t):
    seen = pages(t, _FRAME).select("page_id", M.frame_links_udf("go")(F.col("page")).alias("f"))
    return seen.select("page_id", "f.day", "f.source_id", "f.state", F.inline("f.links"))


@query("h6_body_structure", of_pages("""SELECT page_id, 0 AS "order", false AS hidden, false AS in_table FROM p UNION ALL SELECT page_id, 1, false, true FROM p UNION ALL SELECT page_id, 2, true, false FROM p UNION ALL SELECT page_id, 3 + k, false, true FROM (SELECT page_id, unnest(range(n))::INT AS k FROM p)"""))
def _(t):
    page = "concat(w, '<img><table><tr><td><img></td></tr></table><svg><img></svg>', repeat('<table><tr><th>x<img></th></tr></table>', n))"
    return documents.tag_occurrences(pages(t, page), "page_id", "page", "img").select("page_id", "order", "hidden", "in_table")


_LONG = "repeat(concat('가나다라마바사', i, w), 4)"


@query("j25_occurrence_links", of_pages("SELECT page_id AS source, 0 AS legacy_order, 1 AS current_order, 'x' || i || '.png' AS file FROM p WHERE m > 0"))
def _(t):
    body = lambda first, after: f"""concat({first}, '<p>', {_LONG}, '<img src="x', i, '.png">', {after}, {_LONG}, '</p><p>짧은<img src="y.png">글</p>')"""
    old, new = body("''", "''"), body("""'<img src="w.png">'""", "CASE WHEN m = 0 THEN '다른' ELSE '' END")
    near = lambda page: documents.tag_occurrences(pages(t, page), "page_id", "page", "img").select(F.col("page_id").alias("source"), F.col("target").alias("file"), F.right("before", F.lit(30)).alias("before"), F.left("after", F.lit(30)).alias("after"), "order")
    return documents.match_occurrences(near(old), near(new))


_BODY = "concat('<p>【원고】 ', w, '</p><p>【주 문】 기각한다.</p><p>【이 유】주1) ', i, '</p><p>대법관 ', w, '(재판장)</p><p>[참조조문] 민법 ', i, '</p>')"
SECTIONS = {"order": ["주문"], "reasons": ["이유"], "articles": ["참조조문"]}


@query(
    "h9_text_fields",
    of_pages(
        """SELECT i AS doc, 'order' AS name, '【주 문】 기각한다.' AS value, 'PRESENT' AS status FROM p UNION ALL SELECT i, 'reasons', '【이 유】주1) ' || i || chr(10) || '대법관 ' || w || '(재판장)', 'PRESENT' FROM p
           UNION ALL SELECT i, 'articles', '[참조조문] 민법 ' || i, 'PRESENT' FROM p UNION ALL SELECT i, 'party:원고', w, 'PRESENT' FROM p UNION ALL SELECT i, 'judge:대법관', w || '(재판장)', 'PRESENT' FROM p"""
    ),
)
def _(t):
    return fields.text_fields(pages(t, _BODY), "page_id", "page", SECTIONS, ["articles"]).select("doc", "name", "value", "status")


@query(
    "h8_headings",
    of_pages(
        """, l AS (SELECT page_id, 6 + length(w) AS a, 6 + length(w) + 12 AS b, 6 + length(w) + 12 + 9 + length(i) + 11 + length(w) AS c, 6 + length(w) + 12 + 9 + length(i) + 11 + length(w) + 10 + length(i) AS e FROM p)
           SELECT page_id, '원고' AS label, false AS tail, 0 AS start, a::INT AS "end" FROM l UNION ALL SELECT page_id, '주문', false, a::INT, b::INT FROM l UNION ALL SELECT page_id, '이유', false, b::INT, c::INT FROM l UNION ALL SELECT page_id, '참조조문', true, c::INT, e::INT FROM l"""
    ),
)
def _(t):
    text = H.visible_udf()(F.col("page"))
    return pages(t, _BODY).select("page_id", F.inline(H.headings_udf()(text))).drop("body_start")


# -- titles ------------------------------------------------------------------------

#: k = 0 to 2 are titles; 3 to 5 aren't.
_TITLE = """CASE k WHEN 0 THEN concat('대법원 ', y, '. ', mo, '. ', d, '. 선고 2000다', c, ' 판결 ★') WHEN 1 THEN concat('서울지법 ', y, '.', mo, '.', d, '. 자 99카합', c, ' 결정*') WHEN 2 THEN concat('대법원 ', y, '.', mo, '.', d, '.선고 2000다', c, ' 판결：상고기각·확정')
  WHEN 3 THEN concat('대법원 ', y, '.', mo, '.', d, '.선고 2000다', c, ' 판결:확정') WHEN 4 THEN concat('대법원 ', y, '.', mo, '.', d, '.선고 2000다', c, ' 명령*') ELSE c END"""


@query(
    "f16_title_fields",
    of_orders(
        """SELECT o_orderkey, CASE k WHEN 1 THEN '서울지법' ELSE '대법원' END AS court, y || '.' || mo || '.' || d || '.' AS date, CASE k WHEN 1 THEN '자' ELSE '선고' END AS pronouncement, CASE k WHEN 1 THEN '99카합' ELSE '2000다' END || c AS docket, CASE k WHEN 1 THEN '결정' ELSE '판결' END AS kind,
                  CASE k WHEN 0 THEN '★' WHEN 1 THEN '*' ELSE '' END AS star, CASE k WHEN 2 THEN '：상고기각·확정' ELSE '' END AS suffix,
                  (CASE k WHEN 0 THEN 13 WHEN 1 THEN 11 ELSE 10 END + length(y || mo || d))::INT AS docket_start, (CASE k WHEN 0 THEN 13 WHEN 1 THEN 11 ELSE 10 END + length(y || mo || d) + length(c) + CASE k WHEN 1 THEN 4 ELSE 5 END)::INT AS docket_end FROM p WHERE k < 3"""
    ),
)
def _(t):
    rows = made(t, "orders", "o_orderkey", ORDERS, title=_TITLE)
    return rows.select("o_orderkey", F.inline(M.title_udf()(F.col("title")))).select("o_orderkey", "court", "date", "pronouncement", "docket", "kind", "star", "suffix", "docket_start", "docket_end")


@query("h20_title_evidence", of_orders("SELECT o_orderkey, '서울지방법원' AS court, y || '.' || mo || '.' || d || '.' AS date, '2000다' || c AS docket, '판결' AS kind, '' AS old_suffix, ':확정' AS new_suffix FROM p WHERE k IN (0, 4)"))
def _(t):
    old = "concat(CASE WHEN k = 4 THEN '서울지방법원' ELSE '서울지법' END, ' ', y, '. ', mo, '. ', d, '. 선고 2000다', c, CASE WHEN k = 1 THEN '9' ELSE '' END, ' 판결')"
    new = "concat('서울지방법원 ', y, '.', mo, '.', d, '. 선고 2000다', c, ' 판결: 확정')"
    rows = made(t, "orders", "o_orderkey", ORDERS, old=old, new=new).selectExpr("*", "concat(CASE WHEN k = 2 THEN '<b>' ELSE '<strong>' END, old, ' [공2001,1]', CASE WHEN k = 2 THEN '</b>' ELSE '</strong>' END, '<p>본문</p>') AS a", "concat('<h2>', new, CASE WHEN k = 3 THEN '!' ELSE '' END, '</h2>') AS b", "k <> 5 AS known")
    seen = rows.select("o_orderkey", F.inline(M.title_evidence_udf({"서울지법": "서울지방법원"})(F.when(F.col("known"), F.col("a")), "b", "old", "new")))
    return seen.select("o_orderkey", "court", "date", "docket", "kind", "old_suffix", "new_suffix")


# -- the sixty fields of a case -------------------------------------------------------

#: k = 0: a full page of a sure provider; 1: an unsure one, a bad day; 2: nothing at all.
CUSTOMERS = {"i": "CAST(c_custkey AS STRING)", "w": "c_mktsegment", "k": "CAST(c_custkey % 3 AS INT)", "s": "CASE WHEN c_custkey % 2 = 0 THEN '다' ELSE '카합' END"}


def cases(t):
    rows = made(t, "customer", "c_custkey", CUSTOMERS, deal="i", page=f"CASE k WHEN 0 THEN concat('<h2>대법원 2023. 2. 3. 선고 2022', s, i, ' 전원합의체 판결 ★</h2>', {_BODY}) WHEN 1 THEN concat('<p>', w, '</p>') END")
    return rows.selectExpr(
        "i AS doc",
        "page AS html",
        "CASE k WHEN 0 THEN '제목' WHEN 1 THEN concat('서울지법 ', w) END AS title",
        "CASE k WHEN 0 THEN map('csNoLstCtt', concat('2022', s, i, ', 2022', s, '9'), 'prnjdgYmd', '20230203', 'cortNm', '대법원', 'csNmLstCtt', w) WHEN 1 THEN map('csNoLstCtt', concat('99', s, i), 'prnjdgYmd', '19990231', 'cortNm', ' ') END AS meta",
        "CASE k WHEN 0 THEN map('판례일련번호', i, '사건번호', concat('2022', s, i)) END AS provider",
        "CASE k WHEN 0 THEN 'EXACT' WHEN 1 THEN 'CONFLICT' END AS provider_status",
    )


#: name -> (value, status, evidence) where k is 0, then where it is 1, as SQL of the pieces.
_CELLS = {
    "case_full_no": ("'대법원 2023. 2. 3. 선고 2022' || s || i || ' 전원합의체 판결 ★'", "PRESENT", "title", "'서울지법 ' || w", "PRESENT", "title"),
    "main_decision": ("'【주 문】 기각한다.'", "PRESENT", "visible text", "NULL", "NOT_PROVIDED", None),
    "applicable_acts_tail": ("'[참조조문] 민법 ' || i", "PRESENT", "visible text", "NULL", "NOT_PROVIDED", None),
    "applicable_acts": ("NULL", "NOT_PROVIDED", None, "NULL", "NOT_PROVIDED", None),
    "party_info_dict": ("""'{"원고":"' || w || '"}'""", "PRESENT", "visible text", "NULL", "NOT_PROVIDED", None),
    "judge": ("""'{"대법관":"' || w || '(재판장)"}'""", "PRESENT", "visible text", "NULL", "NOT_PROVIDED", None),
    "case_no": ("'2022' || s || i", "PRESENT", "metadata:csNoLstCtt", "'99' || s || i", "PRESENT", "metadata:csNoLstCtt"),
    "code": ("s", "PRESENT", "metadata:csNoLstCtt", "s", "PRESENT", "metadata:csNoLstCtt"),
    "decision_date": ("'2023-02-03'", "PRESENT", "metadata:prnjdgYmd", "'19990231'", "ERROR", "metadata:prnjdgYmd"),
    "supreme": ("'true'", "PRESENT", "metadata:cortNm", "'false'", "PRESENT", "metadata:cortNm"),
    "jeonhap": ("'true'", "PRESENT", "title", "'false'", "PRESENT", "title"),
    "important": ("'true'", "PRESENT", "title", "NULL", "NOT_PROVIDED", None),
    "lmeta_serialno": ("i", "PRESENT", "provider:판례일련번호", "NULL", "REVIEW", None),
    "lmeta_saNm": ("NULL", "NOT_PROVIDED", None, "NULL", "REVIEW", None),
    "for_lawschool": ("NULL", "NOT_APPLICABLE", None, "NULL", "NOT_APPLICABLE", None),
    "repealed_cases": ("NULL", "REVIEW", None, "NULL", "REVIEW", None),
}


def of_customers(sql: str) -> str:
    return f"WITH p AS (SELECT c_custkey, {_select(CUSTOMERS)} FROM customer) {sql}"


def _cell_rows() -> str:
    text = lambda x: "NULL" if x is None else f"'{x}'"
    return " UNION ALL ".join(f"SELECT i AS doc, '{name}' AS name, {c[3 * k]} AS value, '{c[3 * k + 1]}' AS status, {text(c[3 * k + 2])} AS evidence FROM p WHERE k = {k}" for name, c in _CELLS.items() for k in (0, 1))


@query("h9_case_fields", of_customers(_cell_rows()))
def _(t):
    rows = case_fields.case_fields(cases(t).where("title is not null"))
    return rows.where(F.col("name").isin(*_CELLS)).select("doc", "name", "value", "status", "evidence")


@query(
    "h9_field_statuses",
    of_customers(
        """SELECT i AS doc, unnest(CASE k WHEN 0 THEN ['PRESENT', 'NOT_PROVIDED', 'NOT_APPLICABLE', 'REVIEW'] ELSE ['NOT_PROVIDED', 'NOT_APPLICABLE', 'REVIEW', 'NOT_PROCESSED', 'PRESENT'] END) AS status,
                  unnest(CASE k WHEN 0 THEN CASE WHEN s = '다' THEN [26, 29, 4, 1] ELSE [25, 29, 4, 2] END ELSE [42, 4, 1, 10, 3] END)::BIGINT AS n FROM p WHERE k <> 1"""
    ),
)
def _(t):
    rows = case_fields.case_fields(cases(t).where("title is null or title = '제목'"))
    return rows.groupBy("doc", "status").agg(F.count("*").alias("n"))


@query("c11_field_contract", of_customers("SELECT i AS doc, CASE c_custkey % 4 WHEN 0 THEN 'FIELDS_CONTRACT_MISMATCH,FIELDS_STATUS_INVALID,FIELDS_EVIDENCE_MISSING' WHEN 1 THEN 'FIELDS_CONTRACT_MISMATCH' ELSE '' END AS errors FROM p"))
def _(t):
    """Fields as they are built, and some that lost rows, evidence or their state on the way."""
    rows, part = case_fields.case_fields(cases(t)), F.col("doc").cast("int") % 4
    left = rows.where((part > 1) | (F.col("position") < 2))
    spoilt = left.withColumn("status", F.when(part > 0, F.col("status")).when(F.col("position") == 1, "DONE").otherwise("PRESENT")).withColumn("evidence", F.when(part > 0, F.col("evidence")))
    return case_fields.contract_errors(spoilt).select("doc", F.array_join("errors", ",").alias("errors"))


_SYMBOLS = ["다", "가단", "라", "가소", "헌가", "두"]
_LABELS = {k: case_fields.symbol_label(k) for k in ("다", "가단", "라", "가소", "두")}
derived(
    "f9_case_symbols",
    "orders",
    {"x": f"CASE o_orderkey % 6 {' '.join(f'WHEN {k} THEN {chr(39)}{x}{chr(39)}' for k, x in enumerate(_SYMBOLS))} END", "day": f"CASE WHEN o_orderstatus <> 'P' THEN concat(CAST(year(o_orderdate) + 27 AS STRING), '-', lpad({_M}, 2, '0'), '-', '15') END"},
    lambda x, day: (lambda c: F.concat_ws("/", F.get_json_object(c["value"], "$.label"), c["status"]))(case_fields.case_sort(x, day.cast("date"))),
    "concat_ws('/', CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in {"다": "민사 · 상고", "가단": "민사 · 제1심 · 단독", "라": "민사 · 항고", "가소": "민사 · 소액", "두": "행정 · 상고"}.items()) + " END, CASE WHEN x <> '헌가' AND day >= '2022-07-29' THEN 'PRESENT' ELSE 'REVIEW' END)",
)
_STATUSES = [*links.BANNERS, "OTHER"]
derived(
    "d53_link_banners",
    "documents",
    {"x": f"CASE doc_id % 8 {' '.join(f'WHEN {k} THEN {chr(39)}{x}{chr(39)}' for k, x in enumerate(_STATUSES))} END"},
    links.banner,
    "CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in links.BANNERS.items()) + f" ELSE '{links.PENDING_BANNER}' END",
)


def _space() -> str:
    import uuid

    return uuid.uuid5(uuid.NAMESPACE_URL, "names").hex


derived(
    "f25_attempt_ids",
    "documents",
    {"a": "CAST(doc_id AS STRING)", "b": "source"},
    lambda a, b: H._each(lambda v: M.attempt_id("names", *json.loads(v)), "string")(F.to_json(F.array(a, b))),
    # RFC 4122, version 5: the first 16 bytes of SHA-1, with version and variant set
    f"(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ((strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1)::INT, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) FROM (SELECT sha1(unhex('{_space()}') || encode(a) || '\\x00'::BLOB || encode(b)) AS h))",
)
