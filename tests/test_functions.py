"""Expressions against plain Python."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselode.functions.suffix import longest_common
from caselode.functions import cells, dates, hashes, html, keys, text, urls
from caselode.operators import contracts, search

QUERIES = ["STRASSE", "σ", "SS", "i̇", "FFI", "kelvin", "소송", "2006후4086", "77", "true", "목록", " 소송 ", "가.나", "%", "_", "\\", "가[나]", '"가 나"', "없는말", "?"]
TEXTS = ["Straße", "ΣΊΣΥΦΟΣ ς", "İstanbul", "ofﬁce eﬃcient", "KELVIN K", "소송 2006후4086", "가.나 가*나 가[나]", "100% a_b a\\b", '"가 나" 가?나', "", None, "끝\n경계", "77 true 목록"]


@pytest.mark.parametrize("query", QUERIES)
def test_search_is_literal_and_casefolded(spark, query):
    rows = [(i, t, TEXTS[-1 - i]) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    got = {r["id"]: r["matched_columns"] for r in search.search(df, query, columns=["a", "b"]).collect()}
    q = query.strip().casefold()
    want = {i: [c for c, v in (("a", a), ("b", b)) if v is not None and q in v.casefold()] for i, a, b in rows}
    assert got == {k: v for k, v in want.items() if v}


def test_match_never_spans_columns_and_blank_finds_nothing(spark):
    df = spark.createDataFrame([("끝", "경계")], "a string, b string")
    assert search.search(df, "끝\n경계").count() == 0
    assert search.search(df, "  ").count() == 0


def test_search_limits_and_first_eight_columns(spark):
    df = spark.range(270).select("id", *[F.lit("needle").alias(f"c{i:02d}") for i in range(12)])
    for limit, want in ((-1, 1), (0, 1), (30, 30), (1000, 100)):
        rows = search.search(df, "needle", order=["id"], limit=limit).collect()
        assert len(rows) == want
    assert rows[0]["matched_columns"] == [f"c{i:02d}" for i in range(8)]


def test_literal_queries():
    assert text.is_literal("2006후4086 가-힣") and not text.is_literal("2006x") and not text.is_literal("é")


def test_white_space(spark):
    df = spark.createDataFrame([("　 a \tb \n",), (None,)], "x string")
    x = F.col("x")
    assert df.select(text.strip(x), text.compact(x), text.collapse(x)).collect() == [("a \tb", "ab", "a b"), (None, None, None)]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("98다1,98다2", ["98다1", "98다2"]),
        ("98다1, 2 ,3", ["98다1", "98다2", "98다3"]),
        ("2,98다1", []),
        ("98다1,x", []),
        ("98다1,98다1", []),
        ("98다1,1", []),
        ("2008헌바1,2008가합2,3", ["2008헌바1", "2008가합2", "2008가합3"]),
        ("", []),
        (None, []),
        ("98다1,,2", []),
    ],
)
def test_docket_aliases(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(keys.docket_aliases(F.col("x"))).first()[0] == want


def test_decision_kinds_are_exact(spark):
    df = spark.createDataFrame([(" 전원합의체판결 ",), ("판 결",), (None,), ("중간판결",)], "x string")
    assert [r[0] for r in df.select(keys.decision_kind(F.col("x"))).collect()] == ["판결", None, None, "중간판결"]


@pytest.mark.parametrize(
    "raw, want", [("20240230", None), ("2024.02.29", "2024-02-29"), ("2024-1-2", None), ("20260101", "2026-01-01"), (None, None), ("2024-02-29x", None)]
)
def test_dates(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "x string").select(dates.parse_date(F.col("x")).cast("string")).first()[0]
    assert got == want


def test_cited_and_agreed_dates(spark):
    df = spark.createDataFrame([("선고 2001. 2. 3. 판결", "20010203"), ("2001. 2. 3. 및 2002. 2. 3.", "20010203"), ("2001. 2. 31.", "x"), (None, None)], "c string, d string")
    got = df.select(dates.cited_date(F.col("c")).cast("string"), dates.agreed_date(F.col("d"), F.lit("2001-02-03")).cast("string")).collect()
    assert [tuple(r) for r in got] == [("2001-02-03", "2001-02-03"), (None, "2001-02-03"), (None, None), (None, "2001-02-03")]


def test_date_proposals(spark):
    rows = [
        ("대법원 2001. 2. 3. 선고 ★", "x 대법원 2001. 2.3. 선고", None, "READY"),
        ("대법원", "대법원", None, "MISSING_TITLE_DATE"),
        ("2001. 2. 3. 2001. 2. 4.", "", None, "AMBIGUOUS_TITLE"),
        ("2001. 2. 31.", "", None, "INVALID_TITLE_DATE"),
        ("2072. 1. 1.", "", None, "SENTINEL_DATE"),
        ("2001. 2. 3.", "no", None, "TITLE_NOT_CONFIRMED_IN_HTML"),
        ("2001. 2. 3.", "2001. 2. 3.", "20011399", "INVALID_METADATA"),
        ("2001. 2. 3.", "2001. 2. 3.", "20010204", "METADATA_CONFLICT"),
        ("2001. 2. 3.", "2001. 2. 3.", "2001. 2. 3.", "READY"),
        ("2001. 2. 3.", "2001. 2. 3.", "no_info", "READY"),
        (None, None, None, "MISSING_TITLE_DATE"),
    ]
    df = spark.createDataFrame(rows, "t string, h string, m string, want string")
    for r in df.select(dates.decision_date_status(F.col("t"), F.col("h"), F.col("m")).alias("got"), "want").collect():
        assert r.got == r.want
    one, two = "【변론 종결】 2001. 2. 3. 【이유】", "【변론종결일】2001. 2. 3. 2001. 2. 4"
    closing = [("2001. 2. 3.", "", None, "NOT_FOUND"), (one, one, None, "READY"), (one, one, "2001-02-03", "READY"), (two, two, None, "REVIEW_MULTIPLE"), ("", "", "2001-02-03", "EXISTING_DATE_NOT_REPRODUCED"), (one, one, "2001-02-04", "EXISTING_DATE_CONFLICT"), (one, "", None, "NOT_CONFIRMED_IN_HTML"), ("【변론종료】 2001. 13. 1.", "", None, "INVALID_DATE")]
    df = spark.createDataFrame(closing, "t string, h string, e string, want string")
    for r in df.select(dates.closing_date_status(F.col("t"), F.col("h"), F.col("e").cast("date")).alias("got"), "want").collect():
        assert r.got == r.want


def test_cells_round_trip(spark):
    df = spark.createDataFrame([("a", 1, 10**18), (None, None, None), ("", 0, -5)], "s string, i int, b long")
    for f in df.schema:
        got = df.select(cells.untag(cells.tag(f.dataType, F.col(f.name))).alias("x"), F.col(f.name).cast("string").alias("y")).collect()
        assert all(r.x == r.y for r in got)
    big = spark.createDataFrame([("9223372036854775808",)], "x string").select(F.col("x").cast("decimal(38,0)").alias("x"))
    cell = big.select(cells.tag(T.DecimalType(38, 0), F.col("x")).alias("c")).first()["c"]
    assert (cell["encoding"], cell["text"]) == ("BIG_INTEGER", "9223372036854775808")


def test_missing_kinds(spark):
    df = spark.createDataFrame([(None,), (" ",), ("NaN",), ("none",), ("0",), ("x",)], "x string")
    got = [r[0] for r in df.select(cells.missing_kind(T.StringType(), F.col("x"))).collect()]
    assert got == ["NULL", "BLANK", "TEXT_NAN", "TEXT_NONE", "TEXT_0", "PRESENT"]
    nums = spark.createDataFrame([(0.0,), (float("nan"),), (None,), (1.0,)], "x double")
    assert [r[0] for r in nums.select(cells.missing_kind(T.DoubleType(), F.col("x"))).collect()] == ["NUMERIC_ZERO", "NAN", "NULL", "PRESENT"]


def test_hashes(spark):
    import hashlib

    df = spark.createDataFrame([("k",), (None,), ("",)], "x string")
    ids = [r[0] for r in df.select(hashes.canonical_id(F.col("x"))).collect()]
    assert ids[0] == "kc:" + hashlib.sha256(b"canonical-allocation-1\0k").hexdigest()
    h = [r[0] for r in df.select(hashes.record_hash({"x": F.col("x")})).collect()]
    assert len(set(h)) == 3


def test_urls(spark):
    rows = [("https://a.example/p?x=1", True), ("https://u:p@a.example/", False), ("https://a.example/#f", False), ("ftp://a.example/", False), ("https://a.example/?TOKEN=1", False), (None, False), ("not a url", False)]
    df = spark.createDataFrame(rows, "u string, want boolean")
    assert all(r.got == r.want for r in df.select(urls.is_safe(F.col("u")).alias("got"), "want").collect())
    ok = df.select(urls.is_endpoint(F.col("u"), "https", "a.example", "/p", ["x"])).collect()
    assert [r[0] for r in ok] == [True] + [False] * 6
    j = spark.createDataFrame([("https://a.example/b/c", "../d")], "b string, r string").select(urls.joined()(F.col("b"), F.col("r"))).first()[0]
    assert j == "https://a.example/d"


PAGE = "<h2>T</h2><p>a<br>b</p><script>no</script><table><tr><td>x</td><td>y</td></tr></table><a name=linkPrvs jtable='&lt;table&gt;'>law 1</a><a jtable=''>law 2</a><template><img src=h.png></template>😀<img src='i.png' name=n>"


def test_html():
    assert html.visible_text(PAGE).startswith("T\na\nb\nx\ty\t\nlaw 1law 2")
    imgs = html.occurrences(PAGE, "img")
    assert [(i["hidden"], i["target"]) for i in imgs] == [(True, "h.png"), (False, "i.png")]
    assert all(PAGE[i["start"] : i["end"]] == i["source"] for i in imgs)
    assert [(x["status"], x["text"]) for x in html.payload_links(PAGE)] == [("PRESERVED", "law 1"), ("UNLINKED", "law 2")]
    assert [h["label"] for h in html.headings("【주 문】 x\n [참조조문] y")] == ["주문", "참조조문"]
    refs = html.visual_refs("<div style=\"background:url('a.png')\"><img srcset='b.png 1x, c.png 2x' src=data:x>")
    assert [(r["kind"], r["ref"]) for r in refs] == [("css", "a.png"), ("srcset", "b.png"), ("srcset", "c.png"), ("data", "data:x")] or len(refs) == 4
    assert longest_common("abcde", "xbcdy") == "bcd"
    parts = html.sections_of("【주문】A【기타】B【이유】C", ["주문", "이유"], [], "원고")
    assert [(p["label"], p["end"]) for p in parts] == [("주문", 10), ("이유", 15)]


def test_contracts(spark):
    df = spark.createDataFrame([("abc", 1, 2, "b"), ("abc", 1, 9, "b"), (None, 0, 1, "a")], "t string, s int, e int, p string")
    assert [bool(r[0]) for r in df.select(F.coalesce(contracts.span_holds(F.col("t"), F.col("s"), F.col("e"), F.col("p")), F.lit(False))).collect()] == [True, False, False]
    r = df.select(contracts.reasons(text=contracts.not_blank(F.col("t")), small=F.col("e") < 5)).collect()
    assert [x[0] for x in r] == [[], ["small"], ["text"]]


def test_small_functions(spark):
    df = spark.createDataFrame([("서울 고등 법원", 3.0, '{"b":1,"a":2}', " 7 "), (None, 2.5, "x", "")], "c string, f double, j string, t string")
    got = df.select(keys.display_court(F.col("c"), {"서울고등법원": "서울고법"}), keys.id_text(F.col("f")), cells.sorted_object(F.col("j")), cells.whole_number(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("서울고법", "3", '{"a":"2","b":"1"}', 7), (None, "2.5", "x", None)]
    spans = dates.dated_spans("선고 2001. 2. 3. 과 2001. 2. 31.")
    assert [(s["date"], s["start"]) for s in spans] == [("2001-02-03", 3), (None, 17)]
    tag = "<img src=a name='n.png'>"
    assert html.name_span("é" + tag, 1, 1 + len(tag), "n.png") == (18, 23)
    assert html.name_span(tag, 0, len(tag), "other") is None and html.name_span("<img name=a name=a>", 0, 19, "a") is None


def test_more_contracts(spark):
    df = spark.createDataFrame([("SCAN", None, None, "UNKNOWN", None, True), ("SCAN", True, 2, "COMPLETE", "all", True), ("FULL_TEXT", False, 0, "PARTIAL", "all", None)], "tier string, visual boolean, n int, detection string, scope string, ocr boolean")
    got = [list(r[0]) for r in df.select(contracts.fidelity(F.col("tier"), F.col("visual"), F.col("n"), F.col("detection"), F.col("scope"), F.col("ocr"), F.lit("NOT_YET_PROCESSED"))).collect()]
    assert got == [[], [], ["INCOMPLETE_NEGATIVE_DETECTION"]]
    gold = spark.createDataFrame([("ELIGIBLE", contracts.GOLD_CHECKS, []), ("ELIGIBLE", ["schema"], []), ("INELIGIBLE", [], [])], "s string, c array<string>, b array<string>")
    assert [list(r[0]) for r in gold.select(contracts.gold(F.col("s"), F.col("c"), F.col("b"))).collect()] == [[], ["INCOMPLETE_GOLD_ASSESSMENT"], ["MISSING_GOLD_BLOCKER"]]
    snap = spark.createDataFrame([("COMPLETE", 2, 2, 2, "basis", 0, 1, 2, 3), ("COMPLETE", 2, 3, 2, None, 1, 1, 2, 1)], "c string, n int, total int, seen int, basis string, failed int, t0 int, t1 int, t2 int")
    cols = [F.col(c) for c in ("c", "n", "total", "seen", "basis", "failed", "t0", "t1", "t2")]
    assert [list(r[0]) for r in snap.select(contracts.inventory(*cols)).collect()] == [[], ["INVALID_INVENTORY_TIMES", "UNPROVEN_COMPLETE_INVENTORY", "INCOMPLETE_INVENTORY_COUNT"]]
    art = spark.createDataFrame([("a", "p", "blobs/aa/bb", "TEXT"), ("a", "a", "../x", "TEXT"), ("a", None, "ok", "TEXT"), ("a", None, "ok", "RESPONSE_BYTES")], "id string, parent string, path string, kind string")
    assert [list(r[0]) for r in art.select(contracts.artifact(F.col("id"), F.col("parent"), F.col("path"), F.col("kind"))).collect()] == [[], ["INVALID_STORAGE_KEY", "SELF_PARENT_ARTIFACT"], ["MISSING_PARENT_ARTIFACT"], []]


def test_event_tables():
    from caselode.functions.events import Page, attribute_spans

    page = Page("<div>a<p>b</div>c</p><img><template>x</div>y</template>z")
    rows = {(e.kind, e.name): e for e in page.rows}
    assert rows["text", "b"].shown and [x.name for x in page.around(page.rows.index(rows["text", "b"]))] == ["p", "div"]
    assert rows["text", "c"].parent is None and rows["close", "p"].partner is None  # div took p with it
    assert not rows["text", "y"].shown and rows["text", "z"].shown  # what is hidden ends with its own tag
    assert rows["text", "z"].before == 3 and rows["open", "img"].before == 3
    tag = "<img  NAME = 'a b' src=x.png/ alt=\"q'\" checked name2>"
    spans = attribute_spans(tag)
    assert [(n, tag[a:b] if a is not None else None) for n, a, b in spans] == [("name", "a b"), ("src", "x.png/"), ("alt", "q'"), ("checked", None), ("name2", None)]
    assert attribute_spans("<br>") == [] and attribute_spans("<a b=") == [("b", 5, 5)]


def test_diagnosis_and_inspection(spark):
    page = (
        "<i class='x contImagePath' name=n value=f.png></i><i class=contImagePath name=m value=a></i><i class=contImagePath name=m value=b></i>"
        "<img src='/p?contId=7&attachImgNm=q.png' alt=A><img name=n><img name=m><img name=z><img src='ftp://h/x'><img src='https://other.example/y'>"
        "<a href='#' onclick=\"fncLawPop('1')\">법</a><a href='x.PDF'>p</a><table jtable=''><tr><td jtable=q></table><style>판결요지</style>판시 사항 이유"
    )
    d = html.diagnosis(page, "https://base.example/d/")
    assert [(i["url"], i["state"]) for i in d["images"]] == [("https://base.example/p?contId=7&attachImgNm=q.png", "REFERENCED"), (None, "MAPPED"), (None, "AMBIGUOUS_PROVIDER_MAPPING"), (None, "UNMAPPED"), (None, "REFERENCED"), ("https://other.example/y", "REFERENCED")]
    assert (len(d["statute_links"]), d["tables"], d["payloads"], d["pdf_links"], d["editorial"]) == (1, 1, 1, 1, ["이유"])
    seen = html.inspection(page)
    assert [i["reference_status"] for i in seen["images"]] == ["LEGACY_REFERENCE_REQUIRES_MAPPING", "MISSING_SRC", "MISSING_SRC", "MISSING_SRC", "UNSUPPORTED_SCHEME", "UNVERIFIED_EXTERNAL_REFERENCE"]
    assert seen["images"][0]["legacy_cont_ids"] == ["7"] and seen["images"][0]["legacy_filenames"] == ["q.png"] and seen["missing_src_body_images"] == 3
    df = spark.createDataFrame([(page,), (None,)], "h string")
    got = df.select(html.inspection_udf()(F.col("h")).alias("i"), html.diagnosis_udf("https://b.example/")(F.col("h")).alias("d")).select("i.body_images", "d.tables").collect()
    assert [tuple(r) for r in got] == [(6, 1), (None, None)]


def test_headings_without_any():
    assert html.headings("no heading") == [] and html.headings("") == []
    assert [h["label"] for h in html.headings("【이 유 주1)주2)】x【주2) 앞】")] == ["이유", "주2)앞"]


def test_visual_refs_are_whole():
    data, signed = "data:image/png;base64," + "A" * 500, "https://x.y/i?" + "s" * 400
    of = lambda h: [(r["kind"], r["ref"]) for r in html.visual_refs(h)]
    assert of(f'<img src="{data}"><img src={signed}1><img src={signed}2>') == [("data", data), ("attribute", signed + "1"), ("attribute", signed + "2")]
    assert of('<img src="a b.png">') == [("attribute", "a b.png")]
    assert of(f'<source srcset="{data} 1x, c.png 2x">') == [("data", data), ("srcset", "c.png")]
    assert of('<object data="o.swf"></object><svg:image xlink:href="i.png"/>') == [("attribute", "o.swf"), ("attribute", "i.png")]
    assert of("<svg width=1></svg><picture></picture>") == [("element", "<svg width=1>"), ("element", "<picture>")]
    assert of("<style>a{x:url(d.png)}") == [("css", "d.png")]
    assert of(f'<td data-pic="x {data}">') == [("data", f"x {data}")]
    assert of("<style>a{background:url(\"data:image/svg+xml,<svg a='b'>\")} b{x:url(c.png)}</style>") == [("data", "data:image/svg+xml,<svg a='b'>"), ("css", "c.png")]
