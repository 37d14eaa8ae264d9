"""Markup functions and versioned documents."""

import pytest
from pyspark.sql import functions as F

from caselode.functions import markup
from caselode.operators import revisions
from caselode.operators.sinks import read_sink


def test_titles():
    raw = "대법원 2001. 2. 3. 선고 2000다 1 판결 ★"
    t = markup.title_fields(raw)
    assert (t["court"], t["date"], t["docket"], t["kind"], t["star"]) == ("대법원", "2001.2.3.", "2000다1", "판결", "★")
    assert raw[t["docket_start"] : t["docket_end"]] == "2000다 1" and t["suffix_start"] is None
    assert markup.title_fields("대법원 2001. 2. 3. 선고 2000다1 명령*") is None and markup.title_fields("x") is None
    assert markup.title_fields("대법원 2001.2.3.자 2000다1 결정: 확정") is None


def test_headings_and_contexts():
    assert markup.source_title("<h2>a b</h2>") == "a b"
    assert markup.source_title("<h2 class=x>a</h2>") is None and markup.source_title("<h2>a</h2><h2>b</h2>") is None
    assert markup.source_title("<div hidden><h2>a</h2></div><h2>b</h2>") == "b"
    c = markup.image_contexts("<p>a b</p><script>no</script><img><p>c d</p>")
    assert c == [{"order": 0, "before": "ab", "after": "cd"}]


def test_frames_tables_and_rendering():
    html = "<input id=precSeq value=9><input id=precYd value=20010203><a onclick=\"go('L','1','prec')\">law  1</a><a onclick=\"go('L','1','x')\">n</a>"
    got = markup.frame_links(html, "go")
    assert got["state"] == "OK" and got["source_id"] == "9" and [x["text"] for x in got["links"]] == ["law 1"]
    assert markup.frame_links("<a>", "go")["state"] == "STRUCTURE_CHANGED"
    assert markup.one_table("x<table summary=s><tr><td><table></table></td></tr></table>y", "s").endswith("</table></td></tr></table>")
    assert markup.one_table("<table summary=s></table><table summary=s></table>", "s") is None
    safe = markup.safe_html("<p onclick=x>a&lt;b<script>bad()</script><img src=j><a jtable='<table>'>law</a><blink>z</blink></p>")
    assert safe == '<p>a&lt;b<img src="images/0" alt="본문 이미지 1"><a href="#statute-0">law</a>z</p>'
    nested = markup.nested_images("<a jtable='&lt;img src=i.png&gt;'>x</a>")
    assert nested[0]["target"] == "i.png"


def test_titles_are_written_in_known_ways():
    ok = ["대법원 2001.2.3.선고 2000다1 판결：상고", "대법원 2001.2.3.선고 2000다1 판결: 상고기각", "대법원 2001.2.3.선고 2000다1 판결: 확정"]
    bad = ["대법원 2001.2.3.선고 2000다1 판결:확정", "대법원 2001.2.3.선고 2000다1 판결: 상고기각·확정", "대법원 2001.2.3.선고 2000다1 결정: 확정", "대법원 2001.2.3.선고 2000다1 판결: 기타"]
    assert all(markup.title_fields(t) for t in ok) and not any(markup.title_fields(t) for t in bad)
    assert markup.title_fields(ok[2])["suffix"] == ":확정" and markup.title_fields("") is None


def test_leading_headings():
    page = "<strong>첫 제목</strong>본문<strong>강조</strong>"
    assert markup.source_title(page, "strong") is None and markup.source_title(page, "strong", leading=True) == "첫 제목"
    assert markup.source_title("글<strong>늦음</strong>", "strong", leading=True) is None
    assert markup.source_title("<strong>열림", "strong") is None and markup.source_title("<strong><b>x</b></strong>", "strong") is None
    assert markup.source_title("<p style='Display : none'><h2>숨김</h2></p><h2>보임</h2>") == "보임"


def test_title_evidence():
    old, new = "<strong>서울지법 2001. 2. 3. 선고 2000다1 판결 [공]</strong>본문", "<h2>서울지방법원 2001.2.3.선고 2000다1 판결★</h2>"
    titles = "서울지법 2001. 2. 3. 선고 2000다1 판결", "서울지방법원 2001.2.3.선고 2000다1 판결★"
    courts = {"서울지법": "서울지방법원"}
    got = markup.title_evidence(old, new, *titles, courts)
    assert (got["court"], got["new_star"], got["old_star"], got["old_heading"]) == ("서울지방법원", "★", "", "서울지법 2001. 2. 3. 선고 2000다1 판결 [공]")
    assert markup.title_evidence(old, new, *titles, {}) is None  # courts differ
    assert markup.title_evidence(old, new, titles[0].replace("2000다1", "2000다2"), titles[1], courts) is None
    assert markup.title_evidence("<p>제목 없음</p>", new, *titles, courts) is None
    assert markup.title_evidence(old, new, "제목", titles[1], courts) is None


def test_rendering_of_missing_images_and_cells():
    html = "<table><tr><td colspan=2 rowspan=101 id=x>a</td><th rowspan='3'>b</th><td colspan=x></td></tr></table><img alt='<i>'><template><img></template><img name=n>"
    got = markup.safe_html(html, "i", ["FAILED", "ACQUIRED", "OTHER"])
    assert got.startswith('<table><tr><td colspan="2">a</td><th rowspan="3">b</th><td></td></tr></table>')
    assert got.endswith('<span class="missing-image" role="note">[이미지 취득 실패: &lt;i&gt;]</span><span class="missing-image" role="note">[이미지 미확보: n]</span>')
    with pytest.raises(ValueError):
        markup.safe_html(html, "i", ["ACQUIRED"])
    assert markup.safe_html("<a jtable=x>열린 <a jtable=y>둘") == '<a href="#statute-0">열린 </a><a href="#statute-1">둘</a>'
    assert markup.safe_html("a<br>b<br/>c</br></p>") == "a<br>b<br>c</p>"


def test_typed_tree_and_ids():
    t = markup.typed_tree({"a": [1, float("inf"), (None, True)]})
    assert t["value"][0][1]["value"][1] == {"type": "builtins.float", "value": "+inf"}
    with pytest.raises(TypeError):
        markup.typed_tree({"a": object()})
    assert markup.attempt_id("n", "a", "b") == markup.attempt_id("n", "a", "b") != markup.attempt_id("n", "ab", "")


def test_udfs(spark):
    df = spark.createDataFrame([("<h2>대법원 2001.2.3.선고 2000다1 판결</h2>",), (None,)], "h string")
    r = df.select(markup.source_title_udf()(F.col("h")).alias("t")).select(F.size(markup.title_udf()(F.col("t"))).alias("n"), "t").collect()
    assert r[0].n == 1 and r[1].t is None
    f = df.select(markup.frame_links_udf("go")(F.col("h")).alias("f")).select("f.state").collect()
    assert [x.state for x in f] == ["STRUCTURE_CHANGED", "MISSING"]


def test_revisions(spark, tmp_path):
    docs = spark.createDataFrame([("a", 2), ("b", 1)], "doc string, current_revision int")
    revs = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "doc string, revision int, v string")
    assert sorted((r.doc, r.v) for r in revisions.current(docs, revs).collect()) == [("a", "y"), ("b", "z")]
    keyed = spark.createDataFrame([("a", "k"), ("b", "m"), ("c", "m")], "doc string, key string")
    want = spark.createDataFrame([("k",), ("m",), ("q",)], "key string")
    assert sorted((r.key, r.state, r.doc) for r in revisions.find(keyed, want, ["key"]).collect()) == [("k", "FOUND", "a"), ("m", "NOT_UNIQUE", None), ("q", "NOT_FOUND", None)]
    log = spark.createDataFrame([(1, "e"), (2, "f"), (3, "g")], "sequence int, e string")
    assert revisions.is_prefix(log.where("sequence < 3"), log).first()[0] and not revisions.is_prefix(log.where("sequence > 1"), log).first()[0]
    inc = spark.createDataFrame([("s", "1", "x", 1), ("s", "1", "x", 2), ("s", "1", "y", 3)], "source string, id string, body string, received_at int")
    fresh, receipts = revisions.preserve(fresh_none(spark), inc)
    assert fresh.count() == 2 and receipts.select("receipt_id").distinct().count() == 3
    urls = spark.createDataFrame([("u",), ("v",), ("w",)], "url string")
    rec = spark.createDataFrame([("u", 200, "h", 1), ("v", 500, "h", 1)], "url string, status int, sha256 string, received_at int")
    blobs = spark.createDataFrame([("h", "body")], "sha256 string, body string")
    assert sorted((r.url, r.state) for r in revisions.replay(urls, rec, blobs).collect()) == [("u", "BODY_CHANGED"), ("v", "BAD_STATUS"), ("w", "NO_RECEIPT")]
    staged = revisions.stage(spark.createDataFrame([(1, "x"), (1, None)], "batch int, v string"), [("NO_VALUE", F.col("v").isNotNull())])
    assert [(r.rows, r.staged, r.failed) for r in revisions.batch_totals(staged).collect()] == [(2, 1, 1)]
    man = spark.createDataFrame([("d", "h", None)], "doc string, html_sha256 string, image_sha256 string")
    assert revisions.integrity(man, blobs, ["html", "image"]).first()["reasons"] == ["CHANGED:html", "NO_HASH:image"]
    req = spark.createDataFrame([("r", "old"), ("q", "own")], "root string, revision string")
    kids = spark.createDataFrame([("r", "n1", 1), ("r", "n2", 2)], "root string, revision string, created_at int")
    assert {r.root: r.revision for r in revisions.chain_revision(req, kids).collect()} == {"r": "n2", "q": "own"}
    b = revisions.build_revision(req, "v1", ["root"]).collect()
    assert b[0].build != b[1].build
    rows = spark.createDataFrame([(1, [(1, "a")])], "k int, parts array<struct<o:int,v:string>>")
    counts = revisions.fan_out(rows, {"parts": "parts"}, f"{tmp_path}/f")
    assert {r.sink: r.rows for r in counts.collect()} == {"rows": 1, "parts": 1}
    assert [tuple(r) for r in read_sink(spark, f"{tmp_path}/f", "parts", "k int, o int, v string").collect()] == [(1, 1, "a")]
    store = f"{tmp_path}/s"
    revisions.put_blobs(inc.select("body"), store)
    assert revisions.put_blobs(inc.select("body"), store).count() == 2


def fresh_none(spark):
    return spark.createDataFrame([], "source string, id string, sha256 string")
