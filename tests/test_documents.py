"""Fields, images, link plans, listings and backups."""

import json

import pytest
from pyspark.sql import functions as F

from caselode.operators import fields, images, links
from caselode.sources import backup, listing

HTML = "<p>【원고】 갑</p><p>【주 문】 기각</p><p>【이 유】 때문</p><p>【이유】 또</p><p>[참조조문] 법 1</p><p>판사 을 병</p>"


def test_fields(spark):
    docs = spark.createDataFrame([("d", HTML, "c"), ("e", None, None)], "k string, html string, court string")
    got = fields.text_fields(docs, "k", "html", {"main": ["주문"], "reasoning": ["이유"], "law": ["참조조문"]}, ["law"])
    rows = {r.name: (r.value, r.status) for r in got.collect()}
    assert rows["main"] == ("【주 문】 기각", "PRESENT") and rows["reasoning"][1] == "REVIEW"
    assert rows["law"][0].startswith("[참조조문]") and rows["party:원고"][0] == "갑" and rows["judge:판사"][0] == "을 병"
    whole = fields.complete(got.unionByName(fields.metadata_fields(docs, "k", {"court": "court"})), docs, "k", ["main", "court"])
    assert sorted((r.doc, r.name, r.status) for r in whole.collect()) == [("d", "court", "PRESENT"), ("d", "main", "PRESENT"), ("e", "court", "NOT_PROVIDED"), ("e", "main", "NOT_PROVIDED")]
    assert {r.doc: r.court for r in fields.wide(whole, ["main", "court"]).collect()} == {"d": "c", "e": None}
    heads = spark.createDataFrame([("e", "주문"), ("d", "주문"), ("d", "기타")], "doc string, label string")
    assert [(r.doc, r.code) for r in fields.anomalies(whole, heads, {"주문": "main"}).collect()] == [("e", "HEADING_WITHOUT_FIELD")]


def test_images(spark):
    refs = spark.createDataFrame([(1, None, None, "a.png", None), (2, None, True, "a", "u1"), (3, None, None, "a", "u1"), (4, "UNRESOLVED", None, "a", "u2"), (5, None, None, None, None)], "o int, s string, m boolean, name string, url string")
    got = refs.select("o", images.reference_status(F.col("s"), F.col("m"), F.col("name"), F.col("url")).alias("st")).collect()
    assert [r.st for r in got] == ["NAME_ONLY", "ID_MISMATCH", "RESOLVED", "UNRESOLVED", "UNRESOLVED"]
    tries = spark.createDataFrame([("u1", 1, "FAILED"), ("u1", 2, "ACQUIRED")], "url string, t int, outcome string")
    assert [r.url for r in images.plan_acquisition(refs, tries, "url", "o").collect()] == ["u2"]
    states = {r.o: r.state for r in images.provider_state(refs, tries, "url", "t").collect()}
    assert states == {1: "NEVER_ATTEMPTED", 2: "ACQUIRED", 3: "ACQUIRED", 4: "NEVER_ATTEMPTED", 5: "NEVER_ATTEMPTED"}
    out = spark.createDataFrame([(0, 1, 60), (0, 2, None), (0, 3, 60), (0, 4, 1)], "chunk int, o int, n int")
    assert [r.outcome for r in images.accounting(out, "url", "o", "n", 100).orderBy("o").collect()] == ["ACQUIRED", "FAILED", "SKIPPED", "SKIPPED"]
    raw = spark.createDataFrame([(bytearray(b"\x89PNG\r\n\x1a\n0000"),), (bytearray(b"RIFF0000WEBP"),), (bytearray(b"x"),), (None,)], "b binary")
    assert [r[0] for r in raw.select(images.sniff(F.col("b"))).collect()] == ["png", "webp", None, None]
    assert spark.range(1).select(images.same_number(F.lit("ImageId12"), F.lit("img12.png"))).first()[0]


def test_link_plan(spark):
    docs = spark.createDataFrame([("exact", "a"), ("none", "a"), ("conflict", "a"), ("many", "a"), ("two", "a"), ("gap", None)], "k string, v string")
    cand = spark.createDataFrame([("exact", "1", 2, "a"), ("exact", "2", 2, "b"), ("conflict", "3", 1, "b"), ("many", "4", 21, "a"), ("two", "5", 2, "a"), ("two", "6", 2, "a")], "k string, candidate string, total int, v string")
    got = {r.k: (r.status, r.candidate) for r in links.link_plan(docs, cand, "k", ["v"]).collect()}
    assert got == {"exact": ("EXACT", "1"), "none": ("UNMATCHED", None), "conflict": ("CONFLICT", None), "many": ("AMBIGUOUS", None), "two": ("AMBIGUOUS", None), "gap": ("METADATA_INCOMPLETE", None)}


def fixture_fetch(url: str) -> bytes:
    page = int(url.rsplit("=", 1)[1])
    if page == 3:
        return b"<S><n>3</n><item><id>c</id></item></S>"
    return json.dumps({"S": {"n": "3", "item": [{"id": f"{'ab'[page - 1]}"}]}}).encode()


def test_listing(spark):
    spark.dataSource.register(listing.ListingSource)
    df = spark.read.format("listing").options(url="x?page={page}", last=3, fetch="tests.test_documents:fixture_fetch", root="S", items="item", total="n", id="id").load()
    assert sorted((r.page, r.total, r.ids) for r in df.collect()) == [(1, 3, ["a"]), (2, 3, ["b"]), (3, 3, ["c"])]


def test_strict_decoding():
    with pytest.raises(listing.ListingError):
        listing.strict_json(b'{"a": 1, "a": 2}')
    with pytest.raises(listing.ListingError):
        listing.strict_xml(b"<!DOCTYPE x><x/>")
    assert listing.strict_xml(b"<x><a>1</a><a>2</a></x>") == {"x": {"a": ["1", "2"]}}
    with pytest.raises(listing.ListingError):
        listing.total_of(True)
    tries = []

    def flaky(url):
        tries.append(url)
        if len(tries) < 3:
            raise listing.HttpStatus(503)
        return b"ok"

    assert listing.fetched(flaky, "u", wait=lambda s: None) == b"ok" and len(tries) == 3
    with pytest.raises(listing.HttpStatus):
        listing.fetched(lambda u: (_ for _ in ()).throw(listing.HttpStatus(404)), "u", wait=lambda s: None)


def test_backup(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/a")
    backup.backup(spark, {"a": f"{tmp_path}/a"}, f"{tmp_path}/b")
    assert [(r.table, r.state) for r in backup.verify(spark, f"{tmp_path}/b").collect()] == [("a", "VERIFIED")]
    spark.range(1).write.mode("append").parquet(f"{tmp_path}/b/a")
    assert backup.verify(spark, f"{tmp_path}/b").first().state == "ROWS_DIFFER"
    assert backup.manifest(spark, f"{tmp_path}/a").count() >= 1
    want = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "sha256 string, size_bytes long")
    assert [r.sha256 for r in backup.missing_blobs(want, want.limit(0), 0, 10, 11).collect()] == ["a", "b"]
