"""Migrations, details, image headers, content-addressed files, changes of rows, and audits on small cases."""

import pytest
from pyspark.sql import functions as F

from caselode.operators import coverage, images, ledger, quality, reports
from caselode.sources import details, tables
from caselode.sources.listing import HttpStatus
from caselode.sources.migrations import Step, migrate
from caselode.sources.tables import SourceError
from caselode.sources.versions import Tables


def test_migrations(spark, tmp_path):
    store = Tables(spark, f"{tmp_path}/s")
    one = Step(1, "make", "t", "one row", lambda _: spark.createDataFrame([(1,)], "a int"))
    two = Step(2, "add", "t", "b is 2", lambda df: df.withColumn("b", F.lit(2)))
    assert migrate(store, [one]) == [1] and migrate(store, [one, two]) == [2] and migrate(store, [one, two]) == []
    assert [tuple(r) for r in store.pin().table("t").collect()] == [(1, 2)] and store.pin(1).table("t").columns == ["a"]
    for steps, code in (([two], "NUMBERS"), ([one], "MISSING"), ([one, Step(2, "add", "t", "b is 3", two.change)], "CHANGED")):
        with pytest.raises(SourceError, match=code):
            migrate(store, steps)


def test_rows_of_versioned_tables_change(spark, tmp_path):
    store = Tables(spark, f"{tmp_path}/s")
    c = store.change()
    c.replace("t", spark.createDataFrame([(1, "a"), (2, None)], "k int, v string"))
    c.append("t", spark.createDataFrame([(3, "c")], "k int, v string"))
    c.publish()
    c = store.change()
    got = c.update("t", F.col("v") == "a", {"v": F.lit("A")})
    assert [tuple(r) for r in got.collect()] == [(1, "A")]
    assert c.delete("t", F.col("k") == 2) == 1 and c.delete("t", F.col("k") == 9) == 0
    c.upsert("t", spark.createDataFrame([(1, "z"), (4, "d")], "k int, v string"), ["k"])
    c.publish()
    assert sorted(map(tuple, store.pin().table("t").collect())) == [(1, "z"), (3, "c"), (4, "d")]
    before, after = ({p["folder"] for p in store.pin(v)._tables["t"]["parts"]} for v in (1, 2))
    assert len(before & after) == 1  # the part of row 3 was not written again
    with pytest.raises(SourceError, match="NO_SUCH_TABLE"):
        store.change().delete("none", F.lit(True))


def detail(url):
    n = url.rsplit("/", 1)[1]
    if n == "4":
        raise HttpStatus(404)
    return {"1": b'{"d": {"id": 1, "text": "body", "x": 2}}', "2": b"<d><id>3</id><text>t</text></d>", "3": b'{"id": 3, "text": " "}', "5": b"x" * 99, "6": b"{"}[n]


def test_details_and_pages(spark):
    ids = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5, 6, 6, None)], "k int")
    got = {r.id: (r.state, r.body) for r in details.details(ids, "k", "tests.test_audits:detail", "x/{id}", "id", "text", cap=50).collect()}
    assert got == {"1": ("OK", "body"), "2": ("DETAIL_ID_MISMATCH", None), "3": ("DETAIL_BODY_EMPTY", " "), "4": ("HTTP_404", None), "5": ("BODY_SIZE_LIMIT", None), "6": ("UNREADABLE", None)}
    shown = {(r.id, r.endpoint): r.state for r in details.html_pages(ids.where("k in (2, 4, 6)"), "k", "tests.test_audits:detail", {"a": "x/{id}"}).collect()}
    assert shown == {("2", "a"): "OK", ("4", "a"): "HTTP_404", ("6", "a"): "NOT_HTML"}


def test_image_headers(spark):
    png = "89504E470D0A1A0A0000000D494844520000000A00000014"
    rows = [(png, "OK", (10, 20)), (png[:40], "IMAGE_TRUNCATED", None), ("4749463839610A001400", "OK", (10, 20)), ("424D" + "00" * 16 + "0A00000014000000", "OK", (10, 20)), ("FFD8FF", "OK", None), ("00", "IMAGE_TYPE_UNKNOWN", None), ("", "IMAGE_EMPTY", None), (None, "IMAGE_EMPTY", None), ("47494638396100001400", "IMAGE_DIMENSIONS", (0, 20)), (png[:32] + "FFFFFFFF" + "000000FF", "IMAGE_DIMENSIONS", (2**32 - 1, 255))]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, h string").withColumn("c", F.unhex("h"))
    for r in df.select("i", images.image_state(F.col("c")).alias("s"), images.dimensions(F.col("c")).alias("d")).collect():
        assert (r.s, tuple(r.d) if r.d else None) == rows[r.i][1:], rows[r.i]


def test_files_are_put_once(spark, tmp_path):
    df = spark.createDataFrame([("a", "x"), ("b", "yy")], "k string, body string").withColumn("d", F.sha2("body", 256))
    assert [r.written for r in tables.put_files(df, "d", "body", f"file://{tmp_path}/b").collect()] == [True, True]
    assert [r.written for r in tables.put_files(df, "d", "body", f"file://{tmp_path}/b").collect()] == [False, False]
    states = tables.verified_blobs(spark, f"{tmp_path}/b", df.select(F.col("d").alias("sha256"), F.length("body").cast("long").alias("size_bytes")))
    assert {r.state for r in states.collect()} == {"VERIFIED"}


def test_audits(spark):
    scope = spark.createDataFrame([(d, 1) for d in "abcd"], "doc string, revision int")
    inputs = spark.createDataFrame([("a", 1, True), ("b", 2, True), ("c", 1, None)], "doc string, revision int, valid boolean")
    issues = spark.createDataFrame([(d, "REVIEW", "X", "f") for d in "abe"], "doc string, category string, code string, location string")
    assert {r.doc: r.code for r in quality.audit(scope, inputs, issues).collect()} == {"a": "X", "b": "INPUT_REVISION_CHANGED", "c": "INPUT_INVALID", "d": "INPUT_MISSING"}
    cells = spark.createDataFrame([(1, "t", "x"), (2, "t", "x"), (3, "u", "x")], "i int, t string, f string")
    files = spark.createDataFrame([(9, "t", "q"), (8, "t", "p"), (7, "v", "p")], "i int, t string, f string")
    got = {(r.folder, r.status): (r.texts, r.cells, r.files) for r in coverage.text_coverage(cells, files, "i", "i", "t", "f").collect()}
    assert got == {("p", "MATCHED"): (1, 2, 2), (None, "CELL_ONLY"): (1, 1, 0), ("p", "FILE_ONLY"): (1, 0, 1)}
    refs = spark.createDataFrame([("u", 2, "RESOLVED"), ("u", 1, "ID_MISMATCH"), ("v", 3, "RESOLVED"), (None, 0, "RESOLVED")], "url string, o int, s string")
    assert [tuple(r) for r in images.manifest(refs, "url", "o", "s", 1).collect()] == [("u", 1, 2, True)]
    a, b = spark.createDataFrame([(1, "x"), (2, "y"), (4, "q")], "k int, v string"), spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    assert {r.k: r.state for r in ledger.rebuilt(a, b, ["k"]).collect()} == {1: "SAME", 2: "CHANGED", 3: "MISSING", 4: "EXTRA"}
    assert [r.k for r in reports.history(a, "v", "k", 2).orderBy("rank").collect()] == [2, 1]


def test_a_database_is_read_by_ranges(spark, tmp_path):
    """An embedded database that Spark's own jars bring, where they do."""
    try:
        spark._jvm.java.lang.Class.forName("org.apache.derby.iapi.jdbc.AutoloadedDriver")
    except Exception:  # noqa: BLE001 - py4j wraps what Java throws
        pytest.skip("no embedded database")
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    spark.range(100).selectExpr("cast(id as int) as k", "cast(id * 2 as int) as v").write.jdbc(url, "numbers")
    df = tables.jdbc_rows(spark, url, "numbers", "k", (0, 99), 4)
    assert df.rdd.getNumPartitions() == 4 and df.agg(F.sum("v")).first()[0] == 9900 and df.where("k between 10 and 19").count() == 10
