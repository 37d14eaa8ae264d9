"""The persisted search index against the scan, its states and its resumption."""

import random

import pytest
from pyspark.sql import functions as F

from caselode.operators import search
from caselode.operators.search_index import BLOCK, SearchIndex, grams
from caselode.sources.tables import SourceError

COLUMNS = ["title", "body", "block"]


@pytest.fixture
def source(spark, tmp_path):
    rng = random.Random(5)
    words = ["Straße", "Ω", "소유권", "ab%c", "x_y", "ﬁn", "Istanbul", "İ", "plain", "", "2009다47340"]
    rows = [(i, rng.choice([None, *words]), " ".join(rng.choice(words) for _ in range(rng.randrange(12))), rng.choice(words)) for i in range(4 * BLOCK + 9)]
    df = spark.createDataFrame(rows, "key long, title string, body string, block string").repartition(3)
    df.write.parquet(f"{tmp_path}/t")
    return spark.read.parquet(f"{tmp_path}/t"), f"{tmp_path}/ix"


def hits(df):
    return sorted((r[0], tuple(r["matched_columns"])) for r in df.collect())


def test_index_is_the_scan(spark, source):
    df, root = source
    index = SearchIndex(df, "key", COLUMNS, root)
    assert index.search("plain") is None and index.build() and index.ready()
    for q in ("STRASSE", "ω", "소유권", "B%C", "x_y", "_", "fin", "i̇", "istanbul", "plain 2009", " plain ", "", "  ", "없다", "a", "소유", "ss"):
        want = search.search(df, q, columns=COLUMNS).select("key", "matched_columns")
        assert hits(index.search(q).select("key", "matched_columns")) == hits(want), q
    assert SearchIndex(df, "key", COLUMNS, root).ready()  # found again
    index.drop()
    assert not index.ready()


def test_index_keeps_the_order_of_the_files(spark, source):
    df, root = source
    index = SearchIndex(df, "key", COLUMNS, root)
    index.build()
    every = [r["ordinal"] for r in index.search("plain").orderBy("ordinal").collect()]
    for limit in (1, 5, 100, 1000):
        assert [r["ordinal"] for r in index.search("plain", limit).collect()] == every[: min(limit, 100)]
    rare = index.search("2009다47340 소유권", 7)
    assert hits(rare.select("key", "matched_columns")) == hits(index.search("2009다47340 소유권").orderBy("ordinal").limit(7).select("key", "matched_columns"))


def test_an_unfinished_index_is_hidden_and_resumed(spark, source, monkeypatch):
    df, root = source
    monkeypatch.setattr("caselode.operators.search_index.PORTION", 1)
    index = SearchIndex(df, "key", COLUMNS, root)
    files = list(index.files)
    assert len(files) > 1 and index.build(portions=1) is False and index.search("plain") is None
    built = []
    monkeypatch.setattr(SearchIndex, "_new_segment", lambda self, own, real=SearchIndex._new_segment: (built.extend(own), real(self, own))[1])
    assert SearchIndex(df, "key", COLUMNS, root).build() and built == files[1:]
    assert hits(SearchIndex(df, "key", COLUMNS, root).search("plain").select("key", "matched_columns")) == hits(search.search(df, "plain", columns=COLUMNS).select("key", "matched_columns"))


def written(root):
    """Bytes of each segment's rows."""
    return {p.name: sum(f.stat().st_size for f in p.glob("rows/*.parquet")) for p in root.glob("*/segments/*")}


def same_as_scan(df, root, queries=("plain", "STRASSE", "소유권", "x_y", "a", "2009다47340 ω", "ab%c plain")):
    index = SearchIndex(df, "key", COLUMNS, root)
    for q in queries:
        want = hits(search.search(df, q, columns=COLUMNS).select("key", "matched_columns"))
        assert hits(index.search(q).select("key", "matched_columns")) == want, q
        every = [r[0] for r in index.search(q).orderBy("ordinal").select("key").collect()]
        assert [r[0] for r in index.search(q, 9).select("key").collect()] == every[:9]


def test_only_new_files_are_indexed(spark, source, tmp_path):
    """Rows that come make a segment of their own; what was there is neither read nor written again."""
    df, root = source
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    SearchIndex(df, "key", COLUMNS, root).build()
    before = written(tmp_path / "ix")
    more = spark.createDataFrame([(10_000 + i, "plain", f"added {i} Straße", None) for i in range(70)], df.schema)
    more.coalesce(1).write.mode("append").parquet(path)
    now = spark.read.parquet(path)
    index = SearchIndex(now, "key", COLUMNS, root)
    assert not index.ready() and index.search("plain") is None and len(index.missing()) == 1
    index.build()
    after = written(tmp_path / "ix")
    assert before.items() <= after.items() and len(after) == len(before) + 1
    new = next(s for s in index.segments if s["name"] not in before)
    assert new["rows"] == 70 and len(new["files"]) == 1
    same_as_scan(now, root)


def test_changed_and_deleted_files_are_tombstones(spark, source, tmp_path):
    df, root = source
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    SearchIndex(df, "key", COLUMNS, root).build()
    files = sorted((tmp_path / "t").glob("*.parquet"))
    files[0].unlink()
    spark.createDataFrame([(5000 + i, "plain", "replaced", "x_y") for i in range(9)], df.schema).coalesce(1).write.parquet(f"{tmp_path}/other")
    next((tmp_path / "other").glob("*.parquet")).replace(files[1])
    for p in (tmp_path / "t").glob(".*.crc"):
        p.unlink()
    now = spark.read.parquet(path)
    index = SearchIndex(now, "key", COLUMNS, root)
    assert len(index.missing()) == 1 and len(index.dead) == 2
    index.build()
    same_as_scan(now, root)
    assert index.search("replaced").count() == 9


def test_segments_are_merged_and_dead_rows_go(spark, tmp_path, monkeypatch):
    """Many small additions leave few segments, made from the index alone; rewritten bytes stay near logarithmic."""
    monkeypatch.setattr("caselode.operators.search_index.FAN", 2)
    schema, root = "key long, title string, body string, block string", f"{tmp_path}/ix"
    for k in range(7):
        rows = [(k * 100 + i, "plain" if i % 9 == 0 else None, f"text {k} {i} Straße", "ab%c") for i in range(40)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/t")
        index = SearchIndex(spark.read.parquet(f"{tmp_path}/t"), "key", COLUMNS, root)
        index.build()
    assert len(index.segments) <= 3 and sum(s["rows"] for s in index.segments) == 280
    same_as_scan(index.df, root, ("plain", "strasse", "text 3", "ab%c"))
    files = sorted((tmp_path / "t").glob("*.parquet"), key=lambda p: p.stat().st_mtime)
    for p in files[:6]:
        p.unlink()
    last = SearchIndex(spark.read.parquet(f"{tmp_path}/t"), "key", COLUMNS, root)
    assert last.ready() and len(last.dead) == 6
    assert last.tidy() >= 1 and sum(s["rows"] for s in last.segments) == 40 and not last.dead
    same_as_scan(last.df, root, ("plain", "text 6", "text 3"))
    assert len(last.log.versions()) == 2


def test_two_builders(spark, source):
    """The one that publishes second goes on from the other's version."""
    df, root = source
    one, two = (SearchIndex(df, "key", COLUMNS, root) for _ in range(2))
    one.build()
    assert not two.ready() and two.build() and two.version == one.version
    same_as_scan(df, root, ("plain",))


def test_a_source_that_changes_while_it_is_read(spark, source, monkeypatch):
    df, root = source
    index = SearchIndex(df, "key", COLUMNS, root)
    monkeypatch.setattr("caselode.operators.search_index.snapshot", lambda df: {f: [0, 0] for f in index.files})
    with pytest.raises(SourceError, match="SEARCH_SOURCE_CHANGED"):
        index.build()
    assert not index.ready()


def test_file_numbers_are_joined_when_many(spark, source, monkeypatch):
    df, root = source
    monkeypatch.setattr("caselode.operators.search_index.LISTED", 0)
    monkeypatch.setattr("caselode.operators.search_index.FAN", 2)
    SearchIndex(df, "key", COLUMNS, root).build()
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    df.limit(5).write.mode("append").parquet(path)
    now = spark.read.parquet(path)
    SearchIndex(now, "key", COLUMNS, root).build()
    same_as_scan(now, root, ("plain", "x_y"))


def test_an_empty_source(spark, tmp_path):
    spark.createDataFrame([], "key long, title string, body string, block string").write.parquet(f"{tmp_path}/e")
    index = SearchIndex(spark.read.parquet(f"{tmp_path}/e"), "key", COLUMNS, f"{tmp_path}/ix")
    assert index.build() and index.search("plain").count() == 0


def test_many_blocks_are_joined(spark, source, monkeypatch):
    df, root = source
    index = SearchIndex(df, "key", COLUMNS, root)
    index.build()
    few = hits(index.search("plain").select("key", "matched_columns"))
    monkeypatch.setattr("caselode.operators.search_index.LISTED", 1)
    assert hits(index.search("plain").select("key", "matched_columns")) == few == hits(search.search(df, "plain", columns=COLUMNS).select("key", "matched_columns"))


def test_few_blocks_are_read(spark, source):
    df, root = source
    index = SearchIndex(df, "key", COLUMNS, root)
    index.build()
    one = df.select(F.max("key")).first()[0]
    assert index.candidates("nowhere").count() == 0 and index.candidates("ab") is None and one == 4 * BLOCK + 8
    own = {97 << 42 | 98 << 21 | 99, 98 << 42 | 99 << 21 | 100}
    found = set(grams(["abcd", "bcd"]).tolist())
    assert own <= found and all(any(x >> k & (1 << 21) - 1 == 0 for k in (0, 21, 42)) for x in found - own)  # the rest lie over a seam
