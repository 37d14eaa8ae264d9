"""Cases that a reviewer's larger tables brought up."""

import hashlib
import pathlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from caselode.functions import suffix, text
from caselode.operators import case_fields, fields, identity, search_index
from caselode.plans import audit_plans, registry, state, store_plans  # noqa: F401
from caselode.plans.markup_plans import cases
from caselode.sources import tables, windows


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def of_duckdb(name: str, folder: str, *tables: str):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return sorted(con.execute(registry.SQL[name]).fetchall(), key=str)


@pytest.mark.parametrize("name", ["h1_visible_text", "h2_observe"])
def test_references_cut_short(spark, folder, name):
    """A title that was cut inside a reference, as long tables have it: what is left of it stays as written."""
    html = ["<title>a&amp;&amp</title><h1>a&amp;&amp</h1><p>b &quo</p>", "<h1>x & y &amp; z&copy</h1>", '<p><a href="/?a=1&b=2">&middot;</a></p>']
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").write.parquet(f"{folder}/pages.parquet")
    got = registry.QUERIES[name](spark, folder)
    want = of_duckdb(name, folder, "pages")
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert "&&amp" in str(want)


def exchanges(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[: plan.find("== Initial Plan ==")].count("Exchange ") if "== Initial Plan ==" in plan else plan.count("Exchange ")


DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["h9_case_fields", "h9_field_statuses", "c11_field_contract"])
def test_fields_are_dealt_once(spark, name):
    """A table of customers is one split; its rows are dealt before sixty fields are made of each."""
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan.replace("BatchEvalPython", "ArrowEvalPython").split("ArrowEvalPython", 1)[1]


def test_complete_keeps_copies_and_drops_other_names(spark):
    have = spark.createDataFrame([("a", "x", "1", "S"), ("a", "x", "2", None), ("a", "other", "3", "S"), ("gone", "x", "4", "S")], "doc string, name string, value string, status string")
    docs = spark.createDataFrame([("a",), ("b",), (None,)], "d string")
    got = fields.complete(have, docs, "d", ["x", "y"], "NONE")
    want = [("None", "x", None, "NONE"), ("None", "y", None, "NONE"), ("a", "x", "1", "S"), ("a", "x", "2", "NONE"), ("a", "y", None, "NONE"), ("b", "x", None, "NONE"), ("b", "y", None, "NONE")]
    assert got.columns == ["doc", "name", "value", "status"]
    assert sorted(((str(r.doc), r["name"], r.value, r.status) for r in got.collect()), key=str) == sorted(want, key=str)


def test_wide_fields_are_those_of_the_rows(spark):
    docs = cases(registry.Tables(spark, DATA)).where("doc < 40")
    wide = case_fields.wide_case_fields(docs)
    assert wide.exceptAll(fields.wide(case_fields.case_fields(docs), case_fields.NAMES)).isEmpty() and wide.count() == docs.count()
    assert wide.columns == ["doc", *case_fields.NAMES] and exchanges(wide) == 1


def test_publish_computes_its_rows_once(spark, folder):
    ran = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            ran.add(b.num_rows)
            yield b

    df = spark.range(100)
    assert tables.publish(df.mapInArrow(count, df.schema), f"{folder}/once").count() == 100
    assert ran.value == 100


def test_replay_streams_components(spark):
    rows = [(c, s, op, "a" if op == "CREATE" else "zz", None, f"k{c}") for c in [None, *range(50)] for s, op in ((None, "MERGE"), (1, "CREATE"), (2, "CREATE"))]
    events = spark.createDataFrame(rows, "component long, sequence long, operation string, entity string, target string, key string")
    got = identity.replay(events)
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()  # a call of pandas a component
    assert sorted(((r.component, r.entity, r["keys"], r.rejected) for r in got.collect()), key=str) == sorted([(c, "a", f"k{c}", 2) for c in [None, *range(50)]], key=str)


def test_pages_are_bundled(spark, folder, monkeypatch):
    """A listing's pages lie many to a file: a file a page made a hundred thousand files of a larger table."""
    made = []
    monkeypatch.setattr(store_plans, "scratch_path", lambda *_: made.append(f"{folder}/{len(made)}") or made[-1])
    monkeypatch.setattr(windows, "BUNDLE", 3)
    t = registry.Tables(spark, DATA)
    options = store_plans._served(t)
    files = [f for f in pathlib.Path(made[0]).rglob("part-*")]
    weeks = {r.w: r.n for r in t.events.groupBy(F.floor(F.datediff(F.to_date("ts"), F.lit(options["from"])) / 7).alias("w")).agg(F.count("*").alias("n")).collect()}
    assert len(files) == sum(-(-n // 150) for n in weeks.values())
    every = windows.windows(*map(windows.date.fromisoformat, (options["from"], options["to"])), 7)
    rows = [r for w in every for r in windows.listed(options | {"url": "file://" + options["url"]}, w)]
    assert sorted(int(r[3]) for r in rows) == sorted(r.event_id for r in t.events.select("event_id").collect())
    assert sum(b.num_rows for b in windows.batches(iter(rows))) == len(rows)


def test_common_length_is_that_of_the_automaton():
    rng = random.Random(7)
    some = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
    for letters in ("a", "ab", "ab\U0001f600", "abcdefgh"):
        for _ in range(300):
            a, b = some(letters), some(letters)
            assert suffix.Hashed(a).common_length(suffix.Hashed(b)) == suffix.Automaton(a).longest_common(b)[2]


def test_common_length_of_unlike_texts_with_equal_hashes(monkeypatch):
    """Equal hashes are held against the texts."""
    monkeypatch.setattr(suffix.Hashed, "windows", lambda self, n: suffix.np.zeros(len(self.text) - n + 1, suffix.np.uint64))
    assert suffix.Hashed("abcxyz").common_length(suffix.Hashed("--cx--")) == 2


def test_folded_search_keeps_texts_in_its_task(spark):
    """Only the answers leave Python: the plan has no column of folded texts."""
    df = spark.createDataFrame([("Straße",), (None,), ("x",)] * 200, "t string")
    found = df.select(text.contains_folded(F.col("t"), "STRASSE").alias("f"))
    assert "Contains(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [r.f for r in found.collect()] == [True, False, False] * 200


@pytest.mark.parametrize("columns", [["a"], ["a", "b"]])
def test_index_holds_a_slice_of_texts(spark, folder, monkeypatch, columns):
    rows = [(k, f"Text {k} {'Pathetic' if k % 50 == 0 else ''}", None if k % 2 else f"B{k}") for k in range(700)]
    spark.createDataFrame(rows, "k long, a string, b string").coalesce(1).write.parquet(f"{folder}/t")
    index = search_index.SearchIndex(spark.read.parquet(f"{folder}/t"), "k", columns, root=f"{folder}/i")
    index.build()
    assert sorted(r.key for r in index.search("PATHETIC").collect()) == list(range(0, 700, 50))
    assert index.rows().count() == 700


def test_blobs_are_not_listed_by_the_driver(spark, folder):
    """Their states come from tasks: the plan has no scan of files, whose listing the driver would hold."""
    rows = [(f"b{k}", hashlib.sha256(f"b{k}".encode()).hexdigest()) for k in range(40)]
    df = spark.createDataFrame(rows, "body string, d string")
    tables.put_files(df.where("body <> 'b3'").withColumn("body", F.when(F.col("body") == "b5", "other").otherwise(F.col("body"))), "d", "body", f"{folder}/x").count()
    (pathlib.Path(folder) / "x" / "_hidden").write_text("x")
    tables.put_files(df.where("body <> 'b3'").withColumn("body", F.when(F.col("body") == "b5", "other").otherwise(F.col("body"))), "d", "body", f"{folder}/x").collect()
    got = tables.verified_blobs(spark, f"{folder}/x", df.select(F.col("d").alias("sha256"), F.octet_length("body").cast("long").alias("size_bytes")))
    assert "binaryFile" not in got._jdf.queryExecution().toString()
    states = {r.sha256: r.state for r in got.collect()}
    of = dict(rows)
    assert states.pop(of["b3"]) == "MISSING" and states.pop(of["b5"]) == "BLOB_INTEGRITY_FAILED" and set(states.values()) == {"VERIFIED"} and len(states) == 38


def audited(rows):
    """What `identity.audit` says, by hand."""
    out, blocks = [], {}
    for block, i, t, day in rows:
        if block is not None and t is not None:
            blocks.setdefault(str(block), {}).setdefault(t, []).append((i, day))
    for block, texts in blocks.items():
        classes = [(min(i for i, _ in held if i is not None), t, len(held), {str(d) for _, d in held if d is not None}) for t, held in texts.items() if any(i is not None for i, _ in held)]
        if not classes:
            continue
        least, first, _, days = min(classes)
        for i, t, copies, own in classes:
            if i != least:
                n = suffix.Automaton(first).longest_common(t)[2]
                out.append((block, least, i, copies, own == days and len(own) <= 1, n, n / max(1, min(len(first), len(t)))))
    return sorted(out)


@pytest.mark.parametrize("large", [3, 4096])
def test_audit_of_blocks_of_any_size(spark, monkeypatch, large):
    """Streamed or by classes in pieces: texts of one id, null ids, days and texts, blocks that are equal only as Spark groups them."""
    monkeypatch.setattr(identity, "LARGE", large)
    rng = random.Random(3)
    texts = ["", "a", *("".join(rng.choice("abc\U0001f600") for _ in range(rng.randrange(1, 60))) for _ in range(25))]
    rows = [(rng.choice([None, float("nan"), 1.0, 2.0, 2.0, 3.0]), rng.choice([None, *range(400)]), rng.choice([None, *texts]), rng.choice([None, 1.5, float("nan")])) for _ in range(300)]
    rows += [(4.0, None, "x", 1.5), (4.0, None, "y", 1.5), (5.0, 1, "x", None), (5.0, 1, "x", 1.5), (6.0, 7, "ab", 1.5), (6.0, 7, "b", 1.5), (6.0, 8, "abb", 1.5), (7.0, 1, "x", None), (7.0, 2, "xy", None)]
    got = identity.audit(spark.createDataFrame(rows, "b double, i int, t string, d double"), "b", "i", "t", "d")
    assert [f.dataType.simpleString() for f in got.schema] == ["double", "int", "int", "bigint", "boolean", "int", "double"]
    assert sorted((str(r.block), *r[1:]) for r in got.collect()) == audited(rows)


def test_audit_shuffles_texts_once(spark):
    """The plan had five shuffles; now a block's rows meet in one (counts of blocks come before)."""
    assert exchanges(registry.QUERIES["d42_identity_candidates"](spark, DATA)) == 1


def test_changed_sources_are_found_by_the_index(spark, monkeypatch):
    """All is indexed once, before files go, and the rows are the index's: what it loses is missing, what it keeps too long is stale."""
    of, index, built = registry.QUERIES["d17_changed_sources"], search_index.SearchIndex, []
    real, candidates, rows = index.build, index.candidates, index.rows

    def build(self, *a):
        before = self.version
        done = real(self, *a)
        built.append((self.version - before, sum(s["rows"] for s in self.segments)))
        return done

    monkeypatch.setattr(index, "build", build)
    every = sorted(tuple(r) for r in of(spark, DATA).collect())
    assert len(every) > 1 and not any(stale for _, stale in every)
    assert built == [(1, spark.read.parquet(f"{DATA}/documents.parquet").count())]
    monkeypatch.setattr(index, "rows", lambda self: rows(self).where(F.col("key") != every[0][0]))
    assert sorted(tuple(r) for r in of(spark, DATA).collect()) == every[1:]
    monkeypatch.setattr(index, "rows", lambda self: self._rows([s["name"] for s in self.segments]))
    kept = sorted(tuple(r) for r in of(spark, DATA).collect())
    assert [r for r in kept if not r[1]] == every and any(stale for _, stale in kept)
    monkeypatch.setattr(index, "candidates", lambda self, needle: candidates(self, needle).limit(0))
    assert of(spark, DATA).isEmpty()
