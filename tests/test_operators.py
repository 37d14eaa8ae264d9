"""Operators on small tables with results worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselode.operators import coverage, delta, documents, graph, identity, latest, ledger, paging, profile, quality
from caselode.sources import tables


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


SNAP = "source_id string, metadata_hash string"


def test_delta_kinds(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4"), ("e", "5")], SNAP)
    old = spark.createDataFrame([("a", "1"), ("b", "x"), ("z", "9")], SNAP)
    legacy = spark.createDataFrame([("c",), ("",), (None,)], "source_id string")
    mine = spark.createDataFrame([("c",), ("d",)], "source_id string")
    kinds = lambda **kw: dict(rows(delta.compare_inventory(now, old, legacy, mine, **kw), "source_id", "kind"))
    assert kinds() == {"a": "UNCHANGED", "b": "CHANGED", "c": "CURRENT_KNOWN", "d": "CURRENT_KNOWN", "e": "NEW", "z": "ABSENCE_UNCONFIRMED"}
    done = kinds(both_complete=True, preservation_checked=True)
    assert done["z"] == "MISSING" and done["a"] == "UNPRESERVED"
    first = dict(rows(delta.compare_inventory(now, None, legacy, None, both_complete=True), "source_id", "kind"))
    assert first["c"] == "LEGACY_KNOWN" and first["a"] == "NEW"
    with pytest.raises(ValueError):
        delta.compare_inventory(now, old, scopes=("s", "t"))
    got = delta.fetch_candidates(delta.compare_inventory(now, old, legacy, mine), spark.createDataFrame([("q",), ("e",)], "source_id string"))
    assert rows(got, "source_id") == [("b",), ("e",), ("q",)]


def test_listing(spark):
    pages = spark.createDataFrame([("s", 1, 3, ["a", "b"]), ("s", 2, 3, ["c"]), ("t", 1, 2, ["a"]), ("t", 2, 9, ["a"]), ("u", 1, 5, ["k"])], "scope string, page int, total long, ids array<string>")
    audited = delta.audit_pages(pages)
    assert rows(audited.where("error is not null"), "scope", "page", "error") == [("t", 2, "TOTAL_CHANGED")]
    assert rows(delta.listing_completeness(audited), "scope", "completeness") == [("s", "COMPLETE"), ("t", "PARTIAL"), ("u", "UNKNOWN")]


def test_latest_forms_agree(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, None), (None, 1, "n")], "k string, v int, p string")
    one = latest.latest_per_key(df, ["k"], [F.desc("v")])
    assert rows(one, "k", "v", "p") == rows(latest.latest_by_value(df, ["k"], ["v"]), "k", "v", "p")


def test_streaks_and_budget(spark):
    df = spark.createDataFrame([("a", i, f) for i, f in enumerate([1, 1, 0, 1, 1, 1])] + [("b", 0, 0)], "k string, t int, f int")
    assert rows(latest.failure_streaks(df, ["k"], ["t"], F.col("f") == 1), "k", "longest_streak", "breaker_open") == [("a", 3, True), ("b", 0, False)]
    b = latest.running_budget(df.withColumn("n", F.lit(10)), ["k"], ["t"], "n", 25)
    assert b.where("within").count() == 3


def test_numbering_is_gapless(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    got = paging.numbered(df, ["x"]).collect()
    assert sorted((r.x, r.ordinal) for r in got) == [(i, i) for i in range(1000)]
    assert paging.batch_plan(df, ["x"], 300).select("batch").distinct().count() == 4
    assert paging.numbered(df.limit(0), ["x"]).count() == 0


def test_chunks(spark):
    df = spark.createDataFrame([(1, "u"), (2, "v"), (3, "u"), (4, None), (5, "w")], "o int, url string")
    assert rows(paging.distinct_chunks(df, "url", "o", 2), "o", "chunk") == [(1, 0), (2, 0), (3, 0), (4, 0), (5, 1)]
    assert rows(paging.waves(df.dropna(), "url", "o", 1), "o", "wave") == [(1, 0), (2, 1), (3, 0), (5, 2)]


def test_identity(spark):
    df = spark.createDataFrame([(1, "k", "x", None), (2, "k", "y", "d"), (3, "m", "x", "d"), (4, None, "x", "d")], "id int, k string, f string, day string")
    assert rows(identity.conflicts(df, "k", "id", ["f"]), "id") == [(1,), (2,)]
    g = identity.candidate_groups(df, ["k"], "id", "day").collect()
    assert [(r.k, r.n_ids, r.one_day) for r in g] == [("k", 2, False)]
    assert identity.incomplete_keys(df, ["k"]).count() == 1


def test_replay(spark):
    e = [("c", 1, "CREATE", "a", None, "k1"), ("c", 2, "CREATE", "b", None, "k2"), ("c", 3, "CREATE", "x", None, "k1"), ("c", 4, "MERGE", "a", "b", None), ("c", 5, "SPLIT", "b", "d", "k1"), ("c", 6, "RELINK", None, "d", "k2")]
    df = spark.createDataFrame(e, "component string, sequence long, operation string, entity string, target string, key string")
    got = rows(identity.replay(df), "entity", "state", "keys", "rejected")
    assert got == [("a", "MERGED", "", 1), ("b", "ACTIVE", "", 1), ("d", "ACTIVE", "k1,k2", 1)]


def test_graph(spark):
    n = spark.createDataFrame([(1, None), (2, 1), (3, 2), (7, 8), (8, 7), (9, 8)], "id long, parent long")
    assert rows(graph.descendants(n, n.where("id = 1").select("id")), "node", "depth") == [(2, 1), (3, 2)]
    assert rows(graph.in_cycle(n), "id") == [(7,), (8,), (9,)]


def test_descendants_at_any_depth(spark):
    chain = [(i, i - 1 if i else None) for i in range(45)]
    df = spark.createDataFrame([*chain, (100, 3), (200, 201), (201, 200)], "id long, parent long")
    got = rows(graph.descendants(df, df.where("parent is null").select("id")), "root", "node", "depth")
    assert sorted(got) == sorted([*((0, i, i) for i in range(1, 45)), (0, 100, 4)])
    with pytest.raises(ValueError, match="cycle"):
        graph.descendants(df, df.where("id = 200").select("id"))


def test_ledger(spark):
    old = spark.createDataFrame([("a", "1")], "k string, v string")
    new = spark.createDataFrame([("a", "2"), ("b", None), ("b", None)], "k string, v string")
    assert rows(ledger.insert_if_absent(old, new, ["k"]), "k") == [("b",)]
    assert rows(ledger.conflicting(old, new, ["k"]), "k") == [("a",)]
    with pytest.raises(ValueError):
        ledger.require_none(ledger.conflicting(old, new, ["k"]), "IMMUTABLE_ARTIFACT_CONFLICT")
    up = ledger.upsert(old.withColumn("t", F.lit(2)), new.withColumn("t", F.lit(1)), ["k"], "t")
    assert rows(up, "k", "v") == [("a", "1"), ("b", None)]


def test_quality(spark):
    images = spark.createDataFrame([("d", "r", "FAILED", "HTTP_503"), ("d", "s", "FAILED", "HTTP_404"), ("d", "t", "PENDING", None), ("d", "u", "ACQUIRED", None)], "doc string, reference string, status string, code string")
    statutes = spark.createDataFrame([("d", "1", "PRESERVED", None, None), ("d", "2", "PRESERVED", None, "VERIFIED"), ("d", "3", "AMBIGUOUS", None, None)], "doc string, reference string, status string, code string, version_status string")
    issues = quality.inspect(images=images, statutes=statutes)
    assert rows(issues.groupBy("category").count(), "category", "count") == [("LOGIC_REQUIRED", 1), ("PENDING", 1), ("RETRYABLE", 1), ("REVIEW", 2)]
    assert dict(rows(quality.summary(issues), "category", "locations"))["NOT_PROVIDED"] == 0


def test_occurrence_matches_keep_order(spark):
    pad = "x" * 30
    left = spark.createDataFrame([("s", 0, "f", pad + "a", pad), ("s", 1, "f", pad + "b", pad), ("t", 0, "f", pad + "a", pad), ("t", 1, "f", pad + "b", pad), ("s", 2, "f", "short", pad)], "source string, order int, file string, before string, after string")
    right = spark.createDataFrame([("s", 5, "f", pad + "a", pad), ("s", 6, "f", pad + "b", pad), ("t", 6, "f", pad + "a", pad), ("t", 5, "f", pad + "b", pad)], "source string, order int, file string, before string, after string")
    assert rows(documents.match_occurrences(left, right), "source", "legacy_order", "current_order") == [("s", 0, 5), ("s", 1, 6)]


def test_inventory_keeps_unknown_apart_from_zero(spark):
    df = spark.createDataFrame([(1, "<p><img src=a></p>"), (2, " EMPTY "), (3, None)], "k int, html string")
    got = {r.k: (r.status, r.images, list(r.errors)) for r in documents.inventory(df, "k", "html").collect()}
    assert got == {1: ("OBSERVED", 1, []), 2: ("EMPTY_OR_SENTINEL", None, []), 3: ("ERROR", None, ["BODY_NOT_STRING"])}


def test_sources(spark, tmp_path):
    df = spark.range(50).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("x"))
    back = tables.publish(df, f"{tmp_path}/t", rows_per_file=20)
    assert back.count() == 50
    with pytest.raises(Exception):
        tables.publish(df, f"{tmp_path}/t")
    import hashlib

    h = hashlib.sha256(b"t3").hexdigest()
    assert tables.point_lookup(back, "id", 3, ("x", h)).first()["lookup"] == "FOUND"
    assert tables.point_lookup(back, "id", 3, ("x", "0")).first()["lookup"] == "BODY_VERSION_CHANGED"
    want = spark.createDataFrame([(3,), (99,)], "id long")
    assert dict(rows(tables.lookup_many(back, want, "id"), "id", "lookup")) == {3: "FOUND", 99: "ROW_NOT_FOUND"}
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / h).write_bytes(b"t3")
    (tmp_path / "b" / ("0" * 64)).write_bytes(b"t3")
    reg = spark.createDataFrame([(h, 2), ("0" * 64, 2), ("1" * 64, 2)], "sha256 string, size_bytes long")
    assert dict(rows(tables.verified_blobs(spark, f"{tmp_path}/b", reg), "sha256", "state")) == {h: "VERIFIED", "0" * 64: "BLOB_INTEGRITY_FAILED", "1" * 64: "MISSING"}
    (tmp_path / "b" / "bad.txt").write_bytes(b"\xff\xfe")
    got = rows(tables.text_files(spark, f"{tmp_path}/b", "*.txt"), "text")
    assert got == [(None,)]
    (tmp_path / "c.csv").write_bytes(b"\xef\xbb\xbfa,b\n1,x\n")
    assert rows(tables.csv_rows(spark, f"{tmp_path}/c.csv", T.StructType.fromDDL("a int, b string")), "a", "b") == [(1, "x")]
    (tmp_path / "j.json").write_text('{"p": 1, "b": "x"}\n{"p": 1, "b": "y"}\n')
    with pytest.raises(tables.SourceError):
        tables.json_rows(spark, f"{tmp_path}/j.json", T.StructType.fromDDL("p int, b string"), "p")


def test_profile_and_compare(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (2, None)], "k int, v string")
    assert rows(profile.cell_differences(a, b, "k"), "k", "column", "left", "right") == [(1, "v", "x", "y")]
    assert rows(profile.differences(a, a), "k") == []
    assert profile.sequence_complete(spark.range(5), "id").first()["complete"]
    assert not profile.sequence_complete(spark.range(1, 5), "id").first()["complete"]


def test_coverage(spark):
    inv = spark.createDataFrame([(1, "h"), (2, "h"), (3, "h")], "position int, body_hash string")
    imp = spark.createDataFrame([(1, "PRESERVED"), (2, "QUARANTINED")], "position int, status string")
    rd = spark.createDataFrame([(1, "r1", "h", 1), (1, "r2", "x", 2), (2, "r3", "h", 1)], "position int, reader_id string, body_hash string, created_at int")
    assert rows(coverage.reconcile(inv, imp, rd), "position", "status", "reader_id") == [(1, "STAGED_VERIFIED", "r1"), (2, "ERROR", "r3"), (3, "MISSING", None)]


def test_stored_order_over_ranges(spark):
    """Breaks of order are found inside ranges and between them, without one task for all."""
    from caselode.operators import delta

    rng = random.Random(3)
    rows, last = [], 0
    for i in range(500):
        last = last + 1 if rng.random() < 0.97 else last - rng.randrange(3)
        rows.append((i, f"{last:06d}"))
    want = [rows[i] for i in range(1, 500) if rows[i][1] <= rows[i - 1][1]]
    df = spark.createDataFrame(rows, "position long, source_id string").repartition(5)
    got = delta.validate_sorted(df, "position")
    assert got.columns == df.columns and sorted(tuple(r) for r in got.collect()) == want and want
    assert delta.validate_sorted(df.limit(0), "position").count() == 0


def test_replay_by_hand(spark):
    from caselode.operators import identity

    e = [("CREATE", "a", None, "k1"), ("CREATE", "b", None, "k2"), ("CREATE", "c", None, "k1"), ("MERGE", "a", "b", None), ("SPLIT", "b", "d", "k1"), ("RELINK", None, "b", "k1"), ("RELINK", None, "b", "k9"), ("CREATE", "a", None, "k3")]
    rows = [(1, i, op, entity, target, key) for i, (op, entity, target, key) in enumerate(e)]
    got = identity.replay(spark.createDataFrame(rows, "component long, sequence long, operation string, entity string, target string, key string")).collect()
    assert sorted((r.entity, r.state, r.merged_into, r["keys"], r.rejected) for r in got) == [("a", "MERGED", "b", "", 3), ("b", "ACTIVE", "", "k1,k2", 3), ("d", "ACTIVE", "", "", 3)]


def test_latest_before(spark):
    from caselode.operators import latest

    rows = [("u", 1, "x"), ("u", 1, "s"), ("u", 3, "s"), ("u", 2, "x"), ("v", 9, "s"), (None, 4, "x"), (None, 5, "s")]
    df = spark.createDataFrame(rows, "k string, t int, e string").withColumn("ts", F.timestamp_seconds("t"))
    got = latest.latest_before(df, ["k"], "ts", F.col("e") == "x", "prior").select("k", "t", "e", F.unix_seconds("prior").alias("p")).where("e = 's'").collect()
    assert sorted(((r.k, r.t, r.p) for r in got), key=str) == sorted([("u", 1, None), ("u", 3, 2), ("v", 9, None), (None, 5, 4)], key=str)


def test_fingerprints_ignore_order(spark):
    from caselode.functions import hashes

    rows = [(i, f"t{i}" if i % 3 else None) for i in range(40)]
    of = lambda r: tuple(spark.createDataFrame(r, "a long, b string").repartition(3).agg(*hashes.cell_fingerprint({"a": F.col("a"), "b": F.col("b")}), *hashes.table_fingerprint(F.col("a"), F.col("b"))).first())
    assert of(rows) == of(rows[::-1]) != of([*rows[:-1], (39, "other")])
    assert of(rows) != of([(r[0], r[1] or "") for r in rows])
