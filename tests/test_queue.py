"""The job queue step by step, and the small state operators."""

import pytest
from pyspark.sql import functions as F

from caselode.operators import case_fields, ledger, links, queue, search
from caselode.sources import tables

KIND = "job_id string, kind string, status string, created_at timestamp, available_at timestamp, lease_until timestamp, worker string, attempts int, failures int, max_attempts int, error_code string, needs string, follow_up string"


def at(second):
    return F.timestamp_seconds(F.lit(second))


def jobs(spark, *rows):
    """Rows of (id, status, created, lease, failures, needs, follow_up); three attempts each."""
    from datetime import datetime, timezone

    when = lambda s: datetime.fromtimestamp(s, timezone.utc).replace(tzinfo=None) if s is not None else None
    out = [(i, "K", status, when(made), when(made), when(lease), "w" if lease else None, 1, failures, 3, None, needs, then) for i, status, made, lease, failures, needs, then in rows]
    return spark.createDataFrame(out, KIND)


def state(df, *cols):
    return {r["job_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_lost_leases(spark):
    df = jobs(spark, ("a", "RUNNING", 0, 10, 0, None, None), ("b", "RUNNING", 0, 10, 2, None, None), ("c", "RUNNING", 0, 11, 0, None, None), ("d", "RUNNING", 0, None, 0, None, None), ("e", "SUCCEEDED", 0, 10, 0, None, None))
    got = state(queue.expired(df, at(10)), "status", "failures", "error_code", "worker")
    assert got == {"a": ("QUEUED", 1, "LEASE_EXPIRED", None), "b": ("FAILED", 3, "LEASE_EXPIRED", None), "c": ("RUNNING", 0, None, "w"), "d": ("RUNNING", 0, None, None), "e": ("SUCCEEDED", 0, None, "w")}
    assert queue.expired(df, at(10)).schema == df.schema
    s = queue.drain_status(df, at(10), True).first()
    assert (s.draining, s.running, s.ready_to_stop) == (True, 2, False)
    assert queue.drain_status(df.limit(0), at(10), True).first().ready_to_stop and not queue.drain_status(df.limit(0), at(10), False).first().ready_to_stop


def test_claims_wait_for_what_they_need(spark):
    df = jobs(
        spark,
        ("late", "QUEUED", 99, None, 0, None, None),
        ("open", "QUEUED", 3, None, 0, "started", None),
        ("free", "QUEUED", 4, None, 0, "done", None),
        ("lost", "QUEUED", 1, None, 0, "nowhere", None),
        ("self", "QUEUED", 1, None, 0, "free", None),
        ("done", "FAILED", 0, None, 3, None, None),
        ("started", "SUCCEEDED", 0, None, 0, None, "child"),
        ("child", "QUEUED", 5, None, 0, None, None),
    )
    assert sorted(state(queue.ready(df, at(10)))) == ["child", "free"]
    got = state(queue.claimed(df, at(10), "me", 30), "status", "worker", "attempts")
    assert got["free"] == ("RUNNING", "me", 2) and sum(v[0] == "RUNNING" for v in got.values()) == 1
    again = queue.claimed(queue.claimed(df, at(10), "me", 30), at(11), "other", 30)
    assert state(again, "worker")["child"] == (None,)  # one runs at a time
    later = queue.claimed(again, at(41), "other", 30)
    # its lease is lost, and it is still the oldest
    assert state(later, "status", "failures", "worker")["free"] == ("RUNNING", 1, "other") and state(later, "worker")["child"] == (None,)
    assert queue.next_job(df, at(10), draining=True).count() == 0 and queue.next_job(df.limit(0), at(10)).count() == 0
    with pytest.raises(ValueError, match="INVALID_WORKER_ID"):
        queue.claimed(df, at(10), " ", 30)


def test_ends_and_heartbeats(spark):
    df = jobs(spark, ("a", "RUNNING", 0, 20, 1, None, None), ("b", "QUEUED", 0, None, 0, None, None))
    cols = ("status", "failures", "error_code", "worker")
    of = lambda *x: state(queue.finished(df, at(10), "a", *x).withColumn("wait", F.unix_seconds("available_at") - 10), *cols, "wait")["a"]
    assert of("SUCCEEDED") == ("SUCCEEDED", 1, None, None, 0)
    assert of("CHECKPOINTED") == ("QUEUED", 1, None, None, 0)
    assert of("FAILED", "HANDLER_FAILED") == ("QUEUED", 2, "HANDLER_FAILED", None, 4)
    last = queue.finished(df.withColumn("failures", F.lit(2)), at(10), "a", "FAILED")
    assert state(last, *cols)["a"] == ("FAILED", 3, None, None)
    assert state(queue.finished(df, at(20), "a", "SUCCEEDED"), *cols) == state(df, *cols)  # the lease is lost
    waits = spark.range(8).select(queue.wait_seconds(F.col("id") * F.col("id")).alias("w")).collect()
    assert [r.w for r in waits] == [1, 2, 16, 60, 60, 60, 60, 60]
    beat = lambda *x: state(queue.beaten(df, at(10), "a", 500, *x).withColumn("u", F.unix_seconds("lease_until")), "u")["a"]
    assert beat() == (510,) and beat(at(0)) == (120,) and state(queue.beaten(df, at(25), "a", 500), "lease_until")["a"] == state(df, "lease_until")["a"]
    for bad in (("DONE", None), ("FAILED", "oops")):
        with pytest.raises(ValueError):
            queue.finished(df, at(10), "a", *bad)


def test_workers_and_bounds(spark):
    rows = spark.createDataFrame([("a", 50, None), ("b", 40, None), ("c", 99, 99)], "worker string, beat int, stop int")
    workers = rows.select("worker", F.timestamp_seconds("beat").alias("heartbeat_at"), F.timestamp_seconds("stop").alias("stopped_at"))
    assert [r.worker for r in queue.workers_alive(workers, at(100)).collect()] == ["a"]
    df = spark.createDataFrame([(1, 5), (None, 9), (7, None)], "a int, b int")
    assert [list(r.invalid) for r in queue.bounded(df, {"a": (1, 5), "b": (None, 8)}).collect()] == [[], ["a", "b"], ["a", "b"]]


def test_manifests_and_pins(spark):
    df = spark.createDataFrame([("x", 2, None), ("x", 1, "u"), ("y", 1, "v")], "batch string, n int, url string")
    one = {r.batch: (r.references, r.body, r.manifest_id) for r in ledger.pending_manifests(df, ["batch"], ["n"]).collect()}
    two = {r.batch: (r.references, r.body, r.manifest_id) for r in ledger.pending_manifests(df.repartition(3), ["batch"], ["n"]).collect()}
    assert one == two and one["x"][1] == '{"references":[{"n":1,"url":"u"},{"n":2,"url":null}]}'
    pins = spark.createDataFrame([("a", "1", 1), ("b", "1", None), ("c", "1", 1)], "k string, h string, s int")
    now = spark.createDataFrame([("a", "1", 1), ("b", "2", None)], "k string, h string, s int")
    assert {r.k: list(r.changed) for r in ledger.pinned(pins, now, "k", ["h", "s"]).collect()} == {"a": [], "b": ["h"], "c": ["MISSING"]}
    assert {r.k: r.state for r in links.reproved(pins, now, ["k"], ["h", "s"]).collect()} == {"a": "SAME", "b": "EVIDENCE_DIFFERS", "c": "NOT_FOUND_AGAIN"}
    hits = spark.createDataFrame([("제목 Straße", "본문"), (" ", "strasse"), ("x", "y")], "t string, h string")
    got = search.hit_items(hits, "STRASSE", "t", "h").select("display_title", "matched_columns").collect()
    assert [(r[0], list(r[1])) for r in got] == [("제목 Straße", ["current_reader_title"]), ("현재 제공 본문", ["current_reader_html"])]
    with pytest.raises(tables.SourceError):
        tables.jdbc_rows(spark, "jdbc:x", "t", "k", (5, 1), 2)


def test_sixty_fields(spark):
    assert len(case_fields.NAMES) == 60 and len(case_fields.SYMBOLS) == 27 and set(case_fields.SECTION_LABELS) <= set(case_fields.NAMES)
    rows = [("1", "<h2>제목 *</h2><p>【이 유】가</p><p>【이유】나</p><p>【전문】다</p><p>[따름판례] 라</p>", None, {"prnjdgYmd": "2001-02-03"}, {}, "PENDING"), ("2", "<h2>열림", "밖", {}, None, "UNMATCHED")]
    got = case_fields.case_fields(spark.createDataFrame(rows, case_fields.INPUT), processed_at="2024-01-01").collect()
    assert [r.name for r in got if r.doc == "1"] == case_fields.NAMES
    of = {(r.doc, r.name): r for r in got}
    reasons = of["1", "reasoning"]
    assert (reasons.status, reasons.value, len(reasons.ranges)) == ("REVIEW", "【이 유】가\n【이유】나", 2)
    assert of["1", "following_cases"].value == "[따름판례] 라" and of["1", "important"].value == "true"
    assert of["1", "decision_date"].value == "2001-02-03" and of["1", "case_sort"].status == "NOT_PROVIDED"
    assert of["1", "lmeta_saNo"].status == "NOT_PROCESSED" and of["2", "lmeta_saNo"].status == "NOT_PROVIDED"
    assert of["2", "case_full_no"].value == "밖" and of["1", "file_process_time"].value == "2024-01-01"
    assert case_fields.case_fields(spark.createDataFrame([], case_fields.INPUT)).count() == 0
    assert case_fields.symbol_label("가단") == "민사 · 제1심 · 단독" and case_fields.symbol_label("라") == "민사 · 항고"


def test_bounded_source_comparison(spark):
    from caselode.operators import reports

    ours = spark.createDataFrame([(i, "a" if i % 2 else None) for i in range(6)], "k int, x string")
    theirs = spark.createDataFrame([(i, "a") for i in range(2, 9)], "k int, x string")
    got = {r.k: (r.state, r.differing) for r in reports.source_differences(ours, theirs, "k", ["x"], 1, 3).collect()}
    assert got == {1: ("OURS_ONLY", None), 2: ("DIFFERENT", ["x"]), 3: ("SAME", [])}
    n = {(r.total, r.x, r.measure): r.n for r in reports.baseline(ours, ["x"], {"big": F.col("k") > 3}).collect()}
    assert n[True, None, "rows"] == 6 and n[False, None, "rows"] == 3 and n[False, "a", "big"] == 1 and n[True, None, "big"] == 2
