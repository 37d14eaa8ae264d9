"""Footers, windowed listings, sinks, requests, staleness and longest common substrings."""

import json
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from caselode.functions.suffix import Automaton, longest_common
from caselode.operators import identity, requests, sinks, staleness
from caselode.sources import footers, windows
from caselode.sources.listing import ListingError
from caselode.sources.tables import SourceError
from caselode.sources.versions import Tables


def brute_common(a, b):
    return next((a[i : i + n] for n in range(min(len(a), len(b)), 0, -1) for i in range(len(a) - n + 1) if a[i : i + n] in b), "")


def test_longest_common_substrings():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rng.choice("ab가"[: rng.choice([1, 2, 3])]) for _ in range(rng.randrange(14))) for _ in range(2))
        i, j, n = Automaton(a).longest_common(b)
        assert a[i : i + n] == b[j : j + n] == longest_common(a, b) == brute_common(a, b)
        assert b.index(a[i : i + n]) == j and a.index(a[i : i + n]) == i


def test_identity_audit(spark):
    rows = [("k", 3, "abcdef", "d1"), ("k", 9, "abcdef", "d1"), ("k", 5, "xxcdefg", "d1"), ("k", 7, "zz", "d2"), ("l", 1, "same", "d"), ("l", 2, "same", "e"), (None, 8, "abc", "d"), ("m", 4, None, "d"), ("m", 6, "q", None)]
    got = identity.audit(spark.createDataFrame(rows, "k string, i int, t string, d string"), "k", "i", "t", "d").collect()
    assert sorted((r.block, r.representative, r.id, r.copies, r.same_day, r.common, round(r.share, 3)) for r in got) == [("k", 3, 5, 1, True, 4, 0.667), ("k", 3, 7, 1, False, 0, 0.0)]


def served(url):
    """Three rows a day from 2024-01-01 on, two a page; days after the 20th hold none."""
    first, last, page = url.split("/")[-3:]
    first, last = date.fromisoformat(first), date.fromisoformat(last)
    rows = [{"id": f"{d}-{k}", "day": d.isoformat().replace("-", "."), "n": k} for d in (first + timedelta(x) for x in range((last - first).days + 1)) if d <= date(2024, 1, 20) for k in range(3)]
    at = 2 * (int(page) - 1)
    return json.dumps({"a": {"total": len(rows), "items": rows[at : at + 2]}}).encode()


def spoilt(kind):
    def fetch(url):
        doc = json.loads(served(url))
        page = int(url.rsplit("/", 1)[1])
        rows = doc["a"]["items"]
        if kind == "ROW_OUTSIDE_WINDOW" and rows:
            rows[0]["day"] = "2023-12-31"
        if kind == "INVALID_DAY" and rows:
            rows[0]["day"] = "2024-13-01"
        if kind == "DUPLICATE_SOURCE_ID" and page == 2:
            rows[0]["id"] = "2024-01-01-0"
        if kind == "TOTAL_CHANGED" and page == 2:
            doc["a"]["total"] += 1
        if kind == "PARTIAL_LISTING" and page == 2:
            doc["a"]["items"] = []
        if kind == "TOTAL_MISMATCH":
            doc["a"]["total"] = 1
        return json.dumps(doc).encode()

    return fetch


SPOILT = {k: spoilt(k) for k in ("ROW_OUTSIDE_WINDOW", "INVALID_DAY", "DUPLICATE_SOURCE_ID", "TOTAL_CHANGED", "PARTIAL_LISTING", "TOTAL_MISMATCH")}
globals().update(SPOILT)
OPTIONS = {"fetch": "tests.test_sources:served", "url": "x/{first}/{last}/{page}", "from": "2024-01-01", "to": "2024-01-25", "days": "4", "root": "a", "total": "total", "items": "items", "id": "id", "day": "day"}


def test_windows_cover_the_days_once(spark):
    spark.dataSource.register(windows.WindowedListing)
    df = spark.read.format("windowed_listing").options(**OPTIONS).load()
    assert df.rdd.getNumPartitions() == 7
    rows = df.collect()
    assert sorted(r.id for r in rows) == sorted(f"{date(2024, 1, 1) + timedelta(d)}-{k}" for d in range(20) for k in range(3))
    assert all(r["first"] <= r.day <= r["last"] for r in rows)
    with pytest.raises(ListingError, match="INVALID_WINDOW"):
        windows.windows(date(2024, 1, 1), date(2024, 2, 1), 94)
    assert windows.windows(date(2024, 1, 2), date(2024, 1, 1), 5) == []


@pytest.mark.parametrize("kind", SPOILT)
def test_pages_that_break_the_contract(kind):
    with pytest.raises(ListingError, match=kind):
        list(windows.listed(OPTIONS | {"fetch": f"tests.test_sources:{kind}"}, windows.Window(date(2024, 1, 1), date(2024, 1, 4))))


def test_a_stream_goes_on_behind_its_last_window(spark, tmp_path):
    spark.dataSource.register(windows.WindowedListing)
    for last in ("2024-01-08", "2024-01-08", "2024-01-16"):
        df = spark.readStream.format("windowed_listing").options(**OPTIONS | {"to": last}).load()
        df.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    ids = [r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert len(ids) == len(set(ids)) == 48


def test_zone_maps(spark, tmp_path):
    rows = [(i, None if i % 10 else f"t{i % 7}", float(i)) for i in range(1000)]
    spark.createDataFrame(rows, "k int, t string, x double").repartitionByRange(4, "k").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    zones = footers.zone_map(df)
    z = zones.where("column = 't'").agg(F.sum("nulls"), F.sum("rows"), F.min("low"), F.max("high")).first()
    assert tuple(z) == (900, 1000, "t0", "t6") and zones.where("column = 'k'").count() == 4
    got = footers.zone_lookup(df, zones, "k", 700).collect()
    assert [(r.k, r.row_groups) for r in got] == [(700, 1)]
    assert footers.zone_lookup(df, zones, "k", 5000).count() == 0
    assert footers.zone_lookup(df, zones, "t", "t3").count() == sum(r[1] == "t3" for r in rows)
    assert footers.footer_value(df, "org.apache.spark.sql.parquet.row.metadata")["fields"][0]["name"] == "k" and footers.footer_value(df, "none") == {}


def test_sinks_are_one_pass(spark, tmp_path):
    spark.range(50).write.parquet(f"{tmp_path}/in")
    df = spark.read.parquet(f"{tmp_path}/in")
    out = {"rows": F.struct("id", F.lit(None).cast("string").alias("none")), "pairs": F.transform(F.sequence(F.lit(1), F.col("id") % 3), lambda x: F.struct(x.alias("n"))), "odd": F.when(F.col("id") % 2 == 1, F.struct("id")), "never": F.when(F.lit(False), F.struct("id"))}
    got = {r.sink: r.rows for r in sinks.write_sinks(df, out, f"{tmp_path}/out").collect()}
    assert got == {"rows": 50, "pairs": sum(len(range(1, i % 3 + 1)) if i % 3 else 2 for i in range(50)), "odd": 25, "never": 0}
    assert sinks.read_sink(spark, f"{tmp_path}/out", "odd", "id long").agg(F.sum("id")).first()[0] == 625
    assert sinks.read_sink(spark, f"{tmp_path}/out", "never", "id long").count() == 0
    assert json.loads(next((tmp_path / "out").glob("*.json")).read_text()) == got
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_sinks(df, out, f"{tmp_path}/out")


def test_sink_counts_must_agree(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks.Observation, "get", property(lambda self: {"rows": 7}))
    with pytest.raises(SourceError, match="SINK_COUNT_MISMATCH"):
        sinks.write_sinks(spark.range(5), {"rows": F.struct("id")}, f"{tmp_path}/out")


def fetched(endpoint, params):
    p = json.loads(params)
    if p.get("bad"):
        raise ValueError("secret")
    return json.dumps({"court": "c" if p["id"] != "2" else "x"}) if p["id"] != "4" else None


def test_requests_are_asked_once(spark, tmp_path):
    rows = [("1", {"id": "1", "z": "0"}), ("1b", {"z": "0", "id": "1"}), ("2", {"id": "2"}), ("3", {"id": "3", "bad": "1"}), ("4", {"id": "4"})]
    df = spark.createDataFrame([(k, "e", p) for k, p in rows], "k string, endpoint string, params map<string,string>")
    cache = Tables(spark, f"{tmp_path}/cache")
    got, asked = requests.ask(df, cache, "tests.test_sources:fetched")
    assert asked == 4
    out = requests.recovered(got, {"court": (F.lit("c"), F.get_json_object("answer", "$.court"))}).collect()
    assert {r.k: (r.state, r.mismatched) for r in out} == {"1": ("RECOVERED", None), "1b": ("RECOVERED", None), "2": ("IDENTITY_EVIDENCE_MISMATCH", ["court"]), "3": ("REQUEST_FAILED", None), "4": ("NO_ANSWER", None)}
    assert next(r for r in out if r.k == "3").error == "ValueError"
    more = df.unionByName(spark.createDataFrame([("5", "e", {"id": "5"})], df.schema))
    again, asked = requests.ask(more, cache, "tests.test_sources:fetched")
    assert asked == 1 and again.where("answer is not null").count() == 4
    _, asked = requests.ask(more, cache, "tests.test_sources:fetched")
    assert asked == 0 and cache.pin().version == 2
    assert requests.ask(df.limit(0), Tables(spark, f"{tmp_path}/none"), "tests.test_sources:fetched")[1] == 0


def test_staleness_over_random_graphs(spark):
    rng = random.Random(5)
    items = {f"i{k}": f"h{k}" for k in range(40)}
    links = [(f"i{rng.randrange(40)}", f"i{rng.randrange(43)}") for _ in range(45)]
    seen = {(a, b): items.get(b) if rng.random() < 0.9 else "old" for a, b in links}
    rows = [(a, b, seen[a, b]) for a, b in links]
    got = {r.id: (r.state, r.depth, r.changed) for r in staleness.staleness(spark.createDataFrame(list(items.items()), "id string, hash string"), spark.createDataFrame(rows, "id string, upstream string, seen string")).collect()}
    depth = {a: 0 for (a, b), s in seen.items() if items.get(b) != s}
    changed = {a: len({b for (x, b), s in seen.items() if x == a and items.get(b) != s}) for a in depth}
    step = set(depth)
    while step:
        step = {a for a, b in links if b in step and a not in depth}
        depth |= {a: 1 + max(depth.values()) for a in step}
    assert got == {i: ("STALE", depth[i], changed.get(i, 0)) if i in depth else ("FRESH", None, 0) for i in items}
    assert len({d for d in depth.values()}) > 2
    reviews = spark.createDataFrame([(i, h if k % 3 else "other", k % 5 > 0) for k, (i, h) in enumerate(items.items())] + [("gone", "h", True)], "id string, revision string, passed boolean")
    base = spark.createDataFrame(list(items.items()), "id string, hash string")
    states = staleness.review_states(reviews, base, spark.createDataFrame([(i, s) for i, (s, _, _) in got.items()], "id string, state string"))
    of = {r.id: r.review_state for r in states.collect()}
    assert of["gone"] == "ITEM_MISSING" and all(of[i] == ("REVISION_CHANGED" if k % 3 == 0 else "UPSTREAM_STALE" if i in depth else "VALID") for k, i in enumerate(items))
    best = {r.id: r.gold for r in staleness.gold(states).collect()}
    assert all(best[i] == (of[i] == "VALID" and k % 5 > 0) for k, i in enumerate(items))
