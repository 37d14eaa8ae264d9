"""Typed walks against a plain search."""

import random
from collections import deque

from pyspark.sql import functions as F

from caselode.operators.walk import Kind, Relation, reason_counts, verdicts, walk


def brute(nodes, relations, root):
    """nodes: {kind: {id: reasons}}; relations: (name, source, target, links, required)."""
    out = {}
    for r in nodes[root]:
        seen, todo = {}, deque([(root, r, 0, None)])
        while todo:
            kind, i, depth, via = todo.popleft()
            if (kind, i) in seen:
                if via and i not in nodes[kind] and seen[kind, i][0] == depth:
                    seen[kind, i][1].add(f"MISSING:{via}")
                continue
            if i not in nodes[kind]:
                seen[kind, i] = (depth, {f"MISSING:{via}"})
                continue
            why = set(nodes[kind][i])
            for name, source, target, links, required in relations:
                if source == kind:
                    own = [b for a, b in links if a == i and b is not None]
                    if required and not own:
                        why.add(f"NONE:{name}")
                    todo.extend((target, b, depth + 1, name) for b in own)
            seen[kind, i] = (depth, why)
        out |= {(r, kind, i): (d, tuple(sorted(w))) for (kind, i), (d, w) in seen.items()}
    return out


def test_walk_over_random_graphs(spark):
    rng = random.Random(8)
    kinds = ["case", "block", "span"]
    ids = {k: [f"{k[0]}{i}" for i in range(14)] for k in kinds}
    nodes = {k: {i: {"BAD"} if rng.random() < 0.2 else set() for i in own if rng.random() < 0.8} for k, own in ids.items()}
    relations = []
    for name, a, b, required in (("blocks", "case", "block", True), ("next", "block", "block", False), ("spans", "block", "span", True), ("owner", "span", "case", False), ("other", "block", "block", False)):
        links = [(rng.choice(ids[a]), rng.choice([None, *ids[b]])) for _ in range(16)]
        relations.append((name, a, b, links + links[:2], required))
    of = {k: Kind(spark.createDataFrame([(i, not w) for i, w in own.items()], "id string, sound boolean"), {"BAD": F.col("sound")}) for k, own in nodes.items()}
    rel = [Relation(n, a, b, spark.createDataFrame(links, "source string, target string"), r) for n, a, b, links, r in relations]
    reached = walk(of, rel, "case")
    got = {(r.root, r.kind, r.id): (r.depth, tuple(r.reasons)) for r in reached.collect()}
    assert got == brute(nodes, relations, "case") and max(d for d, _ in got.values()) >= 4
    per = {r.root: r for r in verdicts(reached).collect()}
    for root in nodes["case"]:
        own = {k: v for k, v in got.items() if k[0] == root}
        assert per[root].nodes == sum(not any(x.startswith("MISSING") for x in w) for _, w in own.values())
        assert per[root].reasons == sorted({x for _, w in own.values() for x in w}) and per[root].broken == sum(bool(w) for _, w in own.values())
    counts = {(r.kind, r.reason): (r.roots, r.nodes) for r in reason_counts(reached).collect()}
    assert counts[("block", "BAD")] == (len({k[0] for k, v in got.items() if k[1] == "block" and "BAD" in v[1]}), len({k[2] for k, v in got.items() if k[1] == "block" and "BAD" in v[1]}))


def test_odd_graphs(spark):
    none = spark.createDataFrame([], "id string")
    links = spark.createDataFrame([("a", "a"), (None, "a"), ("a", None)], "source string, target string")
    assert walk({"n": Kind(none)}, [Relation("self", "n", "n", links)], "n").count() == 0
    one = spark.createDataFrame([("a",), ("a",), (None,)], "id string")
    assert [tuple(r) for r in walk({"n": Kind(one)}, [Relation("self", "n", "n", links, True)], "n").collect()] == [("a", "n", "a", 0, ["REPEATED"])]
    lost = walk({"n": Kind(one)}, [Relation("self", "n", "n", links)], "n", spark.createDataFrame([("z",), ("z",)], "id string"))
    assert [tuple(r) for r in lost.collect()] == [("z", "n", "z", 0, ["MISSING:ROOT"])]


def shuffled(spark, job):
    """Records that the stages of a job write for shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        it, out = store.stageList(None, False, False, getattr(store, "stageList$default$4")(), None).iterator(), {}
        while it.hasNext():
            x = it.next()
            out[x.stageId(), x.attemptId()] = x.shuffleWriteRecords()
        return out

    before = stages()
    job()
    return sum(n for k, n in stages().items() if k not in before)


def test_rounds_shuffle_pairs_nodes_and_links_once(spark):
    """all nodes, links and former pairs were shuffled several times a round."""
    n = 4000
    ids = spark.range(n).select(F.concat_ws("-", "id", F.lit(7)).alias("id"))
    on = ids.select(F.col("id").alias("source"), F.col("id").alias("target"))
    kinds = {k: Kind(ids) for k in ("a", "b", "c")}
    relations = [Relation("to_b", "a", "b", on, required=True), Relation("to_c", "b", "c", on, required=True)]
    out = {}
    moved = shuffled(spark, lambda: out.update(rows=walk(kinds, relations, "a").count()))
    assert out["rows"] == 3 * n
    assert moved <= 7.2 * n  # nodes of three kinds, two relations, two rounds of pairs; 12 n before


def test_packed_ids(spark):
    ids = ["", "0", "00", "7", "12-3", "1-2_3:4./5", "12\n", "f", "F0", "a-1", "\u0661\u0662", "\x00", "\x001", "-", "--", " 1", "\ud55c\uae00"]
    nodes, links = spark.createDataFrame([(i,) for i in ids], "id string"), spark.createDataFrame([(i, i + "0") for i in ids], "source string, target string")
    got = {(r.root, r.kind, r.id, tuple(r.reasons)) for r in walk({"n": Kind(nodes)}, [Relation("on", "n", "m", links)], "n").collect()}
    assert got == {(i, "n", i, ()) for i in ids} | {(i, "m", i + "0", ("MISSING:on",)) for i in ids}


def test_reasons_and_verdicts_shuffle_little(spark):
    """counting reasons shuffles broken pairs only, on top of the walk's own rounds."""
    n = 4000
    ids = spark.range(n).select(F.col("id").cast("string").alias("id"))
    on = ids.select(F.col("id").alias("source"), F.col("id").alias("target"))
    kinds = {"a": Kind(ids), "b": Kind(ids, {"FEW": F.expr("id % 100 <> 0")})}
    relations, out = [Relation("to_b", "a", "b", on, required=True)], {}
    moved = shuffled(spark, lambda: out.update(rows=reason_counts(walk(kinds, relations, "a")).collect()))
    assert [tuple(r) for r in out["rows"]] == [("b", "FEW", n // 100, n // 100)]
    assert moved <= 4.3 * n  # nodes of two kinds, a relation, a round of pairs, 80 broken ones twice
    rows = {r.root: tuple(r)[1:] for r in verdicts(walk(kinds, relations, "a")).collect()}
    assert len(rows) == n and rows["100"] == (2, 1, 1, ["FEW"]) and rows["101"] == (2, 1, 0, [])
