"""Prefix tries against brute force, and the query against its SQL."""

import hashlib
import random
from collections import defaultdict

import duckdb
import pytest

from caselode.llm import trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(convs):
    members, ends, size = defaultdict(list), defaultdict(list), {}
    for conv, ids, sizes in convs:
        for d in range(len(ids) + 1):
            members[tuple(ids[:d])].append(conv)
            size[tuple(ids[:d])] = sizes[d - 1] if d else 0
        ends[tuple(ids)].append(conv)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, own in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(own) - 1) * size[p]
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((min(own), len(p), min(members[p[:-1]]) if p else -1, len(own), children[p] if p in children else 0, leaves[p], saved[p], digest(p)) for p, own in members.items())


def got(df):
    return sorted(tuple(-1 if r[c] is None else r[c] for c in COLUMNS) for r in df.collect())


def shapes(rng):
    """Sequences that share openings, copies, prefixes of others, and a long common chain with a late split."""
    base = [[rng.randrange(4) for _ in range(rng.randrange(9))] for _ in range(60)]
    chain = [9] * 40
    base += [chain + [k % 3] * (k % 5) for k in range(12)] + [chain[:k] for k in (10, 25, 25)] + [base[0]] * 9 + [[]]
    return [(i * 3 - 20, seq, [7 + x for x in seq]) for i, seq in enumerate(base)]


@pytest.mark.parametrize("local", [trie.LOCAL, 60, 0])
def test_trie(spark, local):
    convs = shapes(random.Random(4))
    df = spark.createDataFrame(convs, "conv_id long, ids array<long>, sizes array<long>").repartition(3)
    assert got(trie.trie(df, local)) == brute(convs)


@pytest.mark.parametrize("convs", [[], [(5, [], [])], [(5, [1, 2], [3, 4])], [(5, [1, 2], [3, 4]), (-2, [1, 2], [3, 4])]])
def test_small_tries(spark, convs):
    df = spark.createDataFrame(convs, "conv_id long, ids array<long>, sizes array<long>")
    for local in (trie.LOCAL, 0):
        assert got(trie.trie(df, local)) == brute(convs)


def test_ids_are_joined_over_pieces(spark):
    keys = {b"a": [5, 40, 300, -7, 12, 8, 9], b"b": [1], b"c": list(range(50))}
    df = spark.createDataFrame([(k, c) for k, own in keys.items() for c in own], "key binary, conv_id long").repartition(4)
    for piece in (1, 3, 1000):
        found = {bytes(r["key"]): r["digest"] for r in trie.ends(df, piece).collect()}
        assert found == {k: hashlib.sha256(",".join(map(str, sorted(own))).encode()).hexdigest() for k, own in keys.items()}


def test_query_is_its_sql(spark, tmp_path):
    rng = random.Random(6)
    rows, texts = [], ["hi", "HI", "", None, "é한", "x" * 30_000, "a:b", "1:"]
    for c in [None, -7, -1, *range(60), 10**12 + 3]:
        for t in rng.sample([None, *range(14)], rng.choice([1, 3, 9, 12])):
            rows.append((c, t, rng.choice(["user", "assistant", None, ""]), rng.choice(texts[: rng.choice([1, 2, 8])]), 1, "clash"))
    rows += [(7, 3, "user", "hi", 1, "clash")] * 3  # ties and repeated rows
    kind = "conv_id long, turn long, role string, text string, depth long, ids string"
    df = spark.createDataFrame(rows, kind).repartition(3)
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = sorted(tuple(-1 if x is None else x for x in r) for r in sql.sql(f"SELECT {', '.join(COLUMNS)} FROM ({trie.trie_sql()})").fetchall())
    df = trie.op12_prefix_trie(spark, str(tmp_path))
    assert got(df) == want and len(want) > 100
    df.limit(0).sparkSession.createDataFrame([], kind).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert trie.op12_prefix_trie(spark, f"{tmp_path}/none").count() == 0


def test_turns_of_one_number_are_ordered(spark):
    """Ties in turn go by role, then by a hash: the same whatever the order of the rows."""
    rows = [(1, 0, r, t) for r in ("b", None, "a") for t in ("x", "y", "z")]
    found = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        turns = trie.encoded(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
        r = trie.sequences(turns).first()
        names = {x["turn_id"]: (x["role"], x["tie"]) for x in turns.collect()}
        found.add(tuple(names[i] for i in r["ids"]))
        assert [n[0] for n in (names[i] for i in r["ids"])] == [""] * 3 + ["a"] * 3 + ["b"] * 3
    assert len(found) == 1
