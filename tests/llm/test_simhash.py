"""Near duplicates by SimHash against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from caselode.llm import simhash
from caselode.llm.common import materialize
from caselode.llm.graph import components

KIND = "doc_id long, text string, fingerprint string, component_id int"


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values):
    """The smallest index reachable from each of values over links of two bits."""
    values, out = np.array(values, np.uint64), list(range(len(values)))
    for i in range(len(values)):
        if out[i] < i:
            continue
        todo = [i]
        while todo:
            near = np.flatnonzero(np.bitwise_count(values ^ values[todo.pop()]) <= 2)
            for j in near:
                if j > i and out[j] == j:
                    out[j] = i
                    todo.append(int(j))
    return out


ODD = ["", None, " \n\t ", "one", "One TWO", "a b c", "Ünï É \x85 x y", "\x1cfs a\x0bb\x0cc", "x" * 5000, "é z 한국어 q", "ÀB ab ÀB"]


def test_fingerprints_of_odd_texts():
    rng = random.Random(1)
    texts = [*ODD, *(" ".join(f"W{rng.randrange(50)}" for _ in range(n)) for n in (2, 3, 4, 30, 3000))]
    for t in texts:
        for piece in (1, 7, 1 << 20):
            assert simhash.fingerprint((t or "").encode(), piece) == brute_fingerprint(t), t


def test_near_duplicates(spark):
    rng = random.Random(2)
    texts = [*ODD]
    for _ in range(30):
        words = [f"w{rng.randrange(900)}" for _ in range(rng.choice([5, 60, 400]))]
        texts += [" ".join(words)] * rng.choice([1, 1, 4])
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = "edit"
            texts.append(" ".join(words))
    rows = [(None if i % 9 == 0 else i // 2, t, "clash", 7) for i, t in enumerate(texts)]  # repeated and null ids
    df = spark.createDataFrame(rows, KIND).repartition(3)
    prints = [brute_fingerprint(t) for t in texts]
    comps = brute_components(prints)
    assert len(set(comps)) < len(set(prints))  # some differ, yet link
    least = {}
    for (i, *_), c in zip(rows, comps, strict=True):
        least[c] = min([x for x in (least.get(c), i) if x is not None], default=None)
    want = sorted([(i is not None, i or 0, f"{p:016x}", least[c] is not None, least[c] or 0) for (i, *_), p, c in zip(rows, prints, comps, strict=True)])
    got = sorted((r[0] is not None, r[0] or 0, r[1], r[2] is not None, r[2] or 0) for r in simhash.near_duplicates(df).collect())
    assert got == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    named = simhash.near_duplicates(df.select(F.concat(F.lit("k"), F.col("doc_id")).alias("key"), F.col("text").alias("body")), "key", "body")
    assert named.count() == len(rows) and named.where("component_id like 'k%'").count() > 0


def fingerprint_sets(rng):
    """Scattered values, skewed bits, chains, and a dense ball whose members differ in all parts."""
    full = lambda: rng.getrandbits(64)
    skewed = [full() & full() & full() & full() for _ in range(300)]
    chain = [full()]
    for _ in range(60):
        chain.append(chain[-1] ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    centre = full()
    ball = [centre]
    for _ in range(500):
        ball.append(rng.choice(ball) ^ 1 << rng.randrange(64))
    far = [x ^ 7 << 9 for x in rng.sample(ball, 40)]  # three bits off, linked only by chance
    ends = [0, (1 << 64) - 1, 1 << 63, 3, 7]
    return sorted({*skewed, *(full() for _ in range(300)), *chain, *ball, *far, *ends})


@pytest.mark.parametrize("per_row, held", [(simhash.PER_ROW, simhash.HELD), (1, 20), (0, 0)])
def test_links_of_any_density(spark, per_row, held):
    values = fingerprint_sets(random.Random(3))
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    fps = materialize(spark.createDataFrame([(v,) for v in signed], "fp long").repartition(3), "test")
    found, _ = simhash.links(fps, simhash.plan_of(fps, len(values)), per_row, held)
    edges = {(r["a"], r["b"]) for r in found.collect()}
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 2 for a, b in edges)
    comps = {r["node"]: r["component"] for r in components(found).collect()}
    want = {}
    for v, c in zip(signed, brute_components(values), strict=True):
        want.setdefault(c, set()).add(v)
    got = {}
    for v in signed:
        got.setdefault(comps.get(v, v), set()).add(v)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_thresholds_cost_least():
    """The dynamic program against all ways, and the pigeonhole for every way it takes."""
    rng = np.random.default_rng(4)
    values = rng.integers(0, 1 << 63, 500, dtype=np.uint64) & rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    bits = simhash._bits(values)
    joint = bits.T.astype(float) @ bits
    for k in simhash.GROUPS:
        plan = simhash.Plan(simhash.group_bits(joint, len(values), k))
        assert sorted(b for g in plan.groups for b in g) == list(range(64)) and max(map(len, plan.groups)) - min(map(len, plan.groups)) <= 1
        plan.learn(plan.counts(bits), 1e6)
        chosen, cost = plan.thresholds(bits)
        assert ((chosen + 1).sum(axis=1) == 3).all() and chosen.min() >= -1
        price = np.concatenate([np.zeros((len(bits), k, 1)), plan.expected(bits) + simhash.PROBE * plan.probes], axis=2)
        ways = [w for w in np.ndindex(*[4] * k) if sum(w) == 3]
        best = np.min([sum(price[:, g, w[g]] for g in range(k)) for w in ways], axis=0)
        assert np.allclose(cost, best)


def test_correlated_bits_share_a_group():
    rng = np.random.default_rng(5)
    bits = rng.integers(0, 2, (4000, 64))
    bits[:, 1::2] = bits[:, ::2]  # pairs
    groups = simhash.group_bits(bits.T.astype(float) @ bits, len(bits), 4)
    assert all({b ^ 1 for b in g} == set(g) for g in groups)
