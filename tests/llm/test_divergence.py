"""Source divergence against brute force."""

import random
import re
from collections import Counter, defaultdict

import pytest

from caselode.llm import divergence
from caselode.llm.divergence import ADDED, UNIT

KIND = "doc_id long, text string, lang string, source string, value string, rank int"


def brute(rows, least, top):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in ((t or "", x or "", s or "") for _, t, x, s, *_ in rows):
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        total = Counter()
        for s in sources:
            total.update({t: counts[lang, s][t] for t in kept})

        def shares(c):
            whole = sum(c[t] for t in kept) + ADDED * len(kept)
            return {t: 1 + UNIT * (c[t] + ADDED) // whole for t in kept}

        q, p = shares(total), {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                for k, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode())), 1):
                    if part == "pair" or k <= top:
                        out.append((lang, s, part, item, value, k))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    pool = ["the", "The", "ÀÉ", "àé", "한국", "x1y", "z\x7fq", "[b]", "\x85n", "𝒳", *(f"w{a}{b}" for a in "abcdefgh" for b in "xyz")]
    out = []
    for i in range(260):
        own = rng.sample(pool, 12)
        text = rng.choice([" ", "\n", "-"]).join(rng.choice(own) for _ in range(rng.choice([0, 3, 20, 80])))
        out.append((i // 2, text, rng.choice(["en", "de", None, ""]), rng.choice([None, *(f"s{k}" for k in range(9))]), "clash", 1))
    out += [(None, None, "fr", "only", None, None), (7, "rare words", "it", "a", None, None), (7, None, "it", "b", None, None), (7, "", "it", "", None, None)]
    out += [(9, "w " * 40_000 + "the", "en", "long", None, None), (9, "the" * 30_000, "en", "s0", None, None)]
    return out


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


@pytest.mark.parametrize("sources, top", [(256, 50), (2, 3), (1, 50)])
def test_divergence(spark, rows, sources, top):
    df = spark.createDataFrame(rows, KIND).repartition(5)
    want = brute(rows, 6, top)
    assert {r[2] for r in want} == {"pair", "term"} and any(r[0] == "it" and r[4] == 0 for r in want)
    assert got(divergence.divergence(df, least=6, top=top, sources=sources)) == want


def test_runs_over_batches_and_flushes(spark, rows):
    df = spark.createDataFrame(rows, KIND).repartition(3)
    plain = sorted(map(tuple, divergence.kept_runs(divergence.counted(df), 6).drop("first").collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        small = divergence.kept_runs(divergence.counted(df, held=5), 6).drop("first").collect()
        assert sorted(map(tuple, small)) == plain
        assert got(divergence.divergence(df, least=6, sources=3)) == brute(rows, 6, 50)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_long_texts_are_cut_at_blanks():
    text = "Ab, cd é-\x7fX" * 50
    for piece in (1, 3, 10, 1 << 20):
        assert divergence.terms_of(text.encode(), piece) == divergence.terms_of(text.encode())


def test_no_rows(spark, rows):
    assert divergence.divergence(spark.createDataFrame([], KIND)).count() == 0
    assert all(r[2] == "pair" for r in got(divergence.divergence(spark.createDataFrame(rows[:40], KIND), least=1000)))
