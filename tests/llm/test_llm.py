"""The training-data operators against brute force, round trips and odd inputs."""

import hashlib
import json
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from caselode.llm import chat, imatch, jaccard, langid, mix, pack, quality, shards, tokencount, tokenfile, transducer
from caselode.llm.bpe import byte_bpe, default_path
from caselode.llm.common import scratch_path
from caselode.llm.graph import components

KIND = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, " \n\t ", "one", "a b c d", "Ünïcödé ﬁ Σς ß 한국어  x", "tab\there\r\nand\x0bvt\x0cff", "x" * 5000, "It's 12's [x] <|endoftext|> y<|startoftext|>z", "  lead  and   trail  ", "\x1cfs 🙂🙂 é"]


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    texts = [*ODD]
    for k in range(40):
        base = words(rng, rng.choice([6, 12, 30, 80, 300]))
        texts.append(base)
        for _ in range(rng.randrange(3)):
            w = base.split()
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(99)}"
            texts.append(" ".join(w))
    texts += [texts[12].upper(), texts[12], texts[12]]
    rows = [(i * 3, t, ["en", "de", None][i % 3], f"src{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, KIND).repartition(3), {r[0]: r[1] or "" for r in rows}


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


# -- 1 ------------------------------------------------------------------------


def spark_hash(values):
    """Spark's xxhash64 of strings and longs, one after the other; an array counts as its elements."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True) if abs(v) > 9 else v.to_bytes(4, "little"), seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def imatch_terms(t):
    return {w for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if w}


def brute_fingerprint(t, band):
    used = sorted(imatch_terms(t) & band, key=lambda w: w.encode())
    parts, per = [spark_hash(used or sorted(imatch_terms(t), key=lambda w: w.encode()))], 64 // (imatch.LEVELS * imatch.BITS)
    for family in range(imatch.FAMILIES):
        salt, k = divmod(family, per)
        own = [spark_hash([w, salt]) for w in used]
        for level in range(imatch.LEVELS):
            own = [h for h in own if (h % (1 << 64)) >> (k * imatch.LEVELS * imatch.BITS + level * imatch.BITS) & ((1 << imatch.BITS) - 1) == 0]
            parts.append(spark_hash(own))
    return parts


def brute_likeness(a, b):
    counted = [(x, y) for x, y in zip(a, b, strict=True) if x != imatch.EMPTY or y != imatch.EMPTY]
    return sum(x == y for x, y in counted) / len(counted) if counted else 1.0


def test_imatch(spark, corpus, tmp_path, empty):
    df, texts = corpus
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in imatch.op1_imatch(spark, str(tmp_path)).collect()}
    ids = sorted(texts)
    seen = Counter(w for t in texts.values() for w in imatch_terms(t))
    n = len(texts)
    band = {w for w, c in seen.items() if max(2, imatch.LOW * n) <= c <= imatch.HIGH * n}
    assert band and band == {w for part in imatch.lexicon(df) for w in part}
    as_text = lambda parts: "".join(f"{h & 0xFFFFFFFF:08x}" for h in parts)
    for i, k in enumerate(ids):
        t, nxt = texts[k], texts[ids[(i + 1) % len(ids)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[k]
        own, other, changed = (brute_fingerprint(x, band) for x in (t, nxt, edited))
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (as_text(own), as_text(changed))
        assert (r.near_edited, r.near_next) == (brute_likeness(own, changed), brute_likeness(own, other))
    assert imatch.fingerprints(empty).count() == 0


def test_imatch_tells_halves_from_strangers(spark, tmp_path):
    """An edited text is nearer than the next one, for almost all texts."""
    rng = random.Random(13)
    rows = [(i, " ".join(f"w{int(3000 * rng.random() ** 3)}" for _ in range(rng.choice([20, 60, 200, 900])))) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    r = imatch.op1_imatch(spark, str(tmp_path)).where("near_edited > near_next").count()
    assert r >= 0.95 * len(rows)


def test_imatch_band_and_ties(spark):
    rows = [(1, "common rare1"), (1, "common mid"), (2, "common mid"), (None, "common")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("range", F.lit(1)).withColumn("parts", F.lit("x"))
    assert [t for part in imatch.lexicon(df, low=0.4, high=0.6) for t in part] == ["mid"]
    nxt = imatch.with_next(df.select("doc_id", "text"), "doc_id", "text", ["text"]).collect()
    order = [r[0] for r in df.where("doc_id = 1").orderBy(imatch._mixed("text")).select("text").collect()]  # ties go by hash
    assert {(r.doc_id, r.text): r.next_text for r in nxt} == {(None, "common"): order[0], (1, order[0]): order[1], (1, order[1]): "common mid", (2, "common mid"): "common"}
    one = imatch.with_next(spark.createDataFrame([(5, "a")], "doc_id long, text string"), "doc_id", "text", ["text"]).first()
    assert one.next_text == "a"


def test_imatch_without_a_common_term(spark, tmp_path):
    """Texts without a term of the band are like only those of the same terms."""
    rows = [(i, f"only{i} never{i}") for i in range(50)] + [(60, "b a"), (61, "A, b!"), (62, "?!"), (63, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    band = imatch.lexicon(spark.read.parquet(f"{tmp_path}/documents.parquet"), high=0.01)
    assert not any(band)
    got = {r.doc_id: r.fingerprint for r in imatch.fingerprints(spark.read.parquet(f"{tmp_path}/documents.parquet"), band=band).collect()}
    assert len({got[i] for i in range(50)}) == 50 and got[60] == got[61] != got[62] == got[63]
    near = {r.doc_id: r for r in imatch.op1_imatch(spark, str(tmp_path)).collect()}
    assert near[0].near_next == 0 and near[60].near_next == 1 and near[62].near_next == 1


def test_rows_of_one_id_are_dealt_over_ranges(spark):
    """A third of the ids null and a third one number: no range holds a large share, and the order is one cycle."""
    rows = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = {r.text: (r.doc_id, r.next_text) for r in imatch.with_next(df, "doc_id", "text", ["text"]).collect()}
    at, seen = "t0", []
    for _ in rows:
        seen.append(out[at][0])
        at = out[at][1]
    assert at == "t0" and len(out) == 3000
    start = next(k for k in range(3000) if seen[k] is None and seen[k - 1] is not None)
    seen = [-1 if x is None else x for x in seen[start:] + seen[:start]]
    assert seen == sorted(seen)
    taken = imatch.ranges(df, "doc_id", "text")[0].groupBy("range").count().agg(F.max("count")).first()[0]
    assert taken < 400


# -- 2, 4 ---------------------------------------------------------------------


def test_pack_covers_every_id_once(spark, corpus, empty):
    df, texts = corpus
    path = default_path("byte_bpe_50k.json")
    ids = {k: np.append(byte_bpe(path).slow.encode(t, add_special_tokens=False).ids, 1).astype("<u4") for k, t in texts.items()}
    pieces = pack.pack(df, path, window=64)
    part_of = {r.doc_id: r.part for r in pack.tokenize(df, path, 1).select("doc_id", "part").collect()}
    by_doc, by_seq = {}, {}
    for r in pack.digest(pieces).collect():
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans, ends in ((by_doc, {k: len(v) for k, v in ids.items()}), (by_seq, None)):
        for k, v in spans.items():
            at = 0
            for start, length in sorted(v):
                assert start == at
                at += length
            if ends:
                assert at == ends[k]
    assert len(by_doc) == len(texts) and sorted(by_seq) == list(range(len(by_seq)))
    assert [sum(n for _, n in v) for _, v in sorted(by_seq.items())][:-1] == [64] * (len(by_seq) - 1)
    rows = sorted(pack.assemble(pieces, 64).collect())
    assert [r.sequence_id for r in rows] == list(range(len(by_seq)))
    assert [r.n_tokens for r in rows[:-1]] == [64] * (len(rows) - 1) and rows[-1].n_tokens <= 64
    stream = b"".join(bytes(p.ids) for r in rows for p in r.pieces)
    assert len(stream) == 4 * sum(map(len, ids.values()))
    at = Counter()
    for p in (p for r in rows for p in r.pieces):
        assert bytes(p.ids) == ids[p.doc_id][p.start : p.start + p.length].tobytes() and p.start == at[p.doc_id]
        at[p.doc_id] += p.length
    # boundary: the windows that take tokens from two partitions, no others
    sources = {}
    for r in pieces.select("sequence_id", "boundary", "doc_id").collect():
        sources.setdefault((r.sequence_id, r.boundary), set()).add(part_of[r.doc_id])
    assert all((len(parts) > 1) is across for (_, across), parts in sources.items()) and len(sources) == len(by_seq)
    assert pack.pack(empty, path).count() == 0 and pack.assemble(pack.pack(empty, path)).count() == 0


def test_one_partition_has_no_boundary(spark):
    df = spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string").coalesce(1)
    assert [r.boundary for r in pack.pack(df, default_path("byte_bpe_50k.json")).collect()] == [False]


def test_repeated_ids_pack_apart(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string").withColumn("offset", F.lit(0))
    assert pack.pack(df, default_path("byte_bpe_50k.json")).agg(F.sum("length")).first()[0] == 6


def test_byte_bpe_is_the_library():
    bpe = byte_bpe(default_path("byte_bpe_50k.json"))
    assert bpe.fast is not None
    rng = random.Random(3)
    alphabet = "ab AB1 \n\t'.,é한🙂  <|endoftext|>"
    for t in [x or "" for x in ODD] + ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(300)]:
        assert bpe.encode(t).tolist() == bpe.slow.encode(t, add_special_tokens=False).ids


def test_files_with_other_merge_orders_go_to_the_library(tmp_path):
    with open(default_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    merges = spec["model"]["merges"]
    merges[0], merges[1] = merges[1], merges[0]
    with open(f"{tmp_path}/swapped.json", "w", encoding="utf-8") as f:
        json.dump(spec, f)
    bpe = byte_bpe(f"{tmp_path}/swapped.json")
    assert bpe.fast is None
    assert bpe.encode(" the thing it is").tolist() == bpe.slow.encode(" the thing it is", add_special_tokens=False).ids


def test_token_files_round_trip(spark, corpus, empty):
    df, texts = corpus
    path, uri = default_path("byte_bpe_50k.json"), scratch_path(spark, "t")
    manifest = tokenfile.write_ids(df, uri, path, width=16)
    at = 0
    for r in sorted(tokenfile.read_ids(manifest, uri).collect(), key=lambda r: r.doc_id):
        want = np.append(byte_bpe(path).slow.encode(texts[r.doc_id], add_special_tokens=False).ids, 0).astype("<u4")
        assert (r.start, r.n_tokens, bytes(r.ids)) == (at, len(want), want.tobytes())
        at += len(want)
    import pyarrow as pa

    name = manifest.first()["file"]
    f = pa.ipc.open_file(pa.memory_map(f"{uri.removeprefix('file://')}/{name}"))
    ids = sum(int(np.asarray(f.get_batch(i).column(1).flatten()).sum()) for i in range(f.num_record_batches))
    assert pa.types.is_fixed_size_list(f.schema.field("ids").type)
    assert ids == manifest.where(F.col("file") == name).agg(F.sum("n")).first()[0]
    assert tokenfile.read_ids(tokenfile.write_ids(empty, scratch_path(spark, "e"), path), uri).count() == 0


def test_token_files_of_odd_rows(spark):
    """Null, equal and clashing: every row once, in order of id, gapless, over several files."""
    path, uri = default_path("byte_bpe_50k.json"), scratch_path(spark, "o").removeprefix("file://")
    rows = [(None, "no id"), (None, None), *((5, f"text {i % 7}") for i in range(60)), (2, "x" * 70_000), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("clash")).withColumn("file", F.lit(1)).withColumn("mix", F.lit(1))
    manifest = tokenfile.write_ids(df, uri, path, width=16)  # a bare path is the default file system's
    got = sorted(tokenfile.read_ids(manifest, uri).collect(), key=lambda r: r.start)
    want = Counter((k, np.append(byte_bpe(path).slow.encode(t or "", add_special_tokens=False).ids, 0).astype("<u4").tobytes()) for k, t in rows)
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == want
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    assert [r.doc_id for r in got] == [None] * 2 + [2] + [5] * 60 + [9]
    assert manifest.where("doc_id = 5").select("file").distinct().count() > 1
    with pytest.raises(ValueError):
        n = manifest.where("doc_id = 9").first()
        tokenfile.IdFile(tokenfile.resolved(spark, uri), n["file"]).ids(n["local_start"], n["n"] + 1)


# -- 3 ------------------------------------------------------------------------


def library_counts(machine, texts):
    return [len(machine.library.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_token_counts(spark, corpus, empty):
    df, texts = corpus
    path = default_path("word_bpe_49k.json")
    machine = transducer.transducer(path)
    want = dict(zip(texts, library_counts(machine, texts.values()), strict=True))
    for chunk, fan in ((1 << 16, 32), (7, 2), (100, 3)):
        got = {r.doc_id: r for r in tokencount.count_tokens(df, path, chunk=chunk, fan=fan).collect()}
        assert {k: (r.n_bytes, r.n_tokens) for k, r in got.items()} == {k: (len(t.encode()), want[k]) for k, t in texts.items()}
    assert tokencount.count_tokens(empty, path).count() == 0


def test_token_counts_of_odd_rows(spark):
    """Null and repeated ids, ids that are no numbers, clashing columns, words and texts over many chunks."""
    path = default_path("word_bpe_49k.json")
    machine = transducer.transducer(path)
    long = "a" * 150_000 + " b " + "tree's 12 " * 20_000
    texts = [None, "", long, long, "x" * 70_000 + "<|endoftext|>y", "\U00020000 z" * 30_000]
    rows = [(["k", None][i % 2], t, 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id string, text string, n_tokens int").withColumn("row", F.lit("clash"))
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.count_tokens(df, path).collect()), key=str)
    want = [(k, len((t or "").encode()), n, n > 2048) for (k, t, _), n in zip(rows, library_counts(machine, texts), strict=True)]
    assert got == sorted(want, key=str)


def test_transducer_is_the_library():
    machine = transducer.Transducer(default_path("word_bpe_49k.json"))
    rng = random.Random(9)
    parts = ["a", "e", "s", "t", "re", "ll", "v", "'", "''", " ", "\n", "1", "٣", "é", "e\u0301", "ß", "Σ", "İ", "한", "ㅎ", "ᄒ\u1161", "🙂", "\U00020000", "!", "...", "<|endoftext|>", "\x1c", "\u3000", "ſ", "K", "th", "ing"]
    texts = [*ODD, *("".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(3000))]
    texts += ["".join(rng.choice("abcdehilnorstu") for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += [*("a" * k for k in range(120)), *("ab" * k + "a" for k in range(60)), "haha" * 900]
    want = library_counts(machine, texts)
    assert machine.tokens(texts) == want
    machine._clear()  # states are numbered anew
    assert machine.tokens(texts[::-1]) == want[::-1]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_chunks_compose_to_the_whole(size):
    machine = transducer.transducer(default_path("word_bpe_49k.json"))
    rng = random.Random(size)
    for t in ["".join(rng.choice(["a", "b", " ", "\n", "'s", "e\u0301", "1", "🙂", "."]) for _ in range(60)) for _ in range(60)]:
        whole = machine.normal(t)
        maps = [machine.map_of(whole[i : i + size]) for i in range(0, max(1, len(whole)), size)]
        left = maps[0]
        for m in maps[1:]:
            left = machine.compose(left, m)
        while len(maps) > 1:
            maps = [machine.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        assert left == maps[0]  # composing is associative
        assert machine.total(left) == len(machine.library.encode(t, add_special_tokens=False).ids)


def test_unknown_tokenizer_files_are_refused(tmp_path):
    with open(default_path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    changes = [
        ("normalizer", {"type": "NFKC"}),
        ("pre_tokenizer", {"type": "Whitespace"}),
        ("model", spec["model"] | {"byte_fallback": True}),
        ("model", spec["model"] | {"merges": spec["model"]["merges"][::-1]}),
    ]
    for k, (key, value) in enumerate(changes):
        with open(f"{tmp_path}/{k}.json", "w", encoding="utf-8") as f:
            json.dump(spec | {key: value}, f)
        with pytest.raises(Exception):  # the library itself refuses some
            transducer.Transducer(f"{tmp_path}/{k}.json")
    with pytest.raises(transducer.Unsupported):
        transducer.Transducer(default_path("byte_bpe_50k.json"))


# -- 5 ------------------------------------------------------------------------


def test_template_is_reversible(spark):
    texts = ["<|end|>", "<\\|end|>", "<\\\\|", "<<|turn|>x<|says|>", "plain", "", "\n<|", "|>", "</s>[INST] ok [/INST]", "<"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    for r in df.select("x", chat.escape(F.col("x")).alias("e"), chat.unescape(chat.escape(F.col("x"))).alias("u")).collect():
        assert r.u == r.x and "<|" not in r.e


def tree(spark, rows):
    return spark.createDataFrame(rows, "tree long, id long, parent long, role string, text string, score double").withColumn("leaf", F.lit("clash"))


def test_reply_trees(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a1", 0.2), (1, 3, 1, "assistant", "a2 <|end|>", 0.9), (1, 4, 3, "user", None, None), (2, 1, 9, "user", "orphan", 0.0), (3, 1, 2, "user", "loop", 0.0), (3, 2, 1, "user", "loop", 0.0), (3, 3, 1, "user", "below", 0.0), (None, 1, None, None, "n", 0.0)]
    out = chat.linearize(tree(spark, rows))
    got = {(r.tree, r.leaf): [(t.role, t.text) for t in r.turns] for r in out.select("tree", "leaf", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert got == {("1", 2): [("user", "q"), ("assistant", "a1")], ("1", 4): [("user", "q"), ("assistant", "a2 <|end|>"), ("user", "")], ("2", 1): [("user", "orphan")], (None, 1): [("", "n")]}
    best = chat.linearize(tree(spark, rows), branches=1).where("tree = '1'").collect()
    assert [r.leaf for r in best] == [4]
    loss = out.select("leaf", "tree", chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("l")).where("tree = '1'").collect()
    assert {r.leaf: r.l for r in loss} == {2: "a1", 4: "a2 <|end|>"}
    assert chat.linearize(tree(spark, [])).count() == 0


def test_best_branches_of_random_trees(spark):
    """The chosen leaves and their ranks against brute force, ties among them."""
    rng = random.Random(21)
    rows, want = [], {}
    for t in range(12):
        parent = {1: None} | {i: rng.randrange(max(1, i - 6), i) for i in range(2, 40)}
        score = {i: rng.choice([None, 0.0, 0.25, 0.5, 1.0]) for i in parent}
        rows += [(t, i, p, rng.choice(["user", "assistant"]), f"t{i}", score[i]) for i, p in parent.items()]
        means = {}
        for leaf in set(parent) - set(parent.values()):
            way = [leaf]
            while parent[way[-1]]:
                way.append(parent[way[-1]])
            means[leaf] = (sum(score[i] or 0 for i in way) / len(way), len(way))
        best = sorted(means, key=lambda k: (-means[k][0], k))[:3]
        want |= {(str(t), leaf): (k + 1, means[leaf][1]) for k, leaf in enumerate(best)}
    got = chat.linearize(tree(spark, rows), branches=3).collect()
    assert {(r.tree, r.leaf): (r.rank, r.n_turns) for r in got} == want


def test_long_chain_doubles(spark):
    rows = [(1, i, i - 1 if i else None, "assistant" if i % 2 else "user", f"t{i}", 0.0) for i in range(37)]
    r = chat.linearize(tree(spark, rows)).select("n_turns", chat.read_turns(F.col("formatted")).alias("t")).collect()
    assert len(r) == 1 and r[0].n_turns == 37 and [t.text for t in r[0].t] == [f"t{i}" for i in range(37)]


# -- 6 ------------------------------------------------------------------------


def brute_components(texts):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = {}
    for k, t in texts.items():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t.translate(low)) if x]
        sets[k] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    up = {k: k for k in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k)) for k in ids}


def test_jaccard_components(spark, corpus, empty):
    df, texts = corpus
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()}
    assert got == brute_components(texts)
    assert jaccard.near_duplicates(empty).count() == 0


def test_jaccard_near_the_threshold(spark):
    """Texts that share all sizes of parts: light, heavy and mixed pairs on both sides of 0.8, chains too."""
    rng = random.Random(11)
    texts, k = {}, 0
    for n in (5, 6, 8, 9, 10, 13, 14, 15, 18, 20, 40, 90, 200, 1500):
        base = [f"b{n}x{i}" for i in range(n)]
        for cut in (0, 1, 2, n // 20, n // 10, n // 9, n // 8, n // 5):
            w = [*base]
            for _ in range(rng.randrange(2)):
                w[rng.randrange(n)] = f"z{k}"
            texts[k] = " ".join(w[cut:] + [f"tail{k}x{i}" for i in range(rng.randrange(2))])
            k += 1
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()}
    assert got == brute_components(texts)


def test_many_texts_with_a_common_passage(spark):
    rng = random.Random(5)
    common = " ".join(f"c{i}" for i in range(60))
    texts = {i: f"{common} {words(rng, 12, 9000)}" if i % 2 else f"{words(rng, 90, 9000)} {common}" for i in range(120)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()}
    assert got == brute_components(texts)


def test_hot_lists_and_classes_are_split(spark, monkeypatch):
    """Blocks, shares and shares of classes far below the sizes of lists: the same components."""
    for name, value in (("BLOCK", 3), ("SHARE", 2), ("HOT", 2)):
        monkeypatch.setattr(jaccard, name, value)
    monkeypatch.setattr(jaccard.cross_pairs, "__defaults__", (3,))
    rng = random.Random(6)
    common = [f"c{i}" for i in range(40)]
    texts = {}
    for i in range(90):
        w = [*common[: rng.randrange(20, 40)], *(f"z{i % 9}x{k}" for k in range(rng.randrange(4, 30)))]
        texts[i] = " ".join(w if i % 3 else common)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()}
    assert got == brute_components(texts)


def test_unlike_sets_of_one_name(spark):
    """Names of three bits, shared by nearly all sets: the other names keep them apart."""
    rng = random.Random(3)
    texts = {i: words(rng, 30, 5000) for i in range(25)}
    texts |= {100 + i: texts[i] + " more" for i in range(8)} | {200 + i: texts[i].upper() for i in range(5)} | {300: "", 301: "a b"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, bits=3).collect()}
    assert got == brute_components(texts)
    s = jaccard.shingle_set(texts[0])
    name, other = jaccard.class_names(s, 3)
    assert 0 <= name < 8 and jaccard.Names(3, frozenset([name])).of(s) == other and jaccard.Names(3).of(s) == name


def test_counts_rank_at_any_size():
    counts = np.array([0, 1, 2, 3, 10, 255, 256, 1000, 70_000, 10**9], np.uint64)
    steps = jaccard.scaled(counts)
    assert (np.diff(steps.astype(int))[:5] > 0).all() and (np.diff(steps.astype(int)) >= 0).all() and steps[-1] < 255
    c = jaccard._Counters(8)
    c.add(np.repeat(np.array([7 << 56], np.uint64), 70_000))
    c.add(np.array([9 << 56] * 300, np.uint64))
    low, high = dict(c.blocks())[0], dict(c.blocks())[c.HIGH]
    assert [low[k] + 256 * high[k] for k in (7, 8, 9)] == [65535, 0, 300]


def test_tables_of_the_way_are_deleted(spark, corpus):
    from caselode.storage import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    out = jaccard.near_duplicates(corpus[0])
    left = {x.split("-")[1] for x in set(os.listdir(folder)) - before}
    assert left <= {"profile", "components", "linked", "smallest", "hot"} and out.count() == len(corpus[1])


def test_keep_one(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(4, long), (2, long + " more"), (9, "alone and other words here"), (9, "alone and other words here"), (None, long), (7, None), (8, "")]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id for r in kept), key=str) == [2, 7, 8, 9]


def test_keep_one_decides_by_row(spark):
    """Rows without an id, or with a tied one, stand each for their own text."""
    base = [" ".join(f"{k}{i}" for i in range(50)) for k in "abcdefgh"]
    rows = [(None, base[0]), (None, base[1]), (None, base[2]), (5, base[2] + " more"), (7, base[3]), (7, base[4]), (3, base[4] + " more"), (7, base[5]), (7, base[5]), (None, base[6]), (None, base[6]), (1, ""), (1, None), (None, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.lit(1)).repartition(3)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    want = [(None, base[0]), (None, base[1]), (5, base[2] + " more"), (7, base[3]), (3, base[4] + " more"), (7, base[5]), (None, base[6]), (1, ""), (1, None), (None, " ")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_shingle_sets_follow_the_word_rule():
    for a, b, same in (("A b C d E", "a\tb\nc\x0bd\x0ce", True), ("a b c d e", "a b c d e", False), ("É b c d e", "é b c d e", False), ("ab c d e f", "a bc d e f", False)):
        assert (jaccard.shingle_set(a).tolist() == jaccard.shingle_set(b).tolist()) is same


def test_graph_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (102, 101), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {100: 100, 101: 100, 102: 100}


# -- 7 ------------------------------------------------------------------------


def test_shards_are_exact(spark, empty):
    df = spark.range(1003).select((F.col("id") % 900).alias("doc_id"), F.lit("x").alias("shard"))
    rows = shards.shard(df, shards=7, cell_rows=50).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i % 900 for i in range(1003))
    sizes = Counter(r.shard for r in rows)
    assert sorted(sizes) == list(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(7):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    again = shards.shard(df, shards=7, cell_rows=50).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    few = shards.shard(df, shards=7, cell_rows=50, max_parts=2).collect()
    assert Counter(r.shard for r in few) == sizes
    assert shards.shard(empty).count() == 0


def test_shards_follow_the_matrix(spark):
    """Each partition gives each shard as many rows as the matrix says, in an order unlike the input's."""
    df = spark.range(400).select(F.col("id"), F.spark_partition_id().alias("part"))
    rows = shards.shard(df, shards=4, cell_rows=1000).collect()
    matrix = shards.communication_matrix([100] * 4, [100] * 4, shards.SEED)
    assert [[sum(r.part == p and r.shard == s for r in rows) for s in range(4)] for p in range(4)] == matrix
    order = [r.id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    runs = sum(a < b for a, b in zip(order, order[1:]))
    assert 150 < runs < 250  # about half of a random order's steps go up


def test_shard_query(spark, corpus, tmp_path):
    """Size, crc32 and law of every row against brute force; null, empty and repeated rows among them."""
    df, texts = corpus
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = shards.op7_shard_hypergeometric(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((k, len(t.encode()) + 16, zlib.crc32(t.encode())) for k, t in texts.items())
    sizes = Counter(r.shard for r in got)
    assert max(sizes[s] for s in range(40)) - min(sizes[s] for s in range(40)) <= 1
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    assert sorted((r.shard, r.slot) for r in got) == sorted((s, k) for s in sizes for k in range(sizes[s]))


def test_shards_keep_every_row_when_files_are_split_anew(spark, tmp_path):
    """Other splits, or fewer partitions, between the call and the action change nothing."""
    path = f"{tmp_path}/rows"
    spark.range(20_000).select(F.col("id"), F.md5(F.col("id").cast("string")).alias("t")).coalesce(2).write.option("parquet.block.size", 40_000).parquet(path)
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes"]
    try:
        for name, value in zip(names, ("20k", "30", "1k"), strict=True):
            spark.conf.set(name, value)
        out = shards.shard(spark.read.parquet(path), shards=7, cell_rows=900)
        for name, value in zip(names, ("1g", "1", "4m"), strict=True):
            spark.conf.set(name, value)
        rows = out.select("id", "shard", "slot").collect()
    finally:
        for name in names:
            spark.conf.unset(name)
    assert sorted(r.id for r in rows) == list(range(20_000))
    sizes = Counter(r.shard for r in rows)
    assert sorted(sizes.values()) == [2857] * 6 + [2858]
    assert sorted((r.shard, r.slot) for r in rows) == sorted((s, k) for s in sizes for k in range(sizes[s]))


def test_deals_are_uniform(spark):
    """Over many seeds each row comes to each shard alike, and two rows meet as often as chance has it."""
    df = spark.range(12).coalesce(3).select("id")
    seen, together = Counter(), 0
    for seed in range(60):
        rows = {r.id: r.shard for r in shards.shard(df, shards=3, seed=seed).collect()}
        seen.update(rows.items())
        together += rows[0] == rows[1]
    assert sum((seen[i, s] - 20) ** 2 / 20 for i in range(12) for s in range(3)) < 70  # chi square, 24 degrees
    assert abs(together / 60 - 3 / 11) < 0.2


def test_matrix_sums_and_law():
    m = shards.communication_matrix([30, 0, 50, 20], [25, 25, 50], 3)
    assert [sum(r) for r in m] == [30, 0, 50, 20] and [sum(c) for c in zip(*m)] == [25, 25, 50]
    rng = random.Random(1)
    draws = Counter(shards._hypergeometric(rng, 3, 5, 4) for _ in range(8000))
    from math import comb

    for k in range(4):
        assert abs(draws[k] / 8000 - comb(3, k) * comb(5, 4 - k) / comb(8, 4)) < 0.03


# -- 8 ------------------------------------------------------------------------

LANGS = {"en": "the of and to in that was for with this from have which", "de": "der die und nicht ein eine mit sich auch für wird wurde über", "fr": "le les des une est pour dans qui avec sur pas été où"}


def test_language_id(spark, empty):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(LANGS[lang].split()) for _ in range(rng.choice([8, 40]))), lang) for i, lang in enumerate(["en", "de", "fr"] * 80)]
    rows += [(900, None, "en"), (901, "123 !!!", "en"), (902, "", None), (None, "the of and", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(3))
    out = {r.doc_id: r for r in langid.predict(df, langid.train(df)).collect()}
    assert all(out[k].lang_pred == "und" and out[k].score == 0 and out[k].rejected for k in (900, 901, 902))
    test = [(k, lang) for k, _, lang in rows if k is not None and k < 900 and zlib.crc32(str(k).encode()) % 3 == 1]
    assert sum(out[k].lang_pred == lang for k, lang in test) >= 0.98 * len(test)
    assert sum(out[k].rejected for k, _ in test) <= 0.02 * len(test) and all(0 <= r.score <= 1 for r in out.values())
    none = langid.predict(df, langid.train(empty))
    assert {r.lang_pred for r in none.collect()} == {"und"} and langid.predict(empty.select("doc_id", "text"), langid.train(df)).count() == 0


def brute_features(t):
    data = b" " + b" ".join("".join(c if ord(c) >= 128 or c.isalpha() else " " for c in t.lower()).encode().split()) + b" "
    out = Counter()
    for n in (2, 3, 4):
        for i in range(len(data) - n + 1):
            key = (int.from_bytes(data[i : i + n], "big") * 2654435761 + n * 0x9E3779B1) & 0xFFFFFFFF
            out[key >> (32 - langid.DIM_BITS)] += 1
    return out


def test_nearest_centroid_by_brute_force(spark, monkeypatch):
    """One centroid a language is the mean direction of its sample; a prediction is the largest cosine."""
    monkeypatch.setattr(langid, "CLUSTERS", 1)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(LANGS[lang].split()) for _ in range(12)), lang) for i, lang in enumerate(["en", "de", "fr"] * 20)] + [(99, "12 . \n", "en")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    sample = [(lang, brute_features(t)) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 3 != 1 and any(c.isalpha() for c in t)]
    seen = Counter(k for _, f in sample for k in f)
    idf = lambda k: math.log((1 + len(sample)) / (1 + seen[k])) + 1

    def unit(f):
        v = {k: math.log1p(n) * idf(k) for k, n in f.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {k: x / norm for k, x in v.items()}

    centroids = {}
    for lang in LANGS:
        total = Counter()
        for own, f in sample:
            if own == lang:
                total.update(unit(f))
        norm = math.sqrt(sum(x * x for x in total.values()))
        centroids[lang] = {k: x / norm for k, x in total.items()}
    assert model.langs == sorted(LANGS)
    texts = [t for _, t, _ in rows[:-1]] + ["the der les", "zzz qqq", "été über have"]
    for t, (lang, score, rejected) in zip(texts, model.predict(texts), strict=True):
        v = unit(brute_features(t))
        cosines = {k: sum(x * c.get(i, 0) for i, x in v.items()) for k, c in centroids.items()}
        best = max(sorted(cosines), key=cosines.get)
        assert abs(score - cosines[best]) < 1e-4 and (lang == best or abs(cosines[lang] - cosines[best]) < 1e-4)
        assert rejected == (score < model.lowest[model.langs.index(lang)])


def test_languages_of_any_type(spark):
    df = spark.createDataFrame([(i, "the of and" if i % 2 else "der die und", i % 2) for i in range(60)], "doc_id long, text string, lang int")
    out = langid.predict(df, langid.train(df)).collect()
    assert all(r.lang_pred == str(r.doc_id % 2) for r in out)


# -- 9 ------------------------------------------------------------------------


def test_mix(spark, corpus, empty):
    df, texts = corpus
    df = df.withColumn("copy", F.lit("clash")).withColumn("g", F.lit(1))
    targets = {"src0": 3.0, "src1": 1.0, "other": 1.0}
    means = {r.g: (r.bytes, r.mean) for r in mix.rates(df, targets).collect()}
    total = sum(len(t.encode()) for t in texts.values())
    whole = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    assert sum(b for b, _ in means.values()) == total
    out = mix.mix(df, targets).collect()
    per = Counter(r.doc_id for r in out)
    for k, i in ((k, i) for i, k in enumerate(sorted(texts))):
        mean = means[{0: "src0", 1: "src1"}.get(i % 4, "other")][1]
        source, digest = f"src{i % 4}", hashlib.md5(texts[k].encode()).hexdigest() if whole[k] is not None else ""
        u = int(hashlib.md5(f"{mix.SEED}:{k}:{source}:{digest}:1".encode()).hexdigest()[:13], 16) / 2**52
        n, p = 0, np.exp(-mean)
        c = p
        while c <= u:
            n += 1
            p *= mean / n
            c += p
        assert per[k] == n
    assert all(r.copy <= r.n_copies for r in out) and mix.mix(empty, targets).count() == 0


def test_mix_means(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("word").alias("text"), F.when(F.col("id") % 4 == 0, "src0").alias("source"))
    n = mix.mix(df, {"src0": 0.5, "other": 0.5}).groupBy("source").count().collect()
    assert all(abs(r["count"] - 2000) < 200 for r in n)


def test_mix_counts_are_exact_quantiles(spark):
    """Counts of means from 0 to 5000 against the exact distribution, draw by draw; the SQL gives the same rows."""
    weights = {"zero": 0.0, "few": 0.3, "fifty": 50.0, "edge": 745.0, "more": 800.0, "many": 5000.0}
    rows = [(i, "x", s) for i, s in enumerate([*weights] * 40)]
    n = sum(weights.values())
    # every source has 40 bytes; one unnamed text makes the corpus n bytes for each byte of them
    df = spark.createDataFrame([*rows, (None, "y" * (40 * int(10 * n) - 240), None)], "doc_id long, text string, source string")
    total = 40 * int(10 * n)
    targets = {**{k: 40 * w / total for k, w in weights.items()}, "other": 1 - 40 * n / total}
    means = {r.g: r.mean for r in mix.rates(df, targets).collect()}
    assert all(abs(means[k] - w) < 1e-6 * max(1, w) for k, w in weights.items())
    got = Counter(r.doc_id for r in mix.mix(df, targets, shuffle=False).where("doc_id is not null").select("doc_id").collect())
    number = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:13], 16) / 2**52
    for i, _, source in rows:
        draws = max(1, -(-int(np.ceil(means[source])) // mix.DRAW))
        part, want = means[source] / draws, 0
        for k in range(1, draws + 1):
            row = f"{i}:{source}:{hashlib.md5(b'x').hexdigest()}:1"
            u = number(f"{mix.SEED}:{row}" if k == 1 else f"{mix.SEED}:draw:{k}:{row}")
            c, j = 0.0, 0
            while (c := c + math.exp(-part + (j * math.log(part) if j else 0) - math.lgamma(j + 1)) if part else 1.0) <= u:
                j += 1
            want += j
        assert abs(got[i] - want) <= (1 if part > 100 else 0)  # terms differ in their last bits


def test_mix_is_its_sql(spark, tmp_path):
    """Also where a mean takes several draws, ids are null or repeated and texts null."""
    rows = [(0, "x", "src0"), (1, "x", "src0"), (1, "x", "src0"), (None, "x", "src1"), (5, None, "src1"), (3, "y" * 30_000, "src9"), (4, "z" * 9000, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = mix.op9_mix_poisson(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(mix.mix_sql())
    names = [d[0] for d in want.description]
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in got.collect())
    assert got.groupBy("source").count().where("source = 'src0' and count > 900").count() == 1


def test_mix_draws_null_and_equal_rows_apart(spark):
    """A third of the ids null, and a third of the rows equal in all: means are kept, and keys spread."""
    rows = [(None if i % 3 == 0 else i, f"t{i % 7} {i}" if i % 3 else "same", f"src{i % 2}", i) for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, number int").repartition(5)
    targets = {"src0": 0.5, "src1": 1.0, "other": 1.0}
    means = {r.g: r.mean for r in mix.rates(df, targets).collect()}
    out = mix.mix(df, targets).withColumn("part", F.spark_partition_id()).collect()
    for source in ("src0", "src1"):
        for null in (True, False):
            own = sum(s == source and (i is None) == null for i, _, s, _ in rows)
            got = sum(r.source == source and (r.doc_id is None) == null for r in out)
            assert abs(got / own - means[source]) < 0.08 * means[source]
    same = Counter(r.number for r in out if r.doc_id is None and r.copy == 1)
    assert max(same.values()) == 1 and len({r.shuffle_key for r in out}) > 0.999 * len(out)
    assert max(Counter(r.part for r in out).values()) < 2 * len(out) / 4
    with pytest.raises(ValueError, match="other"):
        mix.mix(df, {"src0": 1.0})


def test_mix_is_in_order_over_partitions(spark, corpus):
    out = mix.mix(corpus[0], {"src0": 1.0, "other": 2.0}).select("shuffle_key", F.spark_partition_id().alias("p")).collect()
    keys = [r.shuffle_key for r in sorted(out, key=lambda r: r.p)]
    assert keys == sorted(keys) and len({r.p for r in out}) == 4


def test_mix_of_a_computed_table(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"), F.when(F.col("id") % 3 == 0, "src0").alias("source"))
    assert {mix.mix(df).count() for _ in range(2)} == {mix.mix(df, shuffle=False).count()}


def test_mix_large_means(spark):
    """A small source beside a large one: means above what exp(-mean) can start from."""
    df = spark.createDataFrame([*((i, "x", "src0") for i in range(300)), (300, "y" * 899_700, None)], "doc_id long, text string, source string")
    got = {r.g: r.mean for r in mix.rates(df, {"src0": 0.5, "other": 0.5}).collect()}
    assert got["src0"] == 1500
    rows = mix.mix(df, {"src0": 0.5, "other": 0.5}, shuffle=False).where("source = 'src0'")
    n = np.array([r["count"] for r in rows.groupBy("doc_id").count().collect()])
    assert len(n) == 300 and abs(n.mean() - 1500) < 12 and 900 < n.var() < 2200


# -- 10 -----------------------------------------------------------------------


def brute_quality(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = set()
    for i in range(len(w) - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            inside |= set(range(i, i + 8))
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(inside), len(w) < 20 or 100 * len(inside) > 30 * len(w)


CLEAN = {
    "ko": "오늘 아침 시장에는 많은 사람들이 모여 채소와 과일을 사고 있었다 날씨는 맑았고 바람은 부드럽게 불었으며 아이들은 광장에서 즐겁게 뛰어놀았다 우리는 작은 가게에 들러 따뜻한 차를 마시고 집으로 돌아왔다",
    "it": "Ieri mattina siamo andati al mercato vicino alla piazza dove molte persone compravano frutta fresca mentre i bambini giocavano felici sotto gli alberi e noi bevevamo caffè prima di tornare a casa",
    "ja": "けさ 市場 には 大勢 の 人 が 集まり 野菜 や 果物 を 買って いた 空 は 晴れて 風 は 静か で 子供 たち は 広場 で 遊んで いた",
    None: "Gisteren liepen wij langs de gracht waar oude huizen staan terwijl kinderen speelden onder hoge bomen vlak bij onze kleine school buiten de drukke stad",
}


def test_clean_texts_of_other_languages_stay(spark):
    """Only a text of a language with a list is judged by its function words."""
    rows = [(lang, text) for lang, text in CLEAN.items()] + [("en", " ".join(f"gibber{k}" for k in range(40)))]
    got = quality.quality_rules(spark.createDataFrame(rows, "lang string, text string")).collect()
    assert [(r.kept, r.failed) for r in got] == [(True, [])] * len(CLEAN) + [(False, ["stop_words"])]
    plain = quality.quality_rules(spark.createDataFrame(rows, "lang string, text string").drop("lang"), lang=None)
    assert plain.where("kept").count() == len(rows)


def test_quality(spark, corpus, empty):
    df, texts = corpus
    more = {9001: "a b c d e f g h i j " * 9, 9002: "line x\nline x\n\n \nline x", 9003: "# * $ % & | < > " * 5, 9004: "the of and " * 3 + words(random.Random(1), 60)}
    extra = spark.createDataFrame([(k, t, None, None, 0) for k, t in more.items()], KIND)
    df = df.unionByName(extra).withColumn("kept", F.lit("clash"))
    got = {r.doc_id: r for r in quality.quality_rules(df).collect()}
    for k, t in (texts | more).items():
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(t)
        assert not (r.base_failed and r.kept)
    assert got[9004].kept and "symbol_ratio" in got[9003].failed
    assert df.where(quality.verdict(F.col("text"), F.col("lang"))["kept"]).count() == sum(r.kept for r in got.values())
    assert quality.quality_rules(empty).count() == 0
