r"""N-gram Jaccard join: which texts share most of their word shingles.

A text's set is its distinct 5-word shingles, as 64-bit hashes. Texts with equal
sets are one class. Two classes link when 100 * intersection >= 80 * union; the
result is the connected components of all links.

The join is size-aware, heavy and light. In one global order of shingles
(rarest first) the prefixes of two linked sets must share elements: with o the
least overlap a linked partner can have, the first |x| - o + c shingles of both
share c of them. Light (small) sets enumerate the fixed-size subsets, pairs
(c = 2), of their prefixes and meet where a subset is equal. Heavy (large) sets
post their prefix shingles (c = 1) to inverted lists, which they scan; light
sets near the boundary post there too, as partners of heavy ones only. The
boundary is the size that costs least, from the counts of sets by size and the
length of lists. A pair meets on a list only if what both sets hold from
that place in the order on can still make the overlap that they need.

The order comes from a table of shingle counts over all documents, of fixed
size (SKETCH_BITS), on a logarithmic scale that ranks counts up to 2^31: it
decides which shingles are looked at first, never what links. Every candidate
is checked on the whole sets. Classes are named by 64 bits of a hash of the
set; other 64 bits tell unlike sets of one name apart, and those sets then go
by the other bits.

Groups of near copies are not expanded into pairs. First each list links its
members to its most typical one (a star); the links that hold are merged into
components. Then each list gives the pairs of members that are still in
different components, all of them, and those are checked too; so no link
between components is lost and none inside is looked for twice. Stars with many
members are checked in salted shares, and lists with many members are dealt in
blocks: every pair of blocks is a task's group of its own. Nothing is capped.

Defined cases: null and empty texts and texts of blanks have an empty set and
link with nothing; fewer than 5 words make one shingle of the whole sequence;
repeated rows and ids are rows of one class if their texts' sets are equal; ids
are whole numbers or null, and a null id takes part (and is no smallest id
unless a component has no other); other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import discard, if_small, materialize, table, unused
from .graph import components

SHINGLE = 5
NUM, DEN = 80, 100
#: log2 of the number of counters in the table that orders shingles.
SKETCH_BITS = 24
#: Bytes of text hashed at once, and bits of a set's parity map.
CHUNK_BYTES, PARITY = 1 << 19, 1024
_BLOCK_BITS = 16
#: Largest size of set considered light, members of a star in one share, and of a list in one block.
MAX_LIGHT, SHARE, BLOCK = 64, 2000, 4096
#: Rows of a class that go to one task, at least, where its members are joined with it.
HOT = 500
#: Bits of the name that a class goes by.
NAME_BITS = 64
#: Steps of the scale of counts for each doubling.
SCALE = 8
#: Rows of a batch sent on.
FLUSH = 1 << 18

_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: A row's kind, below POS its flags, above its place in the order.
SUBSET, LIST, LIGHT, POS = 0, 1, 2, 4


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A 64-bit number for each byte, the same for a letter's two cases.
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _MULT[1])
_BYTE[0x41:0x5B] = _BYTE[0x61:0x7B]
_BASE = 0x9FB21C651E98DF25
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    """1, b, b^2 ... modulo 2^64, of the base or its inverse."""
    if len(_powers.get(kind, ())) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        out = np.full(max(n, CHUNK_BYTES), base, np.uint64)
        out[0] = 1
        _powers[kind] = np.cumprod(out)
    return _powers[kind][:n]


def _sets(data: np.ndarray, edges: np.ndarray) -> list[np.ndarray]:
    """Shingle sets of the texts data[edges[i] : edges[i + 1]].

    A word's hash is the difference of two prefix sums of its bytes' numbers
    times powers of a base, shifted to the word's start, then mixed.
    """
    n = len(data)
    if n == 0:
        return [np.zeros(0, np.uint64)] * (len(edges) - 1)
    inside = ~_SPACE[data]
    joined = inside.copy()
    joined[1:] &= inside[:-1]
    joined[0] = False
    joined[edges[:-1][edges[:-1] < n]] = False  # a text's first byte continues no word
    starts = np.flatnonzero(inside & ~joined)
    goes_on = np.zeros(n, bool)
    goes_on[:-1] = joined[1:]
    ends = np.flatnonzero(inside & ~goes_on)
    value = _BYTE[data] * _power("up", n)
    total = np.cumsum(value)
    words = _mix((total[ends] - total[starts] + value[starts]) * _power("down", n)[starts] + (ends - starts).astype(np.uint64))
    k = max(0, len(words) - SHINGLE + 1)
    grams = words[:k] * _MULT[0]
    for i in range(1, SHINGLE):
        grams += words[i : i + k] * _MULT[i]
    grams = _mix(grams)
    at, out = np.searchsorted(starts, edges), []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if hi - lo >= SHINGLE:
            own = np.sort(grams[lo : hi - SHINGLE + 1])
            out.append(own[np.r_[True, own[1:] != own[:-1]]])
        elif hi > lo:
            own = words[lo:hi]
            out.append(_mix(np.array([np.add.reduce(own * _MULT[: len(own)]) + np.uint64(len(own))], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: pa.Array):
    """Sorted distinct shingle hashes of each text; A-Z as a-z, words [^\\x20\\x09-\\x0D]+; null as empty."""
    texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    edges = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + CHUNK_BYTES, side="right")) - 1)
        yield from _sets(data[edges[lo] : edges[hi]], edges[lo : hi + 1] - edges[lo])
        lo = hi


def shingle_set(text: str) -> np.ndarray:
    return next(shingle_sets(pa.array([text], pa.string())))


def class_names(s: np.ndarray, bits: int = NAME_BITS) -> tuple[int, int]:
    """Two independent names of a set: one of so many bits, and one of 64."""
    import xxhash

    h = xxhash.xxh3_128_intdigest(s.tobytes())
    return tuple(int(x) for x in np.array([h & ((1 << bits) - 1), h >> 64], np.uint64).view(np.int64))


@dataclass(frozen=True)
class Names:
    """How classes are named: by the first name, or by the other one if unlike sets share the first."""

    bits: int = NAME_BITS
    shared: frozenset = frozenset()

    def of(self, s: np.ndarray) -> int:
        name, other = class_names(s, self.bits)
        return other if name in self.shared else name


def parity(s: np.ndarray) -> np.ndarray:
    """Bit k says whether an odd number of elements fall on k; as many bits as elements, a power of 2, or PARITY.

    An element in one of two sets only flips one bit, so the maps differ in no
    more bits than the sets in elements: a lower bound that is cheap to have.
    """
    bits = max(PARITY, 1 << (max(1, len(s)) - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def least_overlap(n: int) -> int:
    """Least size of the intersection of a set of n with a linked one."""
    return -(-n * NUM // DEN)


# -- tables of counters: fixed size, built on the executors ------------------


class _Counters:
    """Counts by slot of a task, up to 65535, given out in blocks of 2^16 counters, a byte of each.

    Block b holds the low bytes; b with HIGH added, where there are any, the high ones.
    """

    HIGH = 1 << 20

    def __init__(self, bits: int):
        self.bits, self.n, self.held, self.size = bits, np.zeros(1 << bits, np.uint16), [], 0

    def add(self, keys: np.ndarray) -> None:
        self.held.append((keys >> np.uint64(64 - self.bits)).astype(np.uint32))
        self.size += len(keys)
        if self.size >= 1 << 20:
            self.flush()

    def flush(self) -> None:
        if self.size:
            slots = np.sort(np.concatenate(self.held))
            at = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]])
            more, slots = np.diff(np.r_[at, len(slots)]), slots[at]
            self.n[slots] = np.minimum(65535, self.n[slots] + more)
        self.held, self.size = [], 0

    def blocks(self):
        self.flush()
        width = 1 << min(_BLOCK_BITS, self.bits)
        for b in range(len(self.n) // width):
            part = self.n[b * width : (b + 1) * width]
            if part.any():
                yield b, (part & 255).astype(np.uint8).tobytes()
                if (part > 255).any():
                    yield b + self.HIGH, (part >> 8).astype(np.uint8).tobytes()


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts on a scale of 256 steps, SCALE for each doubling of 1 + count."""
    return np.minimum(255, np.rint(SCALE * np.log2(1.0 + counts))).astype(np.uint8)


def summed(blocks: DataFrame, bits: int) -> np.ndarray:
    """One table from the tasks' blocks (block, counts): added up by block, then 2^bits counters come here.

    A byte each, on a logarithmic scale (see `scaled`).
    """
    width = 1 << min(_BLOCK_BITS, bits)

    def give(block: int, total: np.ndarray) -> pa.RecordBatch:
        data = scaled(total).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([data], pa.binary())], names=["block", "counts"])

    def run(batches):
        now, total = None, np.zeros(width, np.uint64)
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                high, b = divmod(b, _Counters.HIGH)
                if b != now:
                    if now is not None:
                        yield give(now, total)
                    now, total = b, np.zeros(width, np.uint64)
                total += np.frombuffer(blob.as_buffer(), np.uint8).astype(np.uint64) << np.uint64(8 * high)
        if now is not None:
            yield give(now, total)

    out = np.zeros(1 << bits, np.uint8)
    own = F.pmod("block", F.lit(_Counters.HIGH))
    for r in blocks.repartition(own).sortWithinPartitions(own).mapInArrow(run, "block int, counts binary").collect():
        out[r["block"] * width : (r["block"] + 1) * width] = np.frombuffer(r["counts"], np.uint8)
    return out


def _rows(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text"))


def profile(rows: DataFrame, bits: int = NAME_BITS) -> DataFrame:
    """Per document its class, the class' other name and set size; per task the blocks of its shingle counts.

    Numbers after the text are passed on.
    """
    own = [c for c in rows.columns if c != "text"]
    at = [rows.columns.index(c) for c in own]
    names = [*own, "node", "other", "n", "parity", "block", "counts"]

    def run(batches):
        counters = _Counters(SKETCH_BITS)
        for batch in batches:
            sets = list(shingle_sets(batch.column(1)))
            for s in sets:
                counters.add(s)
            k = len(sets)
            node, other = zip(*(class_names(s, bits) for s in sets), strict=True) if sets else ([], [])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in at), pa.array(node, pa.int64()), pa.array(other, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([parity(s) for s in sets], pa.list_(pa.int64())), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())],
                names=names,
            )
        for b, blob in counters.blocks():
            yield pa.RecordBatch.from_arrays(
                [*(pa.nulls(1, pa.int64()) for _ in at), *(pa.nulls(1, pa.int64()) for _ in range(3)), pa.nulls(1, pa.list_(pa.int64())), pa.array([b], pa.int32()), pa.array([blob], pa.binary())],
                names=names,
            )

    return materialize(rows.mapInArrow(run, ", ".join(f"{c} bigint" for c in own) + ", node bigint, other bigint, n bigint, parity array<bigint>, block int, counts binary"), "profile")


# -- signatures ---------------------------------------------------------------


def boundary(sizes: dict[int, int], sketch: np.ndarray) -> int:
    """Size up to which sets are light: the one of least total cost.

    A light set of prefix p + 1 costs its subsets, p (p + 1) / 2 rows; a set
    in the lists p rows and, for each, the partners on a list. The length of
    lists is that of the rarest fifth of shingles, as only those are posted,
    in units of the counters' mean load.
    """
    value = np.exp2(np.arange(256) / SCALE) - 1
    slots = np.zeros(256, np.int64)  # counters by count, a part at a time: the driver holds no wide copy
    for part in np.array_split(sketch, max(1, len(sketch) >> 20)):
        slots += np.bincount(part, minlength=256)
    weight, longer = np.cumsum(slots * value), 1.0
    if weight[-1]:
        longer = float(value[np.searchsorted(weight, 0.2 * weight[-1])] * slots[1:].sum() / weight[-1])
    prefix = lambda n: n - least_overlap(n) + 1
    best, cost = 0, None
    for b in range(MAX_LIGHT + 1):
        light = sum(c * prefix(n) * (prefix(n) + 1) / 2 for n, c in sizes.items() if 2 <= n <= b)
        lists = sum(c * prefix(n) * (1 + longer) for n, c in sizes.items() if n > (b * NUM) / DEN or n < 2)
        if cost is None or light + lists < cost:
            best, cost = b, light + lists
    return best


def _signatures(s: np.ndarray, sketch: np.ndarray, light: int):
    """(signatures, kinds, weight) of a set."""
    n = len(s)
    counts = sketch[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
    key = (counts << np.uint64(40)) | (s >> np.uint64(24))
    order = np.argsort(key, kind="stable")
    p = n - least_overlap(n) + 1
    weight = int(2 * counts[order[:p]].mean())
    sigs, kinds = [], []
    if 2 <= n <= light:
        first = s[order[: p + 1]]
        i, j = np.triu_indices(len(first), 1)
        sigs.append(_mix(_mix(first[i]) * _MULT[0] + first[j] * _MULT[1]))
        kinds.append(np.full(len(i), SUBSET, np.int32))
    if n > light or n * DEN > light * NUM or n < 2:
        first = s[order[:p]]
        sigs.append(first)
        kinds.append(np.arange(p, dtype=np.int32) * POS + LIST + (LIGHT if n <= light else 0))
    return np.concatenate(sigs), np.concatenate(kinds), weight


def signatures(rows: DataFrame, sketch, light: int, names: Names = Names()) -> DataFrame:
    """sig, node, n, weight, kind of every class; a task gives each class once."""

    def run(batches):
        table, seen = sketch.value, set()
        for batch in batches:
            held, size = [], 0
            for s in shingle_sets(batch.column(1)):
                if len(s) == 0 or (node := names.of(s)) in seen:
                    continue
                seen.add(node)
                sigs, kinds, weight = _signatures(s, table, light)
                held.append((sigs, node, len(s), weight, kinds))
                size += len(sigs)
                if size >= FLUSH:
                    yield _signature_batch(held)
                    held, size = [], 0
            if held:
                yield _signature_batch(held)

    return rows.mapInArrow(run, "sig bigint, node bigint, n int, weight int, kind int")


def _signature_batch(held) -> pa.RecordBatch:
    k = [len(h[0]) for h in held]
    spread = lambda i, t: pa.array(np.repeat(np.array([h[i] for h in held], t), k))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([h[0] for h in held]).view(np.int64)), spread(1, np.int64), spread(2, np.int32), spread(3, np.int32), pa.array(np.concatenate([h[4] for h in held]))],
        names=["sig", "node", "n", "weight", "kind"],
    )


def stars(entries: DataFrame) -> DataFrame:
    """Rows of lists with two classes or more: sig, node, n, kind and `center`, the list's most typical class.

    Rows stream in order of list and weight, so the first is the center and
    a list of any length needs no memory. A class that several tasks gave
    counts once.
    """

    def run(batches):
        last = None  # the row before, if it may still be alone in its list
        sig = center = seen = None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            again = np.zeros(len(cols[0]), bool)
            again[1:] = (cols[0][1:] == cols[0][:-1]) & (cols[1][1:] == cols[1][:-1])
            again[:1] = len(again) > 0 and seen == (cols[0][0], cols[1][0])
            if again.all():
                continue
            seen = (cols[0][-1], cols[1][-1])
            cols = [c[~again] for c in cols]
            cols = [np.concatenate([[a], b]) for a, b in zip(last, cols, strict=True)] if last is not None else cols
            s, node, n, kind = cols[0], cols[1], cols[2], cols[4]
            fresh = np.ones(len(s), bool)
            fresh[1:] = s[1:] != s[:-1]
            if last is None and sig is not None and s[0] == sig:
                fresh[0] = False
            group = np.cumsum(fresh) - 1
            # first row of each list here; group -1 goes on from the batch before
            starts = np.flatnonzero(fresh)
            c_node = np.where(group >= 0, node[starts[np.maximum(group, 0)]], center[0] if center else 0) if len(starts) else np.full(len(s), center[0])
            c_n = np.where(group >= 0, n[starts[np.maximum(group, 0)]], center[1] if center else 0) if len(starts) else np.full(len(s), center[1])
            same_next = np.zeros(len(s), bool)
            same_next[:-1] = s[1:] == s[:-1]
            keep = ~fresh | same_next
            hold = bool(fresh[-1])  # alone so far: wait for the next batch
            sig, center = s[-1], (int(c_node[-1]), int(c_n[-1]))
            last = [c[-1] for c in cols] if hold else None
            if hold:
                keep[-1] = False
            ok = keep & (node != c_node) & (np.minimum(n, c_n).astype(np.int64) * DEN >= np.maximum(n, c_n).astype(np.int64) * NUM)
            at = np.flatnonzero(keep)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s[at]), pa.array(node[at]), pa.array(n[at].astype(np.int32)), pa.array(kind[at].astype(np.int32)), pa.array(c_node[at], pa.int64(), mask=~ok[at])],
                    names=["sig", "node", "n", "kind", "center"],
                )

    dealt = entries.repartition("sig").sortWithinPartitions("sig", F.col("weight").desc(), "node")
    return dealt.mapInArrow(run, "sig bigint, node bigint, n int, kind int, center bigint")


def _pairs_of(comp, node, n, kind, block, across: bool):
    """All pairs of a list's members in different components that sizes and kinds allow; across: of unlike blocks only."""
    order = np.lexsort((node, n))
    comp, node, n, kind, block = comp[order], node[order], n[order], kind[order], block[order]
    place = kind // POS
    last = np.searchsorted(n.astype(np.int64) * NUM, n.astype(np.int64) * DEN, side="right")  # larger partners end here
    # a smaller set too deep in its order for the least partner, its own size, has none
    able = (n - place).astype(np.int64) * (NUM + DEN) >= 2 * NUM * n.astype(np.int64)
    for i in np.flatnonzero(able):
        j = np.arange(i + 1, last[i])
        ok = comp[j] != comp[i]
        if across:
            ok &= block[j] != block[i]
        if kind[i] != SUBSET:
            # what is left of both sets from here must hold the overlap that a link needs
            need = -(-(n[i] + n[j]).astype(np.int64) * NUM // (NUM + DEN))
            ok &= (n[i] - place[i] >= need) & (n[j] - place[j] >= need)
            ok &= ~(((kind[i] & LIGHT) > 0) & ((kind[j] & LIGHT) > 0))
        j = j[ok]
        if len(j):
            yield node[i], node[j]


def cross_pairs(lists: DataFrame, comps: DataFrame, block: int = BLOCK) -> DataFrame:
    """A table of a, b (with a < b) of lists (sig, node, n, kind) whose members lie in several components: see _pairs_of.

    A list's members are dealt by hash into blocks; each pair of blocks, and
    each block with itself, is a group of about 2 * BLOCK rows at most.
    """
    lists = lists.select("sig", "node", "n", "kind")
    known = _with_component(lists, "node", comps, "comp")
    mixed = known.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size")).where("low < high")
    mixed = materialize(mixed.select("sig", F.ceil(F.col("size") / block).cast("int").alias("blocks")), "mixed")
    live = _with_component(lists.join(if_small(mixed), "sig"), "node", comps, "comp")
    live = live.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = live.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("sig", F.least("block", "with").alias("left"), F.greatest("block", "with").alias("right"), "node", "n", "kind", "comp", "block")

    def run(batches):
        held = None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            if held is not None:
                cols = [np.concatenate([a, b]) for a, b in zip(held, cols, strict=True)]
            at = _fresh(cols)[-1]
            held = [c[at:] for c in cols]
            yield from _groups([c[:at] for c in cols])
        if held is not None:
            yield from _groups(held)

    def _fresh(cols) -> np.ndarray:
        """Where groups begin."""
        sig, left, right = cols[:3]
        return np.flatnonzero(np.r_[True, (sig[1:] != sig[:-1]) | (left[1:] != left[:-1]) | (right[1:] != right[:-1])])

    def _groups(cols):
        if len(cols[0]) == 0:
            return
        starts = _fresh(cols)
        ends = np.r_[starts[1:], len(cols[0])]
        one, two, size = [], [], 0
        for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
            left, right = cols[1][lo], cols[2][lo]
            node, n, kind, comp, block = (c[lo:hi] for c in cols[3:])
            for a, b in _pairs_of(comp, node, n, kind, block, left != right):
                one.append(np.minimum(a, b))
                two.append(np.maximum(a, b))
                size += len(b)
                if size >= FLUSH:
                    yield _pair_batch(one, two)
                    one, two, size = [], [], 0
        if one:
            yield _pair_batch(one, two)

    groups = ["sig", "left", "right"]
    out = materialize(dealt.repartition(*groups).sortWithinPartitions(*groups).mapInArrow(run, "a bigint, b bigint").distinct(), "cross")
    discard(mixed)
    return out


def _pair_batch(left, right) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


# -- checking candidates on whole sets -----------------------------------------


def _hash64(x: np.ndarray) -> np.ndarray:
    return _mix(x.astype(np.int64).view(np.uint64))


def checked(rows: DataFrame, pairs: DataFrame, names: Names = Names()) -> DataFrame:
    """The pairs (a, b) that link, as a written table. b's set goes, in shares, to where its partners' sets go.

    Sets are made again from the texts of the classes that occur in pairs; a
    table of counters of fixed size tells them from most others before the
    join does.
    """
    spark = rows.sparkSession
    share = F.ceil(F.count("*") / SHARE).cast("int").alias("shares")
    shares = pairs.groupBy("b").agg(share)
    members = pairs.join(shares, "b").select(F.col("a").alias("node"), F.col("b").alias("grp"), F.pmod(F.xxhash64("a"), F.col("shares")).cast("int").alias("salt"), F.lit(1).alias("role"))
    centers = shares.select(F.col("b").alias("node"), F.col("b").alias("grp"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("salt"), F.lit(0).alias("role"))
    wanted = materialize(members.unionByName(centers), "wanted")

    def slots(batches):
        counters = _Counters(SKETCH_BITS)
        for batch in batches:
            counters.add(_hash64(batch.column(0).to_numpy(zero_copy_only=False)))
        for b, blob in counters.blocks():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([blob], pa.binary())], names=["block", "counts"])

    # which counters aren't 0, a bit each
    known = spark.sparkContext.broadcast(np.packbits(summed(wanted.select("node").mapInArrow(slots, "block int, counts binary"), SKETCH_BITS)))

    def sets(batches):
        seen = set()
        for batch in batches:
            held, size = [], 0
            for s in shingle_sets(batch.column(1)):
                if len(s) == 0 or (node := names.of(s)) in seen:
                    continue
                slot = int(_hash64(np.array([node]))[0] >> np.uint64(64 - SKETCH_BITS))
                if known.value[slot >> 3] >> (7 - (slot & 7)) & 1:
                    seen.add(node)
                    held.append((node, s.tobytes()))
                    size += len(s)
                if size >= FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.binary())], names=["node", "items"])
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.binary())], names=["node", "items"])

    found = rows.mapInArrow(sets, "node bigint, items binary")
    sent = found.join(if_small(wanted), "node").select("grp", "salt", "role", "node", "items")

    def compare(batches):
        now, own, done = None, None, set()
        for batch in batches:
            left, right = [], []
            grp, salt, role, node = (batch.column(i).to_pylist() for i in range(4))
            for i, blob in enumerate(batch.column(4)):
                if (grp[i], salt[i]) != now:
                    now, own, done = (grp[i], salt[i]), np.frombuffer(blob.as_py(), np.uint64), set()
                if role[i] == 0 or node[i] in done:
                    continue
                done.add(node[i])
                other = np.frombuffer(blob.as_py(), np.uint64)
                at = np.searchsorted(own, other)
                both = int((own[np.minimum(at, len(own) - 1)] == other).sum())
                if DEN * both >= NUM * (len(own) + len(other) - both):
                    left.append(node[i])
                    right.append(grp[i])
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    dealt = sent.repartition("grp", "salt").sortWithinPartitions("grp", "salt", "role")
    out = materialize(dealt.mapInArrow(compare, "a bigint, b bigint"), "links")
    discard(wanted)
    known.unpersist()
    return out


def plausible(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """The pairs whose parity maps don't rule out a link.

    A link of overlap o >= t / (1 + t) * (n + m) leaves at most n + m - 2 o
    elements in one set only, and the maps differ in no more bits than that.
    """
    left = maps.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("parity").alias("ap"))
    right = maps.select(F.col("node").alias("b"), F.col("n").alias("bn"), F.col("parity").alias("bp"))
    n = pairs.count()
    both = if_small(left.join(if_small(pairs, n), "a"), n).join(right, "b")
    half = F.least(F.size("ap"), F.size("bp"))  # sizes that can link are so near that lengths differ twofold at most
    fold = lambda x: F.when(F.size(x) == half, F.col(x)).otherwise(F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda u, v: u.bitwiseXOR(v)))
    differ = F.aggregate(F.zip_with(fold("ap"), fold("bp"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    total = F.col("an") + F.col("bn")
    near = F.least("an", "bn") * DEN >= F.greatest("an", "bn") * NUM
    return both.where(F.when(near, differ * (NUM + DEN) <= total * (DEN - NUM)).otherwise(F.lit(False))).select("a", "b")


def _with_component(rows: DataFrame, node: str, comps: DataFrame, out: str) -> DataFrame:
    named = comps.select(F.col("node").alias(node), F.col("component").alias("_c"))
    return rows.join(if_small(named), node, "left").withColumn(out, F.coalesce("_c", node)).drop("_c")


def _shared_names(members: DataFrame) -> frozenset:
    """Names that unlike sets share: about rows^2 / 2^65 of them, none below billions of documents."""
    twice = members.groupBy("node").agg(F.min("other").alias("low"), F.max("other").alias("high")).where("low < high")
    return frozenset(r["node"] for r in twice.select("node").collect())


def _linked_classes(rows: DataFrame, trace=None, bits: int = NAME_BITS) -> tuple[DataFrame, DataFrame]:
    """Every row's class and set size, and the component of each class that links.

    Both read written tables; all other tables of the way here are deleted.
    """
    spark = rows.sparkSession

    def keep(df: DataFrame, name: str) -> DataFrame:
        df = materialize(df, name)
        if trace:
            trace(name, df)
        return df

    def checks(pairs: DataFrame) -> DataFrame:
        """The links among pairs of classes that the parity maps let through."""
        left = keep(plausible(pairs, maps), "pairs")
        found = checked(rows, left, names)
        if trace:
            trace("links", found)
        discard(pairs, left)
        return found

    known = profile(rows, bits)
    if trace:
        trace("profile", known)
    members = known.where("block is null").drop("block", "counts")
    names = Names(bits, _shared_names(members.where("n > 0")))
    if names.shared:
        members = members.withColumn("node", F.when(F.col("node").isin(list(names.shared)), F.col("other")).otherwise(F.col("node")))
    counts = summed(known.where("block is not null").select("block", "counts"), SKETCH_BITS)
    sizes = {r["n"]: r["count"] for r in members.where((F.col("n") > 0) & (F.col("n") <= 2 * MAX_LIGHT)).groupBy("n").count().collect()}
    light = boundary(sizes, counts)
    maps = keep(members.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("parity").alias("parity")), "maps")
    members = members.drop("other", "parity")
    order = spark.sparkContext.broadcast(counts)
    del counts
    lists = keep(stars(signatures(rows, order, light, names)), "lists")
    order.unpersist()

    # first each class and the center that it shares most lists with, then all centers still apart
    spokes = keep(lists.where("center is not null").groupBy("node", "center").count().select(F.col("node").alias("a"), F.col("center").alias("b"), "count"), "spokes")
    links = checks(keep(spokes.groupBy("a").agg(F.max(F.struct("count", "b")).alias("m")).select("a", F.col("m.b").alias("b")), "best"))
    tables, comps = [links], components(links)

    def more(pairs: DataFrame) -> None:
        """Take in the links among pairs of classes of unlike components."""
        nonlocal links, comps
        if pairs.isEmpty():
            discard(pairs)
            return
        tables.append(checks(pairs))
        links = links.unionByName(tables[-1])
        before, comps = comps, components(links)
        discard(before)

    apart = _with_component(_with_component(spokes.select("a", "b"), "a", comps, "ca"), "b", comps, "cb").where("ca <> cb")
    more(keep(apart.select("a", "b"), "apart"))
    # what is still apart: every pair of every list
    more(cross_pairs(lists, comps))
    discard(maps, lists, spokes, *tables)
    return members, comps


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", trace=None, bits: int = NAME_BITS) -> DataFrame:
    """doc_id, n_shingles, component_id of every document. trace(name, df) is told of each step; bits: see Names."""
    members, comps = _linked_classes(_rows(docs, id_col, text), trace, bits)

    def keep(df: DataFrame, name: str) -> DataFrame:
        df = materialize(df, name)
        if trace:
            trace(name, df)
        return df

    classes = members.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    linked = keep(comps.join(classes, "node"), "linked")  # classes without a link need no component
    smallest = keep(linked.groupBy("component").agg(F.min("least").alias("component_id")), "smallest")
    named = linked.join(if_small(smallest), "component").select("node", "component_id")
    by_class = classes.join(named, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id"))
    full = _with_class(members.where("n > 0"), by_class, classes).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(empty)


def _with_class(members: DataFrame, by_class: DataFrame, classes: DataFrame) -> DataFrame:
    """members with the columns of their class; the members of a hot class go to several tasks.

    A class is hot if it has more than HOT rows and an eighth of a partition's
    mean share: at most eight times as many classes as partitions.
    """
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bound = max(HOT, members.count() // (8 * parts))
    hot = materialize(classes.where(F.col("rows") > bound).select("node", F.ceil(F.col("rows") / bound).cast("int").alias("shares")), "hot")
    if hot.isEmpty():
        return members.join(by_class, "node")
    shares = F.coalesce("shares", F.lit(1))
    dealt = members.join(F.broadcast(hot), "node", "left").withColumn("share", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), shares).cast("int"))
    every = by_class.join(F.broadcast(hot), "node", "left").withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1)))
    return dealt.drop("shares").join(every.drop("shares"), ["node", "share"])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group: the one of the smallest id (null last).

    A row is known by its id and a 64-bit hash of its text, so rows that share
    an id, or have none, stand each for their own text. Rows of equal id and
    text are of one group; one of them stays. Texts with an empty set all stay.
    """
    ident, digest, lost_id, lost_key = unused(docs, "ident", "digest", "lost_id", "lost_key")
    members, comps = _linked_classes(_rows(docs, id_col, text).withColumn("key", F.xxhash64("text")))
    rows = materialize(_with_component(members.where("n > 0"), "node", comps, "grp").select("doc_id", "key", "grp"), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("k")
    first = rows.groupBy("grp").agg(F.count("*").alias("c"), first).where("c > 1")
    first = materialize(first.select("grp", F.col("k.doc_id").alias("keep_id"), F.col("k.key").alias("keep_key")), "first")
    own = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("key") == F.col("keep_key"))
    judged = rows.join(if_small(first), "grp").groupBy("doc_id", "key", own.alias("own")).count()
    judged = materialize(judged.select(F.col("doc_id").alias(lost_id), F.col("key").alias(lost_key), "own", "count"), "judged")
    same = F.col(ident).eqNullSafe(F.col(lost_id)) & (F.col(digest) == F.col(lost_key))
    lost, repeated = judged.where("not own"), judged.where("own and count > 1")
    keyed = docs.withColumn(ident, F.col(id_col).cast("bigint")).withColumn(digest, F.xxhash64(F.col(text)))
    kept = keyed.join(if_small(lost), same, "left_anti")
    if not repeated.isEmpty():
        again = kept.join(if_small(repeated), same, "left_semi").dropDuplicates([ident, digest])
        kept = kept.join(if_small(repeated), same, "left_anti").unionByName(again)
    return kept.select(*docs.columns)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def jaccard_sql() -> str:
    """The same by brute force over shared shingles, for small tables."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, chr(10))]
      ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], chr(10))) END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y USING (g) WHERE x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n u ON a = u.doc_id JOIN n v ON b = v.doc_id WHERE {DEN} * i >= {NUM} * (u.c + v.c - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.root = e.a)
SELECT r.doc_id, coalesce(any_value(c), 0)::BIGINT AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""
