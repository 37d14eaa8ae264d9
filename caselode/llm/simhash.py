r"""SimHash near duplicates: fingerprints that differ in at most two bits, by the generalised pigeonhole.

The 64 bits are put into groups, correlated ones together. Whatever thresholds
a fingerprint x gives to the groups, if the thresholds plus one add up to
three, then a fingerprint within two bits of x differs from it by no more than
the threshold in some group (a threshold of -1 leaves a group out). So each
fingerprint may choose its own: a dynamic program over the groups takes the
cheapest, by candidates that are estimated from counts of all fingerprints.
The number of groups is the one that makes all of them cheapest. A fingerprint
then probes the keys within its thresholds, and what it meets is verified.

A key at which probing would make more rows than PER_ROW for each row there,
or that holds more than HELD rows, is not probed. What meets at such keys is
linked by neighbourhoods: each of these fingerprints names the 65 values
within one bit of it, and whatever names the same value is linked in a star.
Two fingerprints within two bits name a common value, and those that do are
within two bits, so this is exact too; no value has more than 65 names.

Equal fingerprints are one class from the start, so copies cost nothing.
Statistics (joint counts of bits, counts of 8-bit blocks) are sums over all
distinct fingerprints, of fixed size; fingerprints themselves never come to
the driver.

Defined cases: a text without words, or none, has fingerprint zero and links
like any other; fewer than three words are one shingle; rows stand for
themselves, whatever their ids; a null id is never a component's smallest, and
a component of null ids alone has none; ids may be of any type with an order;
columns other than id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, if_small, materialize, table
from .graph import components

SHINGLE, SEED, BITS, WITHIN = 3, 42, 64, 2
#: Bytes of a text that are cut into words at a time, shingles whose bits are counted at a time.
PIECE, COUNTED = 1 << 20, 1 << 15
#: Numbers of groups to choose from, bits of a block.
GROUPS, BLOCK = (2, 3, 4), 8
#: What a probed key costs beside the candidates that it finds, in candidates.
PROBE = 2.0
#: Rows that probing a key may make for each row at it, and rows at a key at most.
PER_ROW, HELD = 64, 8192

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Bits in which two values of a block differ.
_DISTANCE = np.bitwise_count(np.bitwise_xor.outer(np.arange(1 << BLOCK), np.arange(1 << BLOCK)))


def word_lists(data: bytes, piece: int = PIECE):
    """The words of an UTF-8 text, some at a time; a word is never cut."""
    at = 0
    while at < len(data):
        cut = _SPACE.search(data, at + piece) if at + piece < len(data) else None
        to = cut.start() if cut else len(data)
        yield data[at:to].split()
        at = to


def fingerprint(data: bytes, piece: int = PIECE) -> int:
    """The fingerprint of an UTF-8 text, unsigned."""
    digest, ones, n, last = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64), 0, []

    def count(hashes: np.ndarray) -> None:
        for k in range(0, len(hashes), COUNTED):
            ones.__iadd__(_bits(hashes[k : k + COUNTED]).sum(0, dtype=np.int64))

    for words in word_lists(data.lower(), piece):  # of bytes: A-Z only
        words = last + words
        hashes = np.fromiter((digest(b" ".join(s), SEED) for s in zip(words, words[1:], words[2:])), np.uint64)
        count(hashes)
        n, last = n + len(hashes), words[-(SHINGLE - 1) :]
    if n == 0 and last:
        n = 1
        count(np.array([digest(b" ".join(last), SEED)], np.uint64))
    return int(_packed(2 * ones > n))


def _bits(values: np.ndarray) -> np.ndarray:
    """The bits of 64-bit values, lowest first: one row a value."""
    return np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, bitorder="little").view(np.uint64)[0]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed number, of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint")


def _summed(fps: DataFrame, count, size: int) -> np.ndarray:
    """The sum of count(bits), an array of `size` numbers, over all fingerprints; a row a task and number."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            total += count(_bits(batch.column(0).to_numpy(zero_copy_only=False)))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "x"])

    out = np.zeros(size)
    for r in fps.select("fp").mapInArrow(run, "at bigint, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[r["at"]] = r["x"]
    return out


def group_bits(joint: np.ndarray, n: float, groups: int) -> tuple[tuple[int, ...], ...]:
    """Groups of bits of nearly equal width: each grows by the bit most correlated with it.

    joint: how often two bits are both set, of n fingerprints.
    """
    share = np.diag(joint) / max(n, 1)
    spread = np.sqrt(share * (1 - share))
    scale = np.outer(spread, spread)
    alike = np.abs(np.divide(joint / max(n, 1) - np.outer(share, share), scale, out=np.zeros_like(scale), where=scale > 0))
    np.fill_diagonal(alike, 0)
    left, out = list(range(BITS)), []
    for k in range(groups):
        width = len(left) // (groups - k)
        own = [max(left, key=lambda b: alike[b, left].sum())]
        left.remove(own[0])
        while len(own) < width:
            own.append(max(left, key=lambda b: alike[b, own].sum()))
            left.remove(own[-1])
        out.append(tuple(own))
    return tuple(out)


class Plan:
    """Groups of bits, and after `learn` the counts that thresholds are chosen by."""

    def __init__(self, groups: tuple[tuple[int, ...], ...]):
        self.groups = groups
        self.blocks = [[g[k : k + BLOCK] for k in range(0, len(g), BLOCK)] for g in groups]
        self.size = sum(map(len, self.blocks)) << BLOCK
        #: Keys within 0, 1 and 2 bits of a group's key.
        self.probes = np.array([[1, 1 + w, 1 + w + w * (w - 1) // 2] for w in map(len, groups)])

    @staticmethod
    def _value(bits: np.ndarray, own: tuple[int, ...]) -> np.ndarray:
        return bits[:, own].astype(np.int64) @ (1 << np.arange(len(own), dtype=np.int64))

    def counts(self, bits: np.ndarray) -> np.ndarray:
        """How often each block has each value."""
        every = [b for group in self.blocks for b in group]
        return np.concatenate([np.bincount(self._value(bits, b), minlength=1 << BLOCK) for b in every])

    def learn(self, counts: np.ndarray, n: float) -> None:
        self.n = n
        shares = counts.reshape(-1, 1 << BLOCK) / max(n, 1)
        self.near = np.stack([shares @ (_DISTANCE == d) for d in range(WITHIN + 1)], axis=2)

    def expected(self, bits: np.ndarray) -> np.ndarray:
        """Fingerprints expected within 0, 1 and 2 bits in each group, blocks taken as independent."""
        out, at = np.empty((len(bits), len(self.groups), WITHIN + 1)), 0
        for g, blocks in enumerate(self.blocks):
            own = np.zeros((len(bits), WITHIN + 1))
            own[:, 0] = 1
            for b in blocks:
                more = self.near[at][self._value(bits, b)]
                own = np.stack([sum(own[:, e] * more[:, d - e] for e in range(d + 1)) for d in range(WITHIN + 1)], axis=1)
                at += 1
            out[:, g] = self.n * own.cumsum(axis=1)
        return out

    def thresholds(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each fingerprint's cheapest thresholds by group, and what they cost."""
        price = np.concatenate([np.zeros((len(bits), len(self.groups), 1)), self.expected(bits) + PROBE * self.probes], axis=2)
        spent = np.full((len(bits), WITHIN + 2), np.inf)  # by thresholds plus one, summed so far
        spent[:, 0] = 0
        took = []
        for g in range(len(self.groups)):
            ways = np.full((len(bits), WITHIN + 2, WITHIN + 2), np.inf)  # by sum and the group's own part
            for own in range(WITHIN + 2):
                ways[:, own:, own] = spent[:, : WITHIN + 2 - own] + price[:, g, own, None]
            took.append(ways.argmin(axis=2))
            spent = ways.min(axis=2)
        out, left = np.empty((len(bits), len(self.groups)), np.int64), np.full(len(bits), WITHIN + 1)
        for g in reversed(range(len(self.groups))):
            own = took[g][np.arange(len(bits)), left]
            out[:, g] = own - 1
            left = left - own
        return out, spent[:, WITHIN + 1]

    def keys(self, values: np.ndarray):
        """(key, value, held, probes) arrays: where fingerprints lie and where they look."""
        bits = _bits(values)
        chosen, _ = self.thresholds(bits)
        for g, own in enumerate(self.groups):
            key = self._value(bits, own) | g << 40
            yield key, values, np.ones(len(key), bool), chosen[:, g] >= 0
            one = [1 << i for i in range(len(own))]
            masks = {1: one, 2: [x | y for x in one for y in one if x < y]}
            for bound, flips in masks.items():
                far = chosen[:, g] >= bound
                if far.any():
                    there = (key[far][:, None] ^ np.array(flips)[None]).ravel()
                    none = np.zeros(len(there), bool)
                    yield there, np.repeat(values[far], len(flips)), none, ~none


def plan_of(fps: DataFrame, n: int) -> Plan:
    """The plan that makes probing cheapest for all of fps."""
    joint = _summed(fps, lambda bits: (bits.T.astype(float) @ bits).ravel(), BITS * BITS).reshape(BITS, BITS)
    plans = [Plan(group_bits(joint, n, k)) for k in GROUPS]
    edges = np.cumsum([0, *[p.size for p in plans]])
    counts = _summed(fps, lambda bits: np.concatenate([p.counts(bits) for p in plans]), edges[-1])
    for k, p in enumerate(plans):
        p.learn(counts[edges[k] : edges[k + 1]], n)
    costs = _summed(fps, lambda bits: np.array([p.thresholds(bits)[1].sum() for p in plans]), len(plans))
    return plans[int(costs.argmin())]


def links(fps: DataFrame, plan: Plan, per_row: int = PER_ROW, held: int = HELD) -> tuple[DataFrame, list[DataFrame]]:
    """Links a, b that connect all of the distinct fingerprints fps within two bits; and tables to delete once they are read."""

    def run(batches):
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for key, own, lies, looks in plan.keys(values):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own), pa.array(lies), pa.array(looks)], names=["key", "fp", "lies", "looks"])

    keys = materialize(fps.select("fp").mapInArrow(run, "key bigint, fp bigint, lies boolean, looks boolean"), "keys")
    lie, look = F.count_if("lies"), F.count_if("looks")
    costly = (lie * look > per_row * (lie + look)) | (lie + look > held)
    hot = materialize(keys.groupBy("key").agg(costly.alias("hot")).where("hot").select("key"), "hot-keys")
    n = hot.count()
    cold = keys.join(if_small(hot, n), "key", "left_anti") if n else keys
    x, y = cold.where("looks").select("key", F.col("fp").alias("a")), cold.where("lies").select("key", F.col("fp").alias("b"))
    out = x.join(y, "key").where(f"a > b and bit_count(a ^ b) <= {WITHIN}").select("a", "b").distinct()
    if n:
        around = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << k) - (1 << BITS if k == BITS - 1 else 0))) for k in range(BITS)])
        named = keys.join(if_small(hot, n), "key", "left_semi").select("fp").distinct().select("fp", F.explode(around).alias("value"))
        stars = named.groupBy("value").agg(F.collect_list("fp").alias("own")).where("size(own) > 1")  # 65 at most
        stars = stars.select(F.array_min("own").alias("b"), F.explode("own").alias("a")).where("a > b").select("a", "b").distinct()
        out = out.unionByName(stars)
    return out, [keys, hot]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", per_row: int = PER_ROW, held: int = HELD) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    rows = materialize(fingerprints(docs, id_col, text), "fingerprints")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    n = classes.count()
    found, used = links(classes, plan_of(classes, n), per_row, held)
    comps = components(found)
    discard(*used)
    linked = comps.select(F.col("node").alias("fp"), "component").join(classes, "fp")
    smallest = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialize(linked.select("fp", "component").join(smallest, "component").select("fp", "component_id"), "named")
    discard(comps)
    # a class without a link is its own component
    of_class = classes.join(named, "fp", "left").select("fp", F.when(named["fp"].isNotNull(), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    return rows.join(of_class, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
