"""Document fingerprints by I-Match with randomised lexicon subsets.

Terms are lower-cased words of letters and digits. A first pass counts, over
all documents, in how many of them each term occurs. The lexicon is the band of
terms whose document frequency lies between two shares of the corpus, that is,
of inverse document frequency within a range: neither so rare that an edit adds
them nor so common that they say nothing. Every lexicon term occurs in at least
LOW of the documents, so the lexicon has at most 1 / LOW times as many terms as
a document has distinct terms on average, however large the corpus and its
vocabulary: bounded, so it is a literal of the plan.

A fingerprint keeps a text's distinct terms that are in the lexicon, sorts
them, and hashes them once whole and once for each of several random subsets of
the lexicon. A text without a term of the band is hashed whole by all its distinct
terms, so that it is like only what has the same ones. A subset takes a term by bits of the term's hash. Subsets come in
FAMILIES, each a chain of ever smaller ones, every one a quarter of the one
before: whatever a text's length, some subsets hold few of its terms, and edits
elsewhere leave their hashes alone. The likeness of two fingerprints is the
share of equal hashes among those subsets that are empty in at most one of the
two.

Main path: built-in functions only. One shuffle moves the texts, to set each
next to its successor by id.

Defined cases: null and empty texts, and texts without any term, have the empty
fingerprint (likeness 1 to each other, 0 to any other); equal texts have equal
fingerprints; ids are whole numbers; documents with equal ids follow each other
in order of a hash of their text, then of the text; a null id comes first; a single document is its own successor;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import count_upto, let, table, unused

#: The band: document frequency as a share of the corpus, and two documents at least.
LOW, HIGH = 0.0005, 0.2
#: Hash buckets that the lexicon lies in, for looking terms up.
BUCKETS = 1 << 16
#: Chains of subsets; subsets of a chain; bits of a term's hash that must be 0 for each next subset.
FAMILIES, LEVELS, BITS = 24, 5, 2
#: Hash of no terms.
EMPTY = 42
_WORD = r"[^\p{L}\p{N}]+"


def _terms(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _WORD), ""))


def frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """term, count: the number of documents that hold each term."""
    return docs.select(F.explode(_terms(F.col(text))).alias("term")).groupBy("term").count()


def _bucket(term: Column) -> Column:
    return F.xxhash64(term).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def lexicon(docs: DataFrame, text: str = "text", low: float = LOW, high: float = HIGH) -> list[list[str]]:
    """The band's terms, in BUCKETS lists by their hash."""
    n = docs.count()
    seen = frequencies(docs, text)
    band = seen.where((F.col("count") >= F.lit(max(2.0, low * n))) & (F.col("count") <= F.lit(high * n)))
    out: list[list[str]] = [[] for _ in range(BUCKETS)]
    for r in band.groupBy(_bucket(F.col("term")).alias("bucket")).agg(F.sort_array(F.collect_list("term")).alias("terms")).collect():
        out[r["bucket"]] = r["terms"]
    return out


def _chain(own: str, k: int, level: int, depth: int = 0) -> str:
    """SQL of the hashes of the k-th chain's subsets from `level` on, of terms `own` that are in the one before."""
    mask, name = ((1 << BITS) - 1) << (k * LEVELS + level) * BITS, f"o{depth}"
    kept = f"filter({own}, y -> y & {mask}L = 0L)"
    if level + 1 == LEVELS:
        return f"array(xxhash64({kept}))"
    return f"get(transform(array({kept}), {name} -> concat(array(xxhash64({name})), {_chain(name, k, level + 1, depth + 1)})), 0)"


def _subsets() -> str:
    """SQL of the hashes of all subsets of terms `u`; as text, for a column a lambda costs a call to the JVM each."""
    per = 64 // (LEVELS * BITS)  # chains that one hash of a term serves
    salted = lambda salt: ", ".join(_chain("h", k, 0) for k in range(min(per, FAMILIES - salt * per)))
    return ", ".join(f"get(transform(array(transform(u, t -> xxhash64(t, {salt}))), h -> concat({salted(salt)})), 0)" for salt in range(-(-FAMILIES // per)))


def with_parts(df: DataFrame, text: str, band: list[list[str]], out: str) -> DataFrame:
    """df with `out`, the fingerprint of a text as an array of hashes: the whole lexicon's, then each subset's (EMPTY: no term)."""
    (found,) = unused(df, "found")
    buckets = F.from_json(F.lit(json.dumps(band, ensure_ascii=False)), "array<array<string>>")
    known = lambda t: F.array_contains(F.get(buckets, _bucket(t)), t)
    both = let(_terms(F.col(text)), lambda t: F.struct(F.sort_array(F.filter(t, known)).alias("used"), t.alias("terms")))
    whole = "array(if(size(x.used) > 0, xxhash64(x.used), xxhash64(sort_array(x.terms))))"
    parts = F.expr(f"get(transform(array(`{found}`), x -> concat({whole}, get(transform(array(x.used), u -> concat({_subsets()})), 0))), 0)")
    return df.withColumn(found, both).withColumn(out, parts).drop(found)


def as_text(parts: Column) -> Column:
    """32 bits of each hash in hexadecimal."""
    return F.array_join(F.transform(parts, lambda h: F.lpad(F.lower(F.hex(h.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among those not empty in both; 1 for two empty fingerprints."""
    both = F.arrays_zip(a.alias("a"), b.alias("b"))
    counted = F.filter(both, lambda x: (x["a"] != EMPTY) | (x["b"] != EMPTY))
    equal = F.size(F.filter(counted, lambda x: x["a"] == x["b"]))
    return F.when(F.size(counted) == 0, F.lit(1.0)).otherwise(equal / F.size(counted)).cast("double")


def fingerprints(docs: DataFrame, text: str = "text", band: list[list[str]] | None = None) -> DataFrame:
    """docs with `fingerprint`; general use of the operator."""
    band = band if band is not None else lexicon(docs, text)
    (parts,) = unused(docs, "parts")
    return with_parts(docs, text, band, parts).withColumn("fingerprint", as_text(F.col(parts))).drop(parts)


def _mixed(tie: str) -> Column:
    """31 bits of a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("tie"), tie), 33)


def ranges(rows: DataFrame, key: str, tie: str) -> tuple[DataFrame, Column, int]:
    """rows with `range`, ascending by key; the key with null as the least number; how many bounds there are, plus one."""
    # ranges are dealt to partitions by hash: many small ones even out
    parts = 8 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = -(1 << 63)
    own = F.coalesce(F.col(key), F.lit(least))
    cuts = rows.agg(F.percentile_approx(own, [k / parts for k in range(1, parts)], 10 * parts).alias("q")).first()["q"] or []
    times = sorted(Counter(cuts).items())
    bounds = F.from_json(F.lit(json.dumps([x for x, _ in times])), "array<bigint>")
    shares = F.from_json(F.lit(json.dumps([1] + [n for _, n in times])), "array<int>")
    upto = count_upto(bounds, own, len(times))
    at_bound = (upto > 0) & (F.get(bounds, upto - 1) == own)
    # the rows of a bound come before those of larger keys: `parts` is beyond all their shares
    share = F.when(at_bound, F.shiftright(_mixed(tie) * F.get(shares, upto), 31)).otherwise(F.lit(parts))
    return rows.withColumn("range", (upto * (parts + 1) + share).cast("int")), own, parts


def with_next(rows: DataFrame, key: str, tie: str, carry: list[str]) -> DataFrame:
    """rows with next_<c> for each carried column (none null), of the row that follows by (key, hash of tie, tie).

    The rows are dealt into ranges of the key, whose bounds come from a
    quantile sketch, and shuffled once; `lead` works inside a range, and the
    last row of a range takes the first of the next range that has rows. Those
    first rows, one a range, are found by their keys. After the last row comes
    the first. A key that is several bounds at once holds that many ranges'
    rows; they are cut into as many ranges by the hash of `tie`.
    """
    dealt, own, parts = ranges(rows, key, tie)
    firsts = sorted((r[0], r[1], r[2]) for r in dealt.groupBy("range").agg(F.min(own), F.max(F.col(key).isNull())).collect())
    before = {firsts[i][0]: firsts[i - 1][0] for i in range(len(firsts))}
    keys = sorted({k for _, k, null in firsts if not null})
    is_first = F.col(key).isin(keys) | F.col(key).isNull() if any(f[2] for f in firsts) else F.col(key).isin(keys)
    heads = dealt.where(is_first).groupBy("range").agg(*[F.min_by(c, F.struct(F.col(key), _mixed(tie), F.col(tie))).alias(f"head_{c}") for c in carry])
    led_by = F.from_json(F.lit(json.dumps({str(k): v for k, v in before.items()})), "map<string,int>")
    after = heads.withColumn("range", F.element_at(led_by, F.col("range").cast("string")))
    order = Window.partitionBy("range").orderBy(F.col(key), _mixed(tie), F.col(tie))
    led = dealt.select("*", *[F.lead(c).over(order).alias(f"led_{c}") for c in carry])
    return led.join(after, "range", "left").select(*rows.columns, *[F.coalesce(f"led_{c}", f"head_{c}").alias(f"next_{c}") for c in carry])


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    band = lexicon(docs)
    rows = with_next(with_parts(docs, "text", band, "parts"), "doc_id", "text", ["text", "parts"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("bigint").alias("n_chars"), "parts", "next_parts", edited.alias("edited"))
    rows = with_parts(rows, "edited", band, "edited_parts")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("parts")).alias("fingerprint"),
        as_text(F.col("edited_parts")).alias("edited_fingerprint"),
        likeness(F.col("parts"), F.col("edited_parts")).alias("near_edited"),
        likeness(F.col("parts"), F.col("next_parts")).alias("near_next"),
    )
