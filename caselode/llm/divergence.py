r"""How the sources of a language diverge in their terms, by sorted runs.

Documents are counted where they lie: a task sums its documents' terms by
language, source and term (HELD entries at most, then it starts anew), so a
frequent term costs a task one row. These rows are dealt by (lang, term) and
sorted by (lang, term, source, document), behind a hash of the first two, and
a scan over the sorted runs adds up document frequency and counts; terms of too few documents end there.

Shares need the sums over all kept terms, so partial pairs and terms come from
a second scan, over the kept runs. Sources are numbered within their language
and put into blocks of SOURCES; the runs of a pair of blocks are dealt by term,
and each task adds up, over its runs, the distances between the block's
sources. A task holds one block of sums and a few thousand runs, whatever the
number of sources, terms or documents. Where neither source has a term, both
have their smallest share, so those terms are counted, not visited.

Shares are whole billionths and sums are whole numbers, so results do not
depend on order or on how rows were dealt.

Defined cases: null text, lang or source is read as ''; documents are rows, so
repeated ids count each; a language without a kept term has V = 0, pairs of
value 0 and no terms; a source without terms still has its pairs; a lang of
one source has no pairs; other columns are not read; an empty table gives no
rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import if_small, materialize, table

#: Documents that a kept term occurs in at least, ranks of terms, what is added to counts, units of a share.
LEAST, TOP, ADDED, UNIT = 30, 50, 5, 1_000_000_000
#: Bytes of a text that are split at a time, (lang, source, term) entries that a task holds, sources of a block, cells of a chunk of runs.
PIECE, HELD, SOURCES, CELLS = 1 << 20, 800_000, 256, 1 << 20

#: A-Z to a-z; all other bytes below 128 that are no letters to blanks.
_LETTERS = bytes(x + 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


def terms_of(data: bytes, piece: int = PIECE) -> Counter:
    """How often each term occurs in an UTF-8 text."""
    out, data, at = Counter(), data.translate(_LETTERS), 0
    while at < len(data):
        cut = data.find(b" ", at + piece) if at + piece < len(data) else -1
        to = cut if cut >= 0 else len(data)
        out.update(data[at:to].split())
        at = to
    return out


def counted(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", held: int = HELD) -> DataFrame:
    """lang, term, source, document, docs, n: a task's sums; document numbers the first of its documents."""
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(whole(lang).alias("lang"), whole(source).alias("source"), whole(text).cast("binary").alias("text"), F.monotonically_increasing_id().alias("document"))

    def run(batches):
        sums: dict[tuple, tuple[int, Counter, Counter]] = {}
        size = 0

        def out():
            for (lang, source), (document, docs, n) in sums.items():
                k, terms = len(n), list(n)
                for at in range(0, k, 10_000):
                    own = terms[at : at + 10_000]
                    same = lambda x, kind, m=len(own): pa.repeat(pa.scalar(x, kind), m)
                    columns = [same(lang, pa.string()), pa.array(own, pa.binary()), same(source, pa.string()), same(document, pa.int64()), pa.array([docs[t] for t in own], pa.int64()), pa.array([n[t] for t in own], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "term", "source", "document", "docs", "n"])
            sums.clear()

        for batch in batches:
            for lang, source, text, document in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _, docs, n = sums.setdefault((lang, source), (document, Counter(), Counter()))
                own = terms_of(text)
                size -= len(n)
                docs.update(own.keys())
                n.update(own)
                size += len(n)
                if size > held:
                    yield from out()
                    size = 0
        yield from out()

    return rows.mapInArrow(run, "lang string, term binary, source string, document bigint, docs bigint, n bigint").withColumn("term", F.col("term").cast("string"))


def _starts(*columns: pa.Array) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _whole_runs(batches, names: list[str], squeeze=lambda rows: rows):
    """Batches cut so that no run of equal values in the named columns goes on in the next; squeeze shortens what waits."""
    held = None
    for batch in batches:
        rows = squeeze(batch if held is None else pa.concat_batches([held, batch]))
        at = _starts(*(rows[c] for c in names))
        last = int(at[-1]) if len(at) else 0
        held = rows.slice(last)
        if last:
            yield rows.slice(0, last)
    if held is not None and len(held):
        yield held


def kept_runs(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, term, source, n, lang_n, first of the terms in at least `least` documents of the lang; first is 1 in one row a term."""
    # the hash goes first, as the sort compares its first eight bytes before all else; runs stay whole
    dealt = counts.repartition("lang", "term").sortWithinPartitions(F.xxhash64("lang", "term"), "lang", "term", "source", "document")

    def scanned(rows: pa.RecordBatch) -> pa.RecordBatch:
        """One row for each lang, term and source."""
        at = _starts(rows["lang"], rows["term"], rows["source"])
        sums = [pa.array(np.add.reduceat(_numbers(rows[c]), at)) if len(at) else rows[c] for c in ("docs", "n")]
        return pa.RecordBatch.from_arrays([*(rows[c].take(pa.array(at)) for c in ("lang", "term", "source")), *sums], names=["lang", "term", "source", "docs", "n"])

    def run(batches):
        for rows in _whole_runs(batches, ["lang", "term"], scanned):
            at = _starts(rows["lang"], rows["term"])
            sizes = np.diff(np.r_[at, len(rows)])
            stays = np.repeat(np.add.reduceat(_numbers(rows["docs"]), at) >= least, sizes)
            whole = np.repeat(np.add.reduceat(_numbers(rows["n"]), at), sizes)
            first = np.zeros(len(rows), np.int64)
            first[at] = 1
            columns = [*(rows[c] for c in ("lang", "term", "source", "n")), pa.array(whole), pa.array(first)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "term", "source", "n", "lang_n", "first"]).filter(pa.array(stays))

    return dealt.drop("document").mapInArrow(run, "lang string, term string, source string, n bigint, lang_n bigint, first bigint")


def share(n: str, whole: str, terms: str) -> Column:
    """1 + floor(UNIT * (n + ADDED) / (whole + ADDED * terms)) of these columns, exact; null without terms."""
    wide = lambda x: f"cast({x} as decimal(20,0))"
    return F.expr(f"case when {terms} > 0 then 1 + ({wide(f'{n} + {ADDED}')} * cast({UNIT} as decimal(10,0))) div {wide(f'{whole} + {ADDED} * {terms}')} end")


def groups_of(docs: DataFrame, runs: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, nr (from 0 in the lang), sources, whole, terms, lang_whole, least: each group's sums and its smallest share."""
    whole = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    every = docs.select(whole(lang).alias("lang"), whole(source).alias("source")).distinct()
    own = runs.groupBy("lang", "source").agg(F.sum("n").alias("whole"))
    langs = runs.groupBy("lang").agg(F.sum("n").alias("lang_whole"), F.sum("first").alias("terms"))
    out = every.join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["whole", "lang_whole", "terms"])
    in_lang = Window.partitionBy("lang")
    out = out.withColumn("nr", F.row_number().over(in_lang.orderBy("source")) - 1).withColumn("sources", F.count("*").over(in_lang))
    return out.withColumn("least", share("0L", "whole", "terms"))


class _Distances:
    """Sums of distances between the sources of two blocks, over runs of terms."""

    def __init__(self, key: tuple, heads: pa.RecordBatch, sources: int, cells: int):
        self.lang, self.low, self.high, _ = self.key = key
        self.sources, self.cells = sources, cells
        nr, p = _numbers(heads["nr"]), _numbers(heads["p"])
        self.left, self.right = (p[nr // sources == block] for block in (self.low, self.high))  # in order of nr
        self.sums = np.zeros((len(self.left), len(self.right)), np.int64)

    def add(self, rows: pa.RecordBatch) -> None:
        nr, p, at = _numbers(rows["nr"]), _numbers(rows["p"]), _starts(rows["term"])
        term = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(rows)]))
        step = max(1, self.cells // max(len(self.left), len(self.right)))
        for k in range(0, len(at), step):
            m, own = min(step, len(at) - k), (term >= k) & (term < k + step)
            sides = []
            for block, least in ((self.low, self.left), (self.high, self.right)):
                here = own & (nr // self.sources == block)
                sides.append(np.repeat(least[None], m, axis=0))
                sides[-1][term[here] - k, nr[here] - block * self.sources] = p[here]
            for a in range(len(self.left)):
                self.sums[a] += np.abs(sides[0][:, a, None] - sides[1]).sum(axis=0) - m * np.abs(self.left[a] - self.right)

    def out(self) -> pa.RecordBatch:
        a, b = np.nonzero(self.sums)
        x, a, b = self.sums[a, b], (a + self.low * self.sources).astype(np.int32), (b + self.high * self.sources).astype(np.int32)
        own = a < b
        columns = [pa.repeat(pa.scalar(self.lang, pa.string()), int(own.sum())), *(pa.array(c[own]) for c in (a, b, x))]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "a", "b", "part"])


def pair_sums(runs: DataFrame, groups: DataFrame, sources: int = SOURCES, cells: int = CELLS) -> DataFrame:
    """lang, a, b, part: parts of the distance of sources a < b, less what it were if neither had the terms.

    runs: lang, term, nr, sources, p. A task takes the runs of some terms for a
    pair of blocks; before them come the blocks' smallest shares (term '').
    """
    slots = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["lang", "low", "high", "slot"]

    def paired(df: DataFrame, term: Column, p: str, slot: Column) -> DataFrame:
        block = F.floor(F.col("nr") / sources).cast("int").alias("block")
        other = F.explode(F.sequence(F.lit(0), F.floor((F.col("sources") - 1) / sources).cast("int"))).alias("other")
        df = df.select("lang", "nr", term.alias("term"), F.col(p).alias("p"), slot.alias("slot"), block, "sources").select("*", other)
        return df.select("lang", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "slot", "term", "nr", "p")

    heads = groups.where("terms > 0 and sources > 1").withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    heads = paired(heads, F.lit(""), "least", F.col("at"))
    rows = paired(runs, F.col("term"), "p", F.pmod(F.xxhash64("term"), F.lit(slots)).cast("int"))
    dealt = heads.unionByName(rows).repartition(*key).sortWithinPartitions(*key, "term", "nr")

    def run(batches):
        now = None
        for whole in _whole_runs(batches, [*key, "term"]):
            at = _starts(*(whole[c] for c in key))
            for lo, hi in zip(at, [*at[1:], len(whole)], strict=True):
                rows = whole.slice(lo, hi - lo)
                own, heads = tuple(rows[c][0].as_py() for c in key), pc.equal(rows["term"], "")
                if now is None or now.key != own:
                    if now is not None:
                        yield now.out()
                    now = _Distances(own, rows.filter(heads), sources, cells)
                now.add(rows.filter(pc.invert(heads)))
        if now is not None:
            yield now.out()

    return dealt.mapInArrow(run, "lang string, a int, b int, part bigint")


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST, top: int = TOP, sources: int = SOURCES) -> DataFrame:
    """lang, source, part, item, value, rank: distances to the lang's other sources, and the terms most above the lang's share."""
    runs = materialize(kept_runs(counted(docs, lang, source, text), least), "runs")
    groups = materialize(groups_of(docs, runs, lang, source), "sources")
    shared = runs.join(if_small(groups), ["lang", "source"])
    shared = shared.select("lang", "source", "term", "nr", "sources", share("n", "whole", "terms").alias("p"), share("lang_n", "lang_whole", "terms").alias("q"))
    sums = pair_sums(shared.where("sources > 1"), groups, sources).groupBy("lang", "a", "b").agg(F.sum("part").alias("part"))
    a = groups.select("lang", F.col("nr").alias("a"), F.col("source").alias("a_source"), F.col("least").alias("a_least"), "terms")
    b = groups.select("lang", F.col("nr").alias("b"), F.col("source").alias("b_source"), F.col("least").alias("b_least"))
    both = a.join(b, "lang").where("a < b").join(sums, ["lang", "a", "b"], "left")
    value = F.coalesce("part", F.lit(0)) + F.coalesce(F.col("terms") * F.abs(F.col("a_least") - F.col("b_least")), F.lit(0))
    both = both.select("lang", value.alias("value"), F.explode(F.array(F.struct(F.col("a_source").alias("source"), F.col("b_source").alias("item")), F.struct(F.col("b_source").alias("source"), F.col("a_source").alias("item")))).alias("x"))
    pairs = both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    terms = shared.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    return pairs.select("*", rank).unionByName(terms.select("*", rank).where(F.col("rank") <= top))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


def divergence_sql() -> str:
    """The same in DuckDB, by all terms of all sources."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    share = lambda n, whole: f"(1 + ({UNIT}::HUGEINT * ({n} + {ADDED})) // ({whole} + {ADDED} * v))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
      translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS text FROM documents),
o AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM o GROUP BY ALL HAVING count(DISTINCT doc) >= {LEAST}),
l AS (SELECT lang, sum(lang_n) AS lang_whole, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT x.lang, x.source, coalesce(sum(n), 0) AS whole FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN c USING (lang, source) GROUP BY ALL),
s AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, {share("coalesce(n, 0)", "whole")} AS p, {share("lang_n", "lang_whole")} AS q
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
b AS (SELECT x.lang, x.source, y.source AS item FROM g x JOIN g y USING (lang) WHERE x.source <> y.source),
e AS (SELECT b.lang, b.source, item, coalesce(sum(abs(x.p - y.p)), 0) AS value FROM b LEFT JOIN (s x JOIN s y ON x.lang = y.lang AND x.term = y.term)
      ON x.lang = b.lang AND x.source = b.source AND y.source = item GROUP BY ALL),
r AS (SELECT lang, source, 'pair' AS part, item, value FROM e UNION ALL SELECT lang, source, 'term', term, p - q FROM s WHERE n > 0 AND p > q),
w AS (SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r)
SELECT * FROM w WHERE part = 'pair' OR rank <= {TOP}
"""
