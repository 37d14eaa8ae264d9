"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: its target share of the corpus size
over its own size. A document's count is the Poisson distribution with that
mean, inverted at a uniform number made from a hash of seed and row: no random
state, the same counts whenever and wherever a task runs. A row is known by its
id, source and text and by its number among rows equal in all three, so rows
of one id, or of none, are drawn each for itself. Copies are exploded and
shuffled globally by range of a hash of (seed, row, copy).
A mean above DRAW, for which exp(-mean) nears the smallest double, is split
into equal parts of at most DRAW: the count is the sum of one draw for each,
each at its own hash, which has the same Poisson law.
The shuffle key is uniform on 52 bits, so the ranges' bounds are known before
and the input is read and drawn once, with no sample of it.

Sizes are exact sums over all documents. The table of rates has one row per
named target and one for all other sources together, so what is broadcast is
bounded by the parameter `targets`; a hot source moves nothing but its sum.

Only rows that repeat in all three are numbered: they are written with their
partition and place, and a number is the rows of the partitions before plus the
place among one's own, so a group of copies is dealt over its partitions.

Defined cases: a null source, like an unnamed one, belongs to "other"; targets
that don't name "other" raise an error (0 drops such rows on purpose); a null
text has size 0; null ids, sources and texts hash as empty ones; a source
without bytes gets rate 0; columns that clash with outputs are replaced; an
empty table gives no rows.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import if_small, materialize, table, unused

OTHER = "other"
SEED = "mix-1"
#: Target shares of the mixed corpus in bytes; "other" is every other source.
#: The production mix caps the dominant crawl at a quarter and lifts two small sources.
TARGETS = {"src0": 0.25, "src1": 0.10, "src2": 0.10, OTHER: 0.55}

#: Largest mean of one draw; exp(-DRAW) is still a normal double.
DRAW = 700

#: 52 bits of an md5 as a fraction in [0, 1).
_BITS, _DIGITS = float(1 << 52), 13


def unit(*parts: Column | str) -> Column:
    """A uniform number in [0, 1) from a hash; strings name columns."""
    return hash52(*parts).cast("double") / F.lit(_BITS)


def hash52(*parts: Column | str) -> Column:
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[c.cast("string") for c in cols])), 1, _DIGITS), 16, 10).cast("bigint")


def _group(source: Column, targets: dict[str, float]) -> Column:
    named = [s for s in targets if s != OTHER]
    return F.when(source.isin(named), source).otherwise(F.lit(OTHER)) if named else F.lit(OTHER)


def rates(docs: DataFrame, targets: dict[str, float], source: str = "source", text: str = "text") -> DataFrame:
    """source group, bytes, mean repetition rate, number of draws and the cumulative Poisson terms of one draw.

    Terms run to a draw's mean + 12 standard deviations + 40: beyond any 52-bit number.
    """
    whole = sum(targets.values())
    shares = json.dumps([{"g": k, "w": v / whole} for k, v in targets.items()])
    wanted = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(shares), "array<struct<g:string,w:double>>")))
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")
    sums = docs.groupBy(_group(F.col(source), targets).alias("g")).agg(F.sum(size).alias("bytes"))
    sums = sums.withColumn("all_bytes", F.sum("bytes").over(Window.partitionBy(F.lit(1))))  # a row per target
    out = wanted.join(sums, "g", "left")
    own = F.coalesce("bytes", F.lit(0))
    out = out.withColumn("mean", F.when(own > 0, F.col("w") * F.col("all_bytes") / own).otherwise(F.lit(0.0)))
    out = out.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("mean") / DRAW)).cast("int"))
    out = out.withColumn("part", F.col("mean") / F.col("draws"))
    top = F.ceil(F.col("part") + 12 * F.sqrt("part") + 40).cast("int")
    start = F.struct(F.exp(-F.col("part")).alias("p"), F.exp(-F.col("part")).alias("c"), F.array(F.exp(-F.col("part"))).alias("cdf"))
    step = lambda a, k: F.struct(
        (a["p"] * F.col("part") / k).alias("p"),
        (a["c"] + a["p"] * F.col("part") / k).alias("c"),
        F.concat(a["cdf"], F.array(a["c"] + a["p"] * F.col("part") / k)).alias("cdf"),
    )
    cdf = F.aggregate(F.sequence(F.lit(1), top), start, step, lambda a: a["cdf"])
    return out.select("g", own.alias("bytes"), "mean", "draws", cdf.alias("cdf"))


def named(docs: DataFrame, row: str, id_col: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """docs with `row`: id, source, md5 of the text and number among rows equal in these, joined by colons."""
    number, part, place, ahead = unused(docs.withColumn(row, F.lit("")), "number", "part", "place", "ahead")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    out = docs.withColumn(row, F.concat_ws(":", blank(id_col), blank(source), F.coalesce(F.md5(F.col(text).cast("string")), F.lit(""))))
    again = materialize(out.groupBy(row).count().where("count > 1").select(row), "repeated")
    n = again.count()
    once = (out.join(if_small(again, n), row, "left_anti") if n else out).withColumn(row, F.concat(row, F.lit(":1")))
    if not n:
        return once
    many = out.join(if_small(again, n), row).withColumn(place, F.monotonically_increasing_id())
    many = materialize(many.withColumn(part, F.shiftright(place, 33)), "copies")
    counts = many.groupBy(row, part).count()
    before = Window.partitionBy(row).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(counts.select(row, part, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(ahead)), "counts")
    own = F.row_number().over(Window.partitionBy(row, part).orderBy(place))
    many = many.withColumn(number, own).join(if_small(counts), [row, part])
    many = many.withColumn(row, F.concat_ws(":", row, (F.col(number) + F.col(ahead)).cast("string")))
    return once.unionByName(many.select(*once.columns))


def mix(docs: DataFrame, targets: dict[str, float] = TARGETS, seed: str = SEED, id_col: str = "doc_id", source: str = "source", text: str = "text", shuffle: bool = True) -> DataFrame:
    """docs with each row as often as drawn, plus copy, n_copies and shuffle_key."""
    if max(targets.values(), default=0) < 0 or sum(targets.values()) <= 0:
        raise ValueError("target weights must be positive")
    if OTHER not in targets:
        raise ValueError(f"targets must have a weight for {OTHER!r}, the sources that are not named")
    if len(targets) > 10_000 or math.inf in targets.values():
        raise ValueError("at most 10000 targets, all finite")
    g, draws, cdf, u, row = unused(docs, "g", "draws", "cdf", "u", "row")
    table_of_rates = F.broadcast(rates(docs, targets, source, text).select(F.col("g").alias(g), F.col("draws").alias(draws), F.col("cdf").alias(cdf)))
    out = named(docs.drop("copy", "n_copies", "shuffle_key"), row, id_col, source, text)
    out = out.withColumn(g, _group(F.col(source), targets)).join(table_of_rates, g)
    ident = F.col(row)
    out = out.withColumn(u, unit(F.lit(seed), ident))
    drawn = lambda at: F.size(F.filter(cdf, lambda c: c <= at)).cast("bigint")
    more = F.aggregate(F.sequence(F.lit(2), F.col(draws)), F.lit(0).cast("bigint"), lambda n, k: n + drawn(unit(F.lit(seed), F.lit("draw"), k, ident)))
    count = drawn(F.col(u)) + F.when(F.col(draws) > 1, more).otherwise(F.lit(0).cast("bigint"))
    out = out.withColumn("n_copies", count).where("n_copies > 0")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_copies"))))
    key = hash52(F.lit(seed), F.lit("order"), ident, F.col("copy"))
    out = out.withColumn("shuffle_key", key).drop(g, draws, cdf, u, row)
    if shuffle:
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        place = (F.col("shuffle_key") * F.lit(float(parts)) / F.lit(_BITS)).cast("int")
        out = out.repartitionById(parts, F.least(place, F.lit(parts - 1))).sortWithinPartitions("shuffle_key")
    return out


def op9_mix_poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", "copy", "n_copies", "shuffle_key", F.md5("text").alias("text_md5"))


def mix_sql() -> str:
    """The same rows in DuckDB."""
    whole = sum(TARGETS.values())
    named = ", ".join(f"'{s}'" for s in TARGETS if s != OTHER)
    wanted = ", ".join(f"('{k}', {v / whole!r}::double)" for k, v in TARGETS.items())
    number = f"('0x' || substr(md5({{}}), 1, {_DIGITS}))::BIGINT"
    row = "coalesce(doc_id::varchar, '') || ':' || coalesce(source, '') || ':' || coalesce(md5(text), '')"
    return f"""
WITH RECURSIVE w(g, w) AS (VALUES {wanted}),
d AS (SELECT *, {number.format(f"'{SEED}:' || row")}::double / {_BITS!r} AS u FROM (
      SELECT doc_id, source, CASE WHEN source IN ({named}) THEN source ELSE '{OTHER}' END AS g, coalesce(strlen(text), 0) AS b, md5(text) AS text_md5,
      {row} || ':' || row_number() OVER (PARTITION BY {row}) AS row FROM documents)),
s AS (SELECT g, sum(b) AS bytes FROM d GROUP BY g),
r AS (SELECT *, mean / draws AS part FROM (SELECT *, greatest(1, ceil(mean / {DRAW}))::INT AS draws FROM (
      SELECT w.g, CASE WHEN coalesce(bytes, 0) > 0 THEN w * (SELECT sum(bytes) FROM s)::double / bytes::double ELSE 0.0::double END AS mean FROM w LEFT JOIN s USING (g)))),
c AS (SELECT g, part, 0 AS k, exp(-part) AS p, exp(-part) AS cum FROM r UNION ALL
      SELECT g, part, k + 1, p * part / (k + 1), cum + p * part / (k + 1) FROM c WHERE k < ceil(part + 12 * sqrt(part) + 40)),
e AS (SELECT d.*, unnest(generate_series(1, draws)) AS draw FROM d JOIN r USING (g)),
f AS (SELECT * REPLACE (CASE WHEN draw = 1 THEN u ELSE {number.format(f"'{SEED}:draw:' || draw || ':' || row")}::double / {_BITS!r} END AS u) FROM e),
n AS (SELECT doc_id, source, text_md5, row, count(*) FILTER (WHERE c.cum <= u)::BIGINT AS n_copies FROM f JOIN c USING (g) GROUP BY doc_id, source, text_md5, row)
SELECT doc_id, source, k AS copy, n_copies, {number.format(f"'{SEED}:order:' || row || ':' || k")} AS shuffle_key, text_md5
FROM n, unnest(generate_series(1, n_copies)) AS s(k)
"""
