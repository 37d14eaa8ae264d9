"""Language identification by nearest centroids.

A text is lower-cased, its ASCII non-letters become blanks, and its byte
n-grams (2 to 4) are hashed into DIM places: a vector of log counts times
inverse document frequency, of length 1. Training takes, per language, the
SAMPLE documents with the smallest hashed ids (a bounded sample, the
parameters SAMPLE and SAMPLE_ALL), and splits each language's vectors into
CLUSTERS centroids by spherical k-means. A text gets the language of the
centroid with the largest cosine. Distance-based rejection: a text whose best
cosine is below REJECT times the smallest tenth-percentile cosine that its
language's training texts had is marked `rejected`.

The model (idf, centroids) has a fixed size per language. Prediction is one
pass over the texts without a shuffle; it sees no column but the text.

Defined cases: a null text, or one without a letter, is `und` with score 0 and
is rejected; a null id counts as the empty string in the fold; null languages
train nothing; languages of any type count by their text, and more than
MAX_LANGS of them raise an error; of centroids equally near the first language
by name wins; with no training document at all every text is `und`; very long
texts are read whole, in one vector; repeated rows each give a row; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ship
from .common import table

DIM_BITS = 14
DIM = 1 << DIM_BITS
CLUSTERS, ROUNDS = 4, 8
#: Training documents of a language, and of all languages together, at most.
SAMPLE, SAMPLE_ALL = 500, 20_000
MAX_LANGS = 1000
REJECT = 0.4
UNDETERMINED = "und"

_LETTER = re.compile(r"[^\W\d_]")
_TABLE = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def features(text: str) -> np.ndarray:
    """Counts of hashed byte n-grams."""
    data = b" " + b" ".join(text.lower().encode().translate(_TABLE).split()) + b" "
    gram = np.frombuffer(data, np.uint8).astype(np.uint32)
    first, out = gram, np.zeros(DIM, np.int64)
    for n in range(2, 5):
        if len(gram) < 2:
            break
        gram = (gram[:-1] << np.uint32(8)) | first[n - 1 :]
        key = (gram * np.uint32(2654435761) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) >> np.uint32(32 - DIM_BITS)
        out += np.bincount(key, minlength=DIM)
    return out


class Model:
    """idf, centroids (unit rows), their languages, and the lowest cosine accepted for each."""

    def __init__(self, idf: np.ndarray, centroids: np.ndarray, langs: list[str], lowest: np.ndarray):
        self.idf, self.centroids, self.langs, self.lowest = idf, centroids, langs, lowest

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = counts.astype(np.float32)
        np.log1p(x, out=x)
        x *= self.idf
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        x /= np.where(norm > 0, norm, 1)
        return x

    def predict(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        out = []
        for at in range(0, len(texts), 32):
            some = texts[at : at + 32]
            live = [i for i, t in enumerate(some) if _LETTER.search(t)] if self.langs else []
            got = {}
            if live:
                cosines = self.vectors(np.stack([features(some[i]) for i in live])) @ self.centroids.T
                for i, row in zip(live, cosines, strict=True):
                    k = int(row.argmax())
                    got[i] = (self.langs[k], float(min(1.0, max(0.0, row[k]))), bool(row[k] < self.lowest[k]))
            out += [got.get(i, (UNDETERMINED, 0.0, True)) for i in range(len(some))]
        return out


def _kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; starts at the mean's farthest, then the farthest from those chosen."""
    near = x @ x.mean(axis=0)
    chosen = [int(near.argmin())]
    while len(chosen) < min(k, len(x)):
        near = (x @ x[chosen].T).max(axis=1)
        chosen.append(int(near.argmin()))
    c = x[chosen]
    for _ in range(ROUNDS):
        label = (x @ c.T).argmax(axis=1)
        c = np.stack([x[label == j].sum(axis=0) if (label == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(3)) == 1


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit on the sample of the documents with a language and a text that aren't held out."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    usable = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    key = F.xxhash64("doc_id")
    counts = {r[0]: r[1] for r in usable.groupBy("lang").count().collect()}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages in {lang}")
    each = max(1, min(SAMPLE, SAMPLE_ALL // max(1, len(counts))))
    # keys below this share of their range hold several times `each`; the window ranks only those
    share = F.from_json(F.lit(json.dumps({k: min(1.0, 8 * each / n) for k, n in counts.items()})), "map<string,double>")
    near = F.pmod(key, F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30)
    order = Window.partitionBy("lang").orderBy("key", "doc_id")
    ranked = usable.where(near).select("lang", F.pmod(key, F.lit(1 << 30)).alias("key"), "doc_id").withColumn("rank", F.row_number().over(order))
    picked = ranked.where(F.col("rank") <= each)
    ids = [r[0] for r in picked.select("doc_id").distinct().collect()]
    one = usable.where(F.col("doc_id").isin(ids) if ids else F.lit(False)).groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("row"))
    sample = one.select("row.lang", "row.text")  # one row an id, so the bound holds for repeated ids too

    def run(batches):
        for batch in batches:
            got = []  # only the places that aren't 0
            for x, t in zip(batch.column(0), batch.column(1), strict=True):
                if _LETTER.search(t.as_py()):
                    v = features(t.as_py())
                    at = np.flatnonzero(v)
                    got.append((x.as_py(), at.astype("<u2").tobytes(), v[at].astype("<u4").tobytes()))
            cols = list(zip(*got, strict=True)) if got else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())],
                names=["lang", "at", "n"],
            )

    found = sorted((r["lang"], bytes(r["at"]), bytes(r["n"])) for r in sample.mapInArrow(run, "lang string, at binary, n binary").collect())
    if not found:
        return Model(np.ones(DIM, np.float32), np.zeros((0, DIM), np.float32), [], np.zeros(0))
    seen = np.zeros(DIM, np.int64)
    for _, at, _ in found:
        seen[np.frombuffer(at, "<u2")] += 1
    idf = (np.log((1 + len(found)) / (1 + seen)) + 1).astype(np.float32)
    model = Model(idf, np.zeros((0, DIM), np.float32), [], np.zeros(0))
    parts, langs, lowest = [], [], []
    for name in sorted({f[0] for f in found}):  # a language at a time: SAMPLE x DIM numbers in memory
        rows_of = [f for f in found if f[0] == name]
        counts = np.zeros((len(rows_of), DIM), np.float32)
        for i, (_, at, n) in enumerate(rows_of):
            counts[i, np.frombuffer(at, "<u2")] = np.frombuffer(n, "<u4")
        own = model.vectors(counts)
        c = _kmeans(own, CLUSTERS)
        floor = REJECT * float(np.quantile((own @ c.T).max(axis=1), 0.1))
        parts.append(c)
        langs += [str(name)] * len(c)
        lowest += [floor] * len(c)
    return Model(idf, np.concatenate(parts).astype(np.float32), langs, np.array(lowest))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", keep: list[str] = (), keep_text: bool = False) -> DataFrame:
    """id, columns to keep, the text if asked for, lang_pred, score, rejected of every text."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # idf and centroids: CLUSTERS vectors a language
    cols = [F.col(id_col), *[F.col(c) for c in keep]]
    rows = docs.select(F.col(text), *cols)
    first = 0 if keep_text else 1
    schema = rows.schema[first:]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                got = shared.value.predict([x.as_py() or "" for x in part.column(0)])
                cols = list(zip(*got, strict=True)) if got else [[], [], []]
                arrays = [*part.columns[first:], pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names[first:], "lang_pred", "score", "rejected"])

    from pyspark.sql import types as T

    kind = T.StructType([*schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return rows.mapInArrow(run, kind)


def op8_langid_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predict(docs, train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
