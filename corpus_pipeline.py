"""Training corpus pipeline over `documents`: rules, language, near duplicates, mix, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and returns the columns of documents; the last returns the packed pieces.

Defined cases, for every stage: rows stand for themselves, whatever their ids
(null, repeated, or tied between unlike texts); a null or empty text fails the
rules and so never comes further in `run`, and a stage that meets one anyway
treats it as empty; an empty table gives an empty table; columns beside those
of documents are dropped. Nothing is sampled but the language model's bounded
training rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselode.llm import jaccard, langid, mix, pack, quality
from caselode.llm.bpe import default_path
from caselode.llm.common import materialize
from caselode.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, each row judged by its own text and declared language.

    Null and empty texts go (no words); a null or unknown language only leaves the stop-word rule out, and so does
    one whose script is not the text's; scripts without blanks are judged in words of two characters; equal rows
    are all kept or all go; no row moves.
    """
    return docs.select(COLUMNS).where(quality.kept_by_script(F.col("text"), F.col("lang")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model is fitted on this stage's own input.

    Null texts and texts without a letter go, as does what lies far from every centroid; null languages train
    nothing; documents without one that trains are an error. Of equally near centroids the first language by
    name counts, which never decides whether a row stays.
    """
    rows = docs.select(COLUMNS)
    model = langid.train(rows)
    if not model.langs and not rows.isEmpty():
        raise ValueError("language_id: no document with a language and letters to train on")
    judged = langid.predict(rows, model, keep=["lang", "source", "n_chars"], keep_text=True)
    return judged.where(~F.col("rejected")).select(COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id (null last, then the smallest hash of the text).

    Groups are of rows: unlike texts of one id, or of none, stand each for themselves, and of rows equal in id
    and text one stays. Texts without words are like nothing and all stay.
    """
    return jaccard.keep_one(docs.select(COLUMNS)).select(COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their source's rate, in a global random order.

    Every row is drawn for itself, also rows of one id, of none, or equal in all; a null source is among the
    others; empty texts weigh nothing and are drawn as their source is.
    """
    return mix.mix(docs.select(COLUMNS)).select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of fixed windows over the one sequence of all tokens.

    A null or empty text is its end token alone; repeated rows and ids are packed apart; ids may be null.
    """
    ship(spark)
    return pack.digest(pack.pack(docs, default_path("byte_bpe_50k.json")))


STAGES = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Near duplicates, the language model and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
