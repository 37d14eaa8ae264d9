"""The pipeline on small tables, stage by stage, against the operators it calls and against brute force."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from caselode.llm import mix, quality
from caselode.llm.common import materialize

from .test_llm import KIND, brute_components


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(4)
    common = {"en": "the of and to in that with this from have", "de": "der die und nicht ein mit sich auch das im"}
    rows = []
    for i in range(120):
        lang = ["en", "de"][i % 2]
        w = [rng.choice(common[lang].split()) if rng.random() < 0.4 else f"{rng.choice('abcdefg')}{rng.choice(['ing', 'ung', 'er'])}{rng.choice('klmn')}ost{rng.choice('pqrstuvw')}{rng.choice('aeiou')}" for _ in range(rng.choice([5, 60, 150]))]
        rows.append((i, " ".join(w), lang, f"src{i % 3}", 0))
    rows += [(200 + i, rows[i][1] + " end", rows[i][2], "src0", 0) for i in range(0, 60, 5)]
    rows += [(300, None, None, None, None), (301, "### $$$ %%% " * 30, "en", "src1", 0)]
    out = tmp_path_factory.mktemp("pipe")
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(f"{out}/documents.parquet")
    return str(out)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "language_id", "near_duplicates", "mixing", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, folder), name)
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    before, after = seen["quality_rules"]
    kept = {r.doc_id for r in quality.quality_rules(before).where("kept").collect()}
    assert {r.doc_id for r in after.collect()} == kept and 300 not in kept and 301 not in kept
    before, after = seen["language_id"]
    assert after.count() >= 0.95 * before.count()
    before, after = seen["near_duplicates"]
    truth = brute_components({r.doc_id: r.text for r in before.collect()})
    assert {r.doc_id for r in after.collect()} == {c for _, c in truth.values()} and after.count() < before.count()
    before, after = seen["mixing"]
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in mix.mix(before).collect())
    before, after = seen["packing"]
    assert after.where("start = 0").count() == before.count()
    whole = after.groupBy("sequence_id").agg(F.sum("length").alias("n")).orderBy("sequence_id").collect()
    assert all(r.n == 2048 for r in whole[:-1])


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_empty(spark):
    docs = spark.createDataFrame([], KIND)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, ""), name)
        assert docs.count() == 0


def test_odd_rows_in_each_stage(spark):
    """Null and tied ids, null columns, equal rows and extra columns: every stage's defined result."""
    rng = random.Random(12)
    stops = "the of and to in that with this from have".split()

    def text(n=60):
        return " ".join(rng.choice(stops) if rng.random() < 0.4 else f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnr')}{rng.choice('aeiou')}{rng.choice('stkp')}" for _ in range(n))

    own = [text() for _ in range(40)]
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(own)]
    rows += [(None, own[0] + " end", "en", "src0", 1), (None, text(), None, None, None), (None, text(), "en", None, 2)]
    rows += [(7, text(), "en", "src1", 3), (7, text(), "xx", "src1", 3), (50, own[5], "en", "src2", 4), (50, own[5], "en", "src2", 4)]
    rows += [(60, None, None, None, None), (61, "", "en", "src0", 0), (62, "### " * 40, "en", "src0", 0)]
    docs = spark.createDataFrame(rows, KIND).withColumn("score", F.lit("clash")).withColumn("copy", F.lit(1)).repartition(3)
    plain = lambda df: sorted((tuple(r) for r in df.select(corpus_pipeline.COLUMNS).collect()), key=str)
    stage = dict(corpus_pipeline.STAGES)
    good = [r for r in rows if r[0] not in (60, 61, 62)]
    ruled = stage["quality_rules"](spark, docs, "")
    assert ruled.columns == corpus_pipeline.COLUMNS and plain(ruled) == sorted(good, key=str)
    known = stage["language_id"](spark, docs, "")
    assert plain(known) == sorted(good, key=str)
    one = plain(stage["near_duplicates"](spark, docs, ""))
    gone = {(None, own[0] + " end"), (50, own[5])}
    assert one == sorted((r for r in rows if (r[0], r[1]) not in gone), key=str)
    mixed = stage["mixing"](spark, docs, "")
    assert set(plain(mixed)) <= set(rows) and mixed.columns == corpus_pipeline.COLUMNS
    packed = stage["packing"](spark, docs, "")
    assert packed.where("start = 0").count() == len(rows)


def test_texts_of_other_scripts_stay(spark):
    """A declared language whose script is another, and scripts without blanks; junk in them goes all the same."""
    korean = " ".join(f"소유권{c} 이전등기{c}" for c in "가나다라마바사아자차카타파하") + " 하였다 그리고"
    rng = random.Random(3)
    japanese = "".join("".join(rng.choice("所有権移転登記文書述地裁判決原告被告のはをにがとでもれる") for _ in range(rng.randrange(8, 30))) + "。" for _ in range(14))
    rows = [(1, korean, "en", "s", 1), (2, japanese, "ja", "s", 1), (3, japanese, None, "s", 1), (4, japanese[:30], "ja", "s", 1), (5, "所有権" * 200, "ja", "s", 1), (6, "zxq wvut " * 3 + " ".join(f"q{i}x" for i in range(40)), "en", "s", 1)]
    kept = corpus_pipeline.quality_stage(spark, spark.createDataFrame(rows, KIND), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]


def test_nothing_to_train_on_is_an_error(spark):
    docs = spark.createDataFrame([(i, f"the text number {i} is here", None, "s", 1) for i in range(9)], KIND)
    with pytest.raises(ValueError, match="language_id"):
        corpus_pipeline.language_stage(spark, docs, "")


def test_mixing_counts(spark):
    """Rows of each source by their rate, null ids among them."""
    rows = [(None if i % 3 == 0 else i, f"word{i % 900} text", "en", f"src{i % 4}", 1) for i in range(6000)]
    docs = spark.createDataFrame(rows, KIND)
    means = {r.g: r.mean for r in mix.rates(docs, mix.TARGETS).collect()}
    got = corpus_pipeline.mixing_stage(spark, docs, "").groupBy("source", F.col("doc_id").isNull().alias("null")).count().collect()
    for r in got:
        own = sum(s == r.source and (i is None) == r["null"] for i, _, _, s, _ in rows)
        mean = means[r.source if r.source in mix.TARGETS else "other"]
        assert abs(r["count"] / own - mean) < 5 * (mean / own) ** 0.5
