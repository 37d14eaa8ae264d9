"""Versioned tables: pinned readers, atomic publishing, conflicts and clean-up."""

import pytest
from pyspark.sql import functions as F

from caselode.sources.log import Conflict, Log, write_once
from caselode.sources.tables import SourceError
from caselode.sources.versions import Tables


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def store(spark, tmp_path):
    return Tables(spark, f"{tmp_path}/store")


def table(spark, *values):
    return spark.createDataFrame([(v, f"x{v}") for v in values], "id int, t string")


def test_a_pinned_reader_sees_one_version_of_all_tables(spark, store):
    first = store.change()
    first.replace("a", table(spark, 1, 2))
    first.replace("b", table(spark, 10))
    assert first.publish() == 1
    pinned = store.pin()
    lazy = pinned.table("a").join(pinned.table("b"), F.lit(True))
    second = store.change()
    second.append("a", table(spark, 3))
    second.replace("b", table(spark, 20, 21))
    assert rows(store.pin().table("a")) == rows(table(spark, 1, 2))  # staged, not published
    assert second.publish() == 2
    assert lazy.count() == 2 and rows(pinned.table("b")) == rows(table(spark, 10))
    now = store.pin()
    assert rows(now.table("a")) == rows(table(spark, 1, 2, 3)) and now.rows("a") == 3 and now.version == 2
    assert rows(store.pin(1).table("b")) == rows(table(spark, 10))
    assert sorted((r.id, r.change) for r in store.changed_rows("a", 1).collect()) == [(3, "ADDED")]
    assert sorted((r.id, r.change) for r in store.changed_rows("b", 1).collect()) == [(10, "REMOVED"), (20, "ADDED"), (21, "ADDED")]


def test_writers_of_other_tables_both_succeed_and_of_the_same_conflict(spark, store):
    start = store.change()
    start.replace("a", table(spark, 1))
    start.replace("b", table(spark, 2))
    start.publish()
    one, two, three = store.change(), store.change(), store.change()
    one.append("a", table(spark, 3))
    two.append("b", table(spark, 4))
    three.append("a", table(spark, 5))
    assert (one.publish(), two.publish()) == (2, 3)
    with pytest.raises(Conflict):
        three.publish()
    assert rows(store.pin().table("a")) == rows(table(spark, 1, 3)) and rows(store.pin().table("b")) == rows(table(spark, 2, 4))


def test_only_one_of_two_makes_a_version(spark, tmp_path):
    log = Log(spark, f"{tmp_path}/log")
    assert log.latest() == (0, None) and log.append(0, {"x": 1}) == 1
    with pytest.raises(Conflict):
        log.append(0, {"x": 2})
    (tmp_path / "log" / "000000000002.json").write_text('{"x": ')  # torn
    assert log.latest() == (1, {"x": 1})
    with pytest.raises(Conflict):
        write_once(spark, f"{tmp_path}/log/000000000001.json", 3)


def test_vacuum_keeps_what_kept_versions_name(spark, store):
    for k in range(4):
        c = store.change()
        (c.append if k == 3 else c.replace)("a", table(spark, k))
        c.publish()
    assert len(store.vacuum(keep=2)) == 2
    assert rows(store.pin(3).table("a")) == rows(table(spark, 2)) and rows(store.pin().table("a")) == rows(table(spark, 2, 3))
    with pytest.raises(SourceError, match="NO_SUCH_VERSION"):
        store.pin(1)


def test_damage_and_other_columns_are_refused(spark, store, tmp_path):
    c = store.change()
    c.replace("a", table(spark, 1, 2))
    c.publish()
    other = store.change()
    with pytest.raises(SourceError, match="SCHEMA_CHANGED"):
        other.append("a", spark.range(3))
    part = next((tmp_path / "store" / "data" / "a").glob("*/*.parquet"))
    part.unlink()
    with pytest.raises(SourceError, match="VERSION_"):
        store.pin().table("a")
    with pytest.raises(SourceError, match="NO_SUCH_TABLE"):
        store.pin().table("z")
    gone = store.change()
    gone.drop("a")
    gone.publish()
    assert store.pin().names() == []


def test_empty_tables(spark, store):
    c = store.change()
    c.replace("a", table(spark, 1).limit(0))
    c.publish()
    assert store.pin().table("a").count() == 0 and store.pin().rows("a") == 0
