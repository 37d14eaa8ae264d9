"""Sealed outputs, hierarchical fingerprints and archives."""

import gzip
import hashlib
import io
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from caselode.operators import merkle
from caselode.sources import archives
from caselode.sources.log import Conflict
from caselode.sources.sealed import check_sealed, sidecars, write_sealed


def test_a_seal_follows_its_inputs(spark, tmp_path):
    spark.range(100).write.parquet(f"{tmp_path}/in")
    df = spark.read.parquet(f"{tmp_path}/in")
    s = write_sealed(df, f"{tmp_path}/out", "t", {"sum": F.sum("id"), "most": F.max("id")}, {"BAD": F.count_if(F.col("id") < 0)})
    assert (s["status"], s["rows"], s["metrics"]) == ("COMPLETE", 100, {"sum": 4950.0, "most": 99.0})
    assert check_sealed(spark, f"{tmp_path}/out") == "COMPLETE" and check_sealed(spark, f"{tmp_path}/none") == "MISSING"
    spark.range(5).write.mode("append").parquet(f"{tmp_path}/in")
    assert check_sealed(spark, f"{tmp_path}/out") == "STALE"  # another file
    again = write_sealed(spark.read.parquet(f"{tmp_path}/in"), f"{tmp_path}/again", "t")
    assert again["rows"] == 105 and check_sealed(spark, f"{tmp_path}/again") == "COMPLETE"
    next((tmp_path / "in").glob("*.parquet")).unlink()
    assert check_sealed(spark, f"{tmp_path}/again") == "STALE"
    one = write_sealed(spark.read.parquet(str(next((tmp_path / "in").glob("*.parquet")))), f"{tmp_path}/one", "t")
    spark.range(5).write.mode("append").parquet(f"{tmp_path}/in")
    assert one["input_files"] == 1 and check_sealed(spark, f"{tmp_path}/one") == "COMPLETE"  # a file of its own in a shared folder
    next((tmp_path / "out").glob("*.parquet")).unlink()
    assert check_sealed(spark, f"{tmp_path}/out") == "DAMAGED"
    assert [tuple(r)[:2] for r in sidecars(spark, [s]).collect()] == [("t", "COMPLETE")]


def test_an_input_that_changes_meanwhile_and_bad_rows(spark, tmp_path, monkeypatch):
    spark.range(10).write.parquet(f"{tmp_path}/in")
    df = spark.read.parquet(f"{tmp_path}/in")
    s = write_sealed(df, f"{tmp_path}/bad", "t", complete={"ODD": F.count_if(F.col("id") % 2 == 1), "BIG": F.count_if(F.col("id") > 99)})
    assert (s["status"], s["reasons"]) == ("INCOMPLETE", ["ODD"]) and check_sealed(spark, f"{tmp_path}/bad") == "INCOMPLETE"
    from caselode.sources import sealed

    states = []
    monkeypatch.setattr(sealed, "_inputs", lambda *a, real=sealed._inputs: states.append(1) or real(*a) | {"x": len(states)})
    assert write_sealed(df, f"{tmp_path}/moved", "t")["reasons"] == ["INPUT_CHANGED"]
    monkeypatch.undo()
    with pytest.raises(Exception, match="(?i)exist"):
        write_sealed(df, f"{tmp_path}/bad", "t")
    (tmp_path / "x.seal.json").write_text("{}")
    with pytest.raises(Conflict):
        write_sealed(df, f"{tmp_path}/x", "t")


KIND = "k int, part string, v string, x double"


@pytest.mark.parametrize("levels", [2, 3, 4])
def test_differing_rows(spark, tmp_path, levels):
    rng = random.Random(1)
    old = [(i, rng.choice("ab"), rng.choice([None, "", "x"]), rng.random()) for i in range(3000)] + [(7, "r", "rep", 0.0)] * 3
    new = [r for r in old if r[0] not in (5, 77)]
    new = [(k, p, "" if k == 99 and v is None else v, x + (k in (40, 41))) for k, p, v, x in new] + [(9001, "new", None, 1.0), (9001, "new", None, 1.0)]
    new.remove((7, "r", "rep", 0.0))
    rng.shuffle(new)
    a = merkle.fingerprint(spark.createDataFrame(old, KIND), ["k"], f"{tmp_path}/a", levels)
    b = merkle.fingerprint(spark.createDataFrame(new, KIND).repartition(5), ["k"], f"{tmp_path}/b", levels)
    got = {r.k: (r.change, len(r.before), len(r.after)) for r in merkle.differing_rows(a, b).collect()}
    want = {5: ("REMOVED", 1, 0), 77: ("REMOVED", 1, 0), 40: ("CHANGED", 1, 1), 41: ("CHANGED", 1, 1), 9001: ("ADDED", 0, 1), 7: ("COUNT", 1, 0)}
    if next(r for r in old if r[0] == 99)[2] is None:
        want[99] = ("CHANGED", 1, 1)
    assert got == want
    buckets = merkle.differing_buckets(a, b)
    assert 0 < len(buckets) <= len(want)
    read = a.rows(buckets).inputFiles()
    assert 0 < len(a.rows(buckets).select(F.input_file_name().alias("f")).distinct().collect()) <= len(buckets) < len(a.rows().inputFiles()) and read
    check = merkle.cross_validate(a, b).first()
    assert (check.audited, check.candidates, check.equal, check.added, check.removed) == (len(old), len(new), False, 1, 2)


def test_equal_and_empty_tables(spark, tmp_path):
    rows = spark.createDataFrame([(i % 50, "p", None, float(i)) for i in range(300)], KIND)
    a, b = merkle.fingerprint(rows, ["k", "part"], f"{tmp_path}/a"), merkle.fingerprint(rows.orderBy(F.desc("x")), ["k", "part"], f"{tmp_path}/b")
    assert merkle.differing_buckets(a, b) == [] and merkle.differing_rows(a, b).count() == 0 and merkle.cross_validate(a, b).first().equal
    tree = {(r.level, r.node): r.n for r in a.tree().collect()}
    assert tree[0, 0] == 300 and sum(n for (level, _), n in tree.items() if level == merkle.LEVELS) == 300
    with pytest.raises(ValueError, match="other keys"):
        merkle.differing_buckets(a, merkle.fingerprint(rows, ["k"], f"{tmp_path}/c"))
    with pytest.raises(ValueError, match="holds"):
        merkle.fingerprint(rows, ["k"], f"{tmp_path}/a")


def tar_of(path, files, mode="w"):
    with tarfile.open(path, mode) as tar:
        for name, data in files:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
        folder = tarfile.TarInfo("a-folder")
        folder.type = tarfile.DIRTYPE
        tar.addfile(folder)


def test_members_of_plain_and_compressed_archives(spark, tmp_path):
    rng = random.Random(2)
    files = [(f"d/{i}-{'n' * (150 if i == 3 else 1)}", rng.randbytes(rng.choice([0, 1, 511, 512, 513, 5000, 3 << 20 if i == 8 else 7]))) for i in range(30)]
    tar_of(tmp_path / "a.tar", files)
    tar_of(tmp_path / "b.tar.gz", files[:5], "w:gz")
    tar_of(tmp_path / "none.tar", [])
    paths = [f"{tmp_path}/a.tar", f"file://{tmp_path}/b.tar.gz", f"{tmp_path}/none.tar"]
    df = archives.tar_members(spark, paths, bytes_per_task=4000)
    assert df.rdd.getNumPartitions() > 5
    got = sorted((r.archive[-4:], r.name, r.size, r.sha256) for r in df.collect())
    of = lambda end, own: [(end, n, len(d), hashlib.sha256(d).hexdigest()) for n, d in own]
    assert got == sorted(of(".tar", files) + of("r.gz", files[:5]))
    assert archives.tar_members(spark, []).count() == 0
    raw = (tmp_path / "a.tar").read_bytes()
    (tmp_path / "cut.tar.gz").write_bytes(gzip.compress(raw[: len(raw) // 2]))
    with pytest.raises(Exception):  # noqa: B017
        archives.tar_members(spark, [f"{tmp_path}/cut.tar.gz"]).collect()


def test_reconciling_archives_with_blobs(spark, tmp_path):
    body = {k: f"body {k}".encode() * (k + 1) for k in range(9)}
    digest = {k: hashlib.sha256(v).hexdigest() for k, v in body.items()}
    rows = [(digest[k], body[k]) for k in range(4)] + [(f"copy/{digest[0]}", body[0]), (digest[5], b"other content"), ("stray", b"stray")]
    made = archives.write_tars(spark.createDataFrame(rows, "name string, body binary").repartition(3), "name", "body", f"file://{tmp_path}/tars").collect()
    assert sum(r.members for r in made) == len(rows)
    found = archives.tar_members(spark, [r.archive for r in made])
    wanted = spark.createDataFrame([(digest[k], len(body[k]) + (k == 3)) for k in range(7)], "sha256 string, size_bytes long")
    got = {r.sha256: (r.status, r.places) for r in archives.reconcile(found, wanted).collect()}
    known = {digest[0]: ("RESTORABLE", 2), digest[1]: ("RESTORABLE", 1), digest[2]: ("RESTORABLE", 1), digest[3]: ("SIZE_MISMATCH", 1), digest[4]: ("MISSING", 0), digest[5]: ("CHANGED", 0), digest[6]: ("MISSING", 0)}
    assert got == known | {hashlib.sha256(x).hexdigest(): ("UNKNOWN", 1) for x in (b"stray", b"other content")}
    (tmp_path / "dir" / "x").mkdir(parents=True)
    (tmp_path / "dir" / "x" / digest[6]).write_bytes(body[6])
    again = archives.reconcile(archives.folder_members(spark, f"{tmp_path}/dir"), wanted)
    assert {r.sha256: r.status for r in again.where("status = 'RESTORABLE'").collect()} == {digest[6]: "RESTORABLE"}
