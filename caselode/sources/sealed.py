"""Sealed outputs: what a pass wrote, counted in that pass, with the state of its inputs before and after.

The counts are `DataFrame.observe` metrics of the very pass that writes, so
they cost no second scan. The inputs' files are listed before and after; if
they differ, rows of two states may have mixed, and the seal says INCOMPLETE.
So it does if what lies in the output isn't as many rows as were seen. The
sidecar is one JSON file beside the output, made once.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .log import exists, listing, read_json, snapshot, write_once

SIDECAR = "table string, status string, reasons array<string>, rows bigint, metrics map<string,double>, input_files bigint, input_seal string, output_seal string"


def _seal(state: dict) -> str:
    return hashlib.sha256(json.dumps(sorted(state.items())).encode()).hexdigest()


def _output(spark: SparkSession, path: str) -> str:
    """The seal of an output's files: names and sizes, as moving it changes times."""
    return _seal({name: size for name, (size, _) in listing(spark, path).items() if not name.startswith("_")})


def _watched(spark: SparkSession, files: list[str]) -> list[str]:
    """Folders all of whose files are among these: another file there would be another input."""
    own: dict[str, set] = {}
    for f in files:
        folder, _, name = f.rpartition("/")
        own.setdefault(folder, set()).add(name)
    return sorted(folder for folder, names in own.items() if {n for n in listing(spark, folder) if n[0] not in "._"} <= names)


def _inputs(spark: SparkSession, files: list[str], watched: list[str]) -> dict:
    """Size and time of change of files, and of what else is in the watched folders."""
    listed = {folder: listing(spark, folder) for folder in {f.rpartition("/")[0] for f in files} | {*watched}}
    of = lambda f: list(listed[f.rpartition("/")[0]].get(f.rpartition("/")[2], (-1, -1)))
    return {f: of(f) for f in {*files, *(f"{folder}/{n}" for folder in watched for n in listed[folder] if n[0] not in "._")}}


def write_sealed(df: DataFrame, path: str, name: str, metrics: dict[str, Column] | None = None, complete: dict[str, Column] | None = None) -> dict:
    """Write df to path and its sidecar to <path>.seal.json; the sidecar.

    metrics: numbers to be gathered on the way. complete: by reason code, how
    many rows speak against completeness (0 in all of them for COMPLETE).
    """
    spark, seen = df.sparkSession, Observation()
    metrics, complete = metrics or {}, complete or {}
    files = list(snapshot(df))
    watched = _watched(spark, files)
    before = _inputs(spark, files, watched)
    numbers = {**{f"m_{k}": v for k, v in metrics.items()}, **{f"c_{k}": v for k, v in complete.items()}}
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *[v.cast("double").alias(k) for k, v in numbers.items()]).write.mode("errorifexists").option("compression", "zstd").parquet(path)
    got, after = seen.get, _inputs(spark, files, watched)
    reasons = [k for k in complete if got[f"c_{k}"]]
    if after != before:
        reasons.append("INPUT_CHANGED")
    if spark.read.schema(df.schema).parquet(path).count() != got["rows"]:
        reasons.append("OUTPUT_ROWS_DIFFER")
    out = {
        "table": name,
        "status": "INCOMPLETE" if reasons else "COMPLETE",
        "reasons": reasons,
        "rows": got["rows"],
        "metrics": {k: got[f"m_{k}"] for k in metrics},
        "input_files": len(files),
        "input_seal": _seal(before),
        "output_seal": _output(spark, path),
    }
    write_once(spark, f"{path}.seal.json", out | {"files": files, "watched": watched})
    return out


def check_sealed(spark: SparkSession, path: str) -> str:
    """COMPLETE or INCOMPLETE as sealed, if all is still as it was then; else MISSING, DAMAGED (the output changed) or STALE (an input did)."""
    if not exists(spark, f"{path}.seal.json"):
        return "MISSING"
    sealed = read_json(spark, f"{path}.seal.json")
    if _output(spark, path) != sealed["output_seal"]:
        return "DAMAGED"
    return sealed["status"] if _seal(_inputs(spark, sealed["files"], sealed["watched"])) == sealed["input_seal"] else "STALE"


def sidecars(spark: SparkSession, seals: list[dict]) -> DataFrame:
    """The sidecars of some outputs as rows."""
    names = [x.split()[0] for x in SIDECAR.split(", ")]
    return spark.createDataFrame([tuple(s[n] for n in names) for s in seals], SIDECAR)
