"""Requests that are asked once: a cache keyed by content, filled by an anti-join, and identities checked by the answers.

The cache is a versioned table, so askers may run at once and a run that
fails has published nothing. The transport is a function (endpoint, params as
JSON) -> text that the caller names by import path; it runs in tasks.
"""

from __future__ import annotations

import importlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.versions import Tables

ANSWER = "request string, answer string, error string"


def request_key(endpoint: Column, params: Column) -> Column:
    """A hash of endpoint and parameters (a map), whatever the order of the parameters."""
    entries = F.array_sort(F.map_entries(params))
    return F.sha2(F.to_json(F.struct(endpoint.alias("e"), entries.alias("p")), {"ignoreNullFields": "false"}), 256)


def ask(requests: DataFrame, cache: Tables, fetch: str) -> tuple[DataFrame, int]:
    """requests (endpoint, params) with request, answer and error; and how many were asked, not found in the cache.

    An error is kept by the name of its type and isn't asked again; equal
    requests are asked once.
    """
    spark = requests.sparkSession
    keyed = requests.withColumn("request", request_key(F.col("endpoint"), F.col("params")))
    have = cache.pin().table("answers") if cache.log.versions() and "answers" in cache.pin().names() else spark.createDataFrame([], ANSWER)
    fresh = keyed.groupBy("request").agg(F.any_value("endpoint").alias("endpoint"), F.to_json(F.any_value("params")).alias("params")).join(have.select("request"), "request", "left_anti")
    module, _, name = fetch.partition(":")

    def run(batches):
        call = getattr(importlib.import_module(module), name)
        for batch in batches:
            out = []
            for request, endpoint, params in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    out.append((request, call(endpoint, params), None))
                except Exception as e:  # noqa: BLE001 - any failure of a request is its answer
                    out.append((request, None, type(e).__name__))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.string())] * 3, names=["request", "answer", "error"])

    change = cache.change()
    change.append("answers", fresh.mapInArrow(run, ANSWER))
    asked = change.staged_rows("answers")
    if asked:
        change.publish()
    return keyed.join(cache.pin().table("answers") if cache.log.versions() else have, "request", "left"), asked


def recovered(asked: DataFrame, evidence: dict[str, tuple[Column, Column]]) -> DataFrame:
    """asked with state and mismatched: RECOVERED if each piece of evidence (ours, the answer's) is known and equal, else why not."""
    differs = F.array_compact(F.array(*[F.when(~F.coalesce(ours == theirs, F.lit(False)), F.lit(n)) for n, (ours, theirs) in evidence.items()]))
    state = F.when(F.col("error").isNotNull(), "REQUEST_FAILED").when(F.col("answer").isNull(), "NO_ANSWER").when(F.size(differs) > 0, "IDENTITY_EVIDENCE_MISMATCH").otherwise("RECOVERED")
    return asked.withColumn("state", state).withColumn("mismatched", F.when(F.col("state") == "IDENTITY_EVIDENCE_MISMATCH", differs))
