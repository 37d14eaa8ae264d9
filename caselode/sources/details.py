"""Details of listed ids: one request an id, made in tasks, with a code for whatever is wrong with the answer."""

from __future__ import annotations

import importlib
import json
import time

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .listing import HttpStatus, fetched, strict_json, strict_xml


#: Largest answer that is taken.
CAP = 2 << 20


def details(ids: DataFrame, id_col: str, fetch: str, url: str, answer_id: str, body: str, cap: int = CAP, pause: float = 1.0) -> DataFrame:
    """id, state, body, metadata (JSON) of each id; url has {id}; pause: seconds that a first retry waits.

    States: OK; HTTP_<status> after the retries that such a status may have;
    BODY_SIZE_LIMIT; UNREADABLE; DETAIL_ID_MISMATCH; DETAIL_BODY_EMPTY.
    """
    module, _, name = fetch.partition(":")

    def one(ident: str):
        call = getattr(importlib.import_module(module), name)
        try:
            raw = fetched(call, url.replace("{id}", ident), lambda seconds: time.sleep(seconds * pause))
        except HttpStatus as e:
            return str(e), None, None
        if len(raw) > cap:
            return "BODY_SIZE_LIMIT", None, None
        try:
            doc = strict_xml(raw) if raw.lstrip()[:1] == b"<" else strict_json(raw)
            (doc,) = doc.values() if len(doc) == 1 and isinstance(next(iter(doc.values())), dict) else (doc,)
        except Exception:  # noqa: BLE001 - what can't be read has a state
            return "UNREADABLE", None, None
        if str(doc.get(answer_id)) != ident:
            return "DETAIL_ID_MISMATCH", None, None
        said = doc.pop(body, None)
        return ("OK" if (said or "").strip() else "DETAIL_BODY_EMPTY"), said, json.dumps(doc, ensure_ascii=False, sort_keys=True)

    def run(batches):
        for batch in batches:
            own = batch.column(0).to_pylist()
            rows = list(zip(*map(one, own), strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in rows)], names=["id", "state", "body", "metadata"])

    return ids.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id")).distinct().mapInArrow(run, "id string, state string, body string, metadata string")


def html_pages(ids: DataFrame, id_col: str, fetch: str, urls: dict[str, str], cap: int = CAP, pause: float = 1.0) -> DataFrame:
    """id, endpoint, state, html of each id at each endpoint; a url has {id}.

    States: OK; HTTP_<status>; BODY_SIZE_LIMIT; NOT_HTML (no tag, or not UTF-8).
    """
    module, _, name = fetch.partition(":")
    endpoints = F.explode(F.array(*[F.struct(F.lit(k).alias("endpoint"), F.lit(v).alias("url")) for k, v in urls.items()])).alias("e")
    asked = ids.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id")).distinct().select("id", endpoints).select("id", "e.endpoint", F.replace("e.url", F.lit("{id}"), F.col("id")).alias("url"))

    def one(url: str):
        try:
            raw = fetched(getattr(importlib.import_module(module), name), url, lambda seconds: time.sleep(seconds * pause))
            if len(raw) > cap:
                return "BODY_SIZE_LIMIT", None
            text = raw.decode("utf-8")
            return ("OK", text) if "<" in text else ("NOT_HTML", None)
        except HttpStatus as e:
            return str(e), None
        except UnicodeDecodeError:
            return "NOT_HTML", None

    def run(batches):
        for batch in batches:
            rows = list(zip(*map(one, batch.column(2).to_pylist()), strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.string()) for x in rows)], names=["id", "endpoint", "state", "html"])

    return asked.mapInArrow(run, "id string, endpoint string, state string, html string")
