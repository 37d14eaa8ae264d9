"""Paged listings as a Python data source: pages are fetched on executors and decoded strictly.

The transport is a function url -> bytes that the caller names by import path,
so tests read fixtures and nothing here knows a network.
"""

from __future__ import annotations

import importlib
import json
import time
import xml.etree.ElementTree as ET

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RETRIED = {408, 429, 500, 502, 503, 504}
WAITS = (1, 2, 4)


class ListingError(ValueError):
    """A page breaks the listing's contract; the message is the code."""


class HttpStatus(Exception):
    def __init__(self, status: int):
        super().__init__(f"HTTP_{status}")
        self.status = status


def strict_json(raw: bytes):
    """JSON in UTF-8 whose objects don't repeat a key."""

    def once(pairs):
        if len({k for k, _ in pairs}) != len(pairs):
            raise ListingError("DUPLICATE_JSON_KEY")
        return dict(pairs)

    return json.loads(raw.decode("utf-8"), object_pairs_hook=once)


def strict_xml(raw: bytes) -> dict:
    """XML without a document type, as nested dicts; repeated elements become lists."""
    if b"<!DOCTYPE" in raw.upper() or b"<!ENTITY" in raw.upper():
        raise ListingError("DTD_REJECTED")

    def value(node):
        if not len(node):
            return (node.text or "").strip()
        out: dict = {}
        for child in node:
            got = value(child)
            if child.tag in out:
                out[child.tag] = [*(out[child.tag] if isinstance(out[child.tag], list) else [out[child.tag]]), got]
            else:
                out[child.tag] = got
        return out

    root = ET.fromstring(raw)
    return {root.tag: value(root)}


def as_list(x) -> list:
    """One object stands for a list of one; nothing for none."""
    return x if isinstance(x, list) else [] if x in (None, "") else [x]


def total_of(x) -> int:
    if isinstance(x, bool) or not str(x).isdigit():
        raise ListingError("INVALID_TOTAL")
    return int(x)


def fetched(fetch, url: str, wait=time.sleep) -> bytes:
    """The body, with up to three more tries after states that may pass."""
    for pause in (*WAITS, None):
        try:
            return fetch(url)
        except HttpStatus as e:
            if e.status not in RETRIED or pause is None:
                raise
            wait(pause)
    raise AssertionError


class _Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.o = options

    def partitions(self):
        return [_Page(p) for p in range(int(self.o.get("first", 1)), int(self.o["last"]) + 1)]

    def read(self, page):
        module, _, name = self.o["fetch"].partition(":")
        raw = fetched(getattr(importlib.import_module(module), name), self.o["url"].replace("{page}", str(page.number)))
        doc = strict_xml(raw) if raw.lstrip()[:1] == b"<" else strict_json(raw)
        for step in self.o["root"].split("."):
            doc = doc[step]
        rows, total = as_list(doc.get(self.o["items"])), total_of(doc.get(self.o["total"]))
        ids = [str(r[self.o["id"]]) for r in rows]
        yield (page.number, total, ids, [json.dumps(r, ensure_ascii=False, sort_keys=True) for r in rows])


class ListingSource(DataSource):
    """spark.dataSource.register(ListingSource), then format("listing") with url, last, fetch, root, items, total, id."""

    @classmethod
    def name(cls):
        return "listing"

    def schema(self):
        return "page int, total bigint, ids array<string>, rows array<string>"

    def reader(self, schema):
        return _Reader(self.options)
