"""Listings by date windows as a data source, in batch and as a stream.

A listing is asked a window of days at a time, page by page until its total is
there. A window is a partition; a stream's offset is the day up to which
windows are done, so a query that is started again goes on behind the last
window that it committed and gives each row once. Rows of a day outside of the
window that was asked are refused, as are ids that come twice, totals that
change from page to page, and pages that end before the total.

The transport is a function url -> bytes that the caller names by import path;
`file_pages` reads pages from a folder, `bundled_pages` those of a window from
files of BUNDLE pages each.
"""

from __future__ import annotations

import importlib
import json
from datetime import date, timedelta
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .listing import ListingError, as_list, fetched, strict_json, strict_xml, total_of

SCHEMA = "first date, last date, page int, id string, day date, row string"
#: Days from the first to the last of a window, at most.
LONGEST = 92
#: Pages of a file that `bundled_pages` reads, one a line; rows of an Arrow batch.
BUNDLE, BATCH = 1000, 10_000
_as_json = json.JSONEncoder(ensure_ascii=False, sort_keys=True).encode


class Window(InputPartition):
    def __init__(self, first: date, last: date):
        self.first, self.last = first, last


def windows(first: date, last: date, days: int) -> list[Window]:
    """Windows of `days` days from first to last, the last one maybe shorter."""
    if not 1 <= days <= LONGEST + 1:
        raise ListingError("INVALID_WINDOW")
    out, at = [], first
    while at <= last:
        out.append(Window(at, min(last, at + timedelta(days - 1))))
        at += timedelta(days)
    return out


def day_of(text) -> date:
    return _day_of(str(text)[:10])


@lru_cache(1024)
def _day_of(text: str) -> date:
    digits = "".join(c for c in text if c.isdigit())
    try:
        return date(int(digits[:4]), int(digits[4:6]), int(digits[6:8]))
    except ValueError:
        raise ListingError("INVALID_DAY") from None


def listed(options, window: Window):
    """The rows of one window, in the order of its pages."""
    module, _, name = options["fetch"].partition(":")
    fetch = getattr(importlib.import_module(module), name)
    seen: set[str] = set()
    page, total = 0, None
    while total is None or len(seen) < total:
        page += 1
        url = options["url"].format(first=window.first, last=window.last, page=page)
        raw = fetched(fetch, url)
        doc = strict_xml(raw) if raw.lstrip()[:1] == b"<" else strict_json(raw)
        for step in options["root"].split("."):
            doc = doc[step]
        now, rows = total_of(doc.get(options["total"])), as_list(doc.get(options["items"]))
        if total is not None and now != total:
            raise ListingError("TOTAL_CHANGED")
        total = now
        if not rows and len(seen) < total:
            raise ListingError("PARTIAL_LISTING")
        for row in rows:
            ident, day = str(row[options["id"]]), day_of(row[options["day"]])
            if ident in seen:
                raise ListingError("DUPLICATE_SOURCE_ID")
            if not window.first <= day <= window.last:
                raise ListingError("ROW_OUTSIDE_WINDOW")
            seen.add(ident)
            yield (window.first, window.last, page, ident, day, _as_json(row))
    if len(seen) != total:
        raise ListingError("TOTAL_MISMATCH")


def batches(rows):
    """Rows of SCHEMA as Arrow batches."""
    kinds = [pa.date32(), pa.date32(), pa.int32(), pa.string(), pa.date32(), pa.string()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    while some := list(islice(rows, BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names=names)


@lru_cache(1)
def _bundle(url: str) -> list[bytes]:
    return file_pages(url).split(b"\n")


def bundled_pages(url: str) -> bytes:
    """A transport for <window>/page=<number>: the page is a line of the one file of <window>/bundle=<number // BUNDLE>.

    Pages count from 1. A window is asked page by page, so a task reads each of its files once and holds one of them.
    """
    window, _, page = url.rpartition("/page=")
    number, line = divmod(int(page) - 1, BUNDLE)
    lines = _bundle(f"{window}/bundle={number}")
    return lines[line] if line < len(lines) and lines[line] else NO_PAGE


NO_PAGE = b'{"list": {"total": 0, "items": []}}'


def file_pages(url: str) -> bytes:
    """A transport that reads the one file of a folder; a folder that isn't there is an empty page."""
    fs, path = pafs.FileSystem.from_uri(url)
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return NO_PAGE
    (one,) = [f.path for f in fs.get_file_info(pafs.FileSelector(path)) if not f.base_name.startswith(("_", "."))]
    with fs.open_input_file(one) as f:
        return f.read()


class _Batch(DataSourceReader):
    def __init__(self, options):
        self.o = options

    def partitions(self):
        return windows(date.fromisoformat(self.o["from"]), date.fromisoformat(self.o["to"]), int(self.o.get("days", 7)))

    def read(self, window):
        return batches(listed(self.o, window))


class _Stream(DataSourceStreamReader):
    """Offsets are the first day that is not done yet; the newest is the day after `to`."""

    def __init__(self, options):
        self.o = options

    def initialOffset(self):
        return {"day": self.o["from"]}

    def latestOffset(self):
        return {"day": (date.fromisoformat(self.o["to"]) + timedelta(1)).isoformat()}

    def partitions(self, start, end):
        return windows(date.fromisoformat(start["day"]), date.fromisoformat(end["day"]) - timedelta(1), int(self.o.get("days", 7)))

    def read(self, window):
        return batches(listed(self.o, window))

    def commit(self, end):
        pass


class WindowedListing(DataSource):
    """format("windowed_listing") with fetch, url ({first}, {last}, {page}), from, to, days, root, items, total, id, day."""

    @classmethod
    def name(cls):
        return "windowed_listing"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Batch(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)
