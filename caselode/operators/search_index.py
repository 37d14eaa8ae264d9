"""A persisted index for literal search, kept up to date file by file: folded texts in blocks, and the trigrams of each block.

An index belongs to a table's folder, key and columns, and consists of
segments. A segment covers some files, each by path, size and time of change,
and is written once: `rows` holds each row's key, place and folded columns,
BLOCK rows to a block; `grams` says which blocks hold which three code points
in a row, sorted by gram, so a search reads few row groups of it. A log of
versions names the segments. When files come, a segment of them alone is
added; files that changed or went are tombstones: their rows are passed over
wherever they lie. Segments of like size are merged once there are FAN of
them, and one is rewritten when most of its rows are dead; merging reads the
index, not the source. Every row is so rewritten a logarithmic number of times.

The index answers only once every file of the table is covered as it is now.
Building goes by PORTION files, each published when done: an interrupted build
goes on where it was. Writers may run at once; of two that publish, one starts
anew from what the other has done.

A search takes the blocks that hold all of its trigrams and tests only their
rows; matches never span columns. A query of fewer than three code points, or
one of common trigrams, reads the folded rows, never the source.

Defined cases: null cells match nothing; a blank query finds nothing; an empty
source has an empty index; columns may have any names, as the index numbers
them; two tables in one folder need a `name` each only if they also share
schema, key and columns. A table is told by the folders that hold its files:
where one comes or goes, such as a partition, it is another table, built anew.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import text_of
from ..functions.text import SLICE
from ..session import ship
from ..sources.log import SLASHES, Conflict, Log, snapshot
from ..sources.tables import SourceError
from ..storage import drop_path, shared_dir
from .search import SHOWN, clamp

VERSION = "folded-trigrams-2"
#: Rows of a block, files of a portion, trigrams that a search looks up at most, rows that it looks at first.
BLOCK, PORTION, LOOKED_UP, PREFIX = 64, 10_000, 8, 256
#: Blocks or files that a search names one by one; beyond that they are joined.
LISTED = 1000
#: Segments of like size that are merged, and what makes sizes alike: the same power of FAN.
FAN = 8
#: Bits of a block's number in its file.
_BLOCK_BITS = 28
_FILE_BITS = 40


def _listed(numbers: list[int]) -> str:
    """Whole numbers for an IN, as one expression: a column a number costs a call each."""
    return ", ".join(map(str, numbers))


def grams(texts: list[str]) -> np.ndarray:
    """Sorted distinct trigrams of texts, 21 bits for each code point, and some over the seams between texts."""
    x = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.unique(x[:-2] << 42 | x[1:-1] << 21 | x[2:]) if len(x) >= 3 else np.zeros(0, np.int64)


def _whole_blocks(batches):
    """Batches, sorted by their first column, cut so that none of its values goes on in the next."""
    held = None
    for batch in batches:
        rows = batch if held is None else pa.concat_batches([held, batch])
        if len(rows):
            block = rows.column(0).to_numpy(zero_copy_only=False)
            last = int(np.searchsorted(block, block[-1]))
            held = rows.slice(last)
            if last:
                yield rows.slice(0, last)
    if held is not None:
        yield held


class SearchIndex:
    """The index of a Parquet table's key and columns; root: where indexes lie, the shared folder if not given."""

    def __init__(self, df: DataFrame, key: str, columns: list[str], root: str | None = None, name: str = ""):
        self.spark, self.df, self.key, self.columns = df.sparkSession, df, key, columns
        self.files = snapshot(df)
        folders = sorted({posixpath.dirname(f) for f in self.files})
        what = [VERSION, name, folders, key, columns, df.schema.simpleString()]
        self.path = f"{root or shared_dir(self.spark) + '/search-index'}/{hashlib.sha256(json.dumps(what).encode()).hexdigest()[:32]}"
        self.log = Log(self.spark, f"{self.path}/log")
        self._load()

    def _load(self) -> None:
        """The newest version, and which of its files are the table's as it is now."""
        self.version, value = self.log.latest()
        self.segments: list[dict] = value["segments"] if value else []
        self.next_file: int = value["next_file"] if value else 0
        self.live: dict[str, int] = {}  # number by path
        self.dead: list[int] = []
        for s in self.segments:
            for path, (number, size, changed, _) in s["files"].items():
                if self.files.get(path) == [size, changed]:
                    self.live[path] = number
                else:
                    self.dead.append(number)

    def missing(self) -> list[str]:
        return [f for f in self.files if f not in self.live]

    def ready(self) -> bool:
        return self.version > 0 and not self.missing()

    # -- building --------------------------------------------------------------

    def _place(self, segment: str, part: str) -> str:
        return f"{self.path}/segments/{segment}/{part}"

    def _new_segment(self, files: list[str]) -> dict:
        """Write the segment of some files; its entry in the log."""
        spark, kinds = self.spark, {f.name: f.dataType for f in self.df.schema}
        name, first = uuid.uuid4().hex, self.next_file
        numbers = json.dumps([{"path": f, "file": first + k} for k, f in enumerate(files)])
        numbered = spark.range(1).select(F.inline(F.from_json(F.lit(numbers), "array<struct<path:string,file:bigint>>")))
        source = spark.read.schema(self.df.schema).parquet(*files)
        texts = [text_of(kinds[c], F.col(c)).alias(f"f{k}") for k, c in enumerate(self.columns)]
        at = F.regexp_replace(F.col("_metadata.file_path"), f"^([^:/]+){SLASHES}", "$1:/")
        rows = source.select(at.alias("path"), F.col("_metadata.row_index").alias("row"), F.col(self.key).alias("key"), *texts)
        block = F.shiftleft("file", _BLOCK_BITS) + F.floor(F.col("row") / BLOCK)
        rows = rows.join(F.broadcast(numbered), "path").select("file", "row", block.alias("block"), "key", *self._folded())  # a row a file of the portion

        def fold(batches):
            for batch in (b.slice(at, SLICE) for b in batches for at in range(0, len(b), SLICE)):
                folded = [pa.array([x.casefold() if x is not None else None for x in c.to_pylist()], c.type) for c in batch.columns[4:]]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], *folded], schema=batch.schema)

        rows.mapInArrow(fold, rows.schema).write.option("compression", "zstd").parquet(self._place(name, "rows"))
        self._write_grams(name)
        counts = {r["file"]: r["count"] for r in self._rows([name]).groupBy("file").count().collect()}  # a row a file of the portion
        if source.count() != sum(counts.values()):
            raise SourceError("SEARCH_ROW_COUNT_MISMATCH")
        entry = {f: [first + k, *self.files[f], counts.get(first + k, 0)] for k, f in enumerate(files)}
        return {"name": name, "rows": sum(counts.values()), "files": entry}

    def _write_grams(self, name: str) -> None:
        held = self._rows([name]).select("block", *self._folded())
        # blocks of few large files are dealt to all tasks
        held = held.repartition("block").sortWithinPartitions("block")

        def run(batches):
            for batch in _whole_blocks(batches):
                block = batch.column(0).to_numpy(zero_copy_only=False)
                starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
                for lo, hi in zip(starts, [*starts[1:], len(block)], strict=True):
                    found = grams([x for c in batch.columns[1:] for x in c.slice(lo, hi - lo).to_pylist() if x])
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), block[lo]))], names=["gram", "block"])

        self._sorted_grams(held.mapInArrow(run, "gram bigint, block bigint"), name)

    def _sorted_grams(self, posted: DataFrame, name: str) -> None:
        """Few large files, adaptively: each holds a range of grams."""
        posted.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block").write.option("compression", "zstd").parquet(self._place(name, "grams"))

    def build(self, portions: int | None = None) -> bool:
        """Index the files that are missing, `portions` times PORTION at most; True once the index is ready."""
        ship(self.spark)
        while (missing := self.missing()) or not self.version:
            if portions is not None:
                if portions == 0:
                    return False
                portions -= 1
            added = [self._new_segment(missing[:PORTION])] if missing else []
            now = snapshot(self.df)
            if any(now.get(f) != self.files[f] for f in missing[:PORTION]):
                raise SourceError("SEARCH_SOURCE_CHANGED")
            self._publish(lambda segments: [*segments, *added])
        self.tidy()
        return True

    def _publish(self, change) -> bool:
        """The next version, with change(segments); False if another writer was first (its version is loaded)."""
        segments = change(self.segments)
        value = {"segments": segments, "next_file": max([self.next_file, *(1 + v[0] for s in segments for v in s["files"].values())])}
        try:
            self.log.append(self.version, value)
        except Conflict:
            return False
        finally:
            self._load()
        return True

    def _live_rows(self, segment: dict) -> int:
        return sum(v[3] for f, v in segment["files"].items() if self.live.get(f) == v[0])

    def tidy(self) -> int:
        """Merge segments of like size, rewrite those that are mostly dead, forget old versions; the number of merges."""
        merges = 0
        while True:
            tiers: dict[int, list[dict]] = {}
            for s in self.segments:
                tiers.setdefault(max(0, s["rows"].bit_length() - 1) // (FAN.bit_length() - 1), []).append(s)
            todo = next((t for t in tiers.values() if len(t) >= FAN), None) or [s for s in self.segments if 2 * self._live_rows(s) < s["rows"]]
            if not todo or not self._merge(todo):
                break
            merges += 1
        self._vacuum()
        return merges

    def _merge(self, parts: list[dict]) -> bool:
        """One segment of the live rows of several, from the index alone."""
        names, own = [s["name"] for s in parts], uuid.uuid4().hex
        files = {f: v for s in parts for f, v in s["files"].items() if self.live.get(f) == v[0]}
        live = [v[0] for v in files.values()]
        if live:
            self._of_files(self._rows(names), "file", live).write.option("compression", "zstd").parquet(self._place(own, "rows"))
            self._sorted_grams(self._of_files(self._grams(names), f"shiftright(block, {_BLOCK_BITS})", live), own)
        new = [{"name": own, "rows": sum(v[3] for v in files.values()), "files": files}] if live else []
        return self._publish(lambda segments: [*(s for s in segments if s["name"] not in names), *new])

    def _of_files(self, df: DataFrame, number: str, files: list[int], among: bool = True) -> DataFrame:
        """Rows whose file number is, or isn't, among some; many are joined, a number each."""
        if not files:
            return df.limit(0) if among else df
        if len(files) <= LISTED:
            return df.where(f"{number} {'in' if among else 'not in'} ({_listed(files)})")
        ids = self.spark.createDataFrame([(x,) for x in files], "_file bigint")
        return df.join(ids, F.expr(number) == F.col("_file"), "left_semi" if among else "left_anti")

    def _vacuum(self) -> None:
        """Keep this version and the one before, for readers that still hold it."""
        versions = self.log.versions()
        if len(versions) <= 2:
            return
        kept = {s["name"] for v in versions[-2:] for s in self.log.read(v)["segments"]}
        gone = {s["name"] for v in versions[:-2] for s in self.log.read(v)["segments"]} - kept
        self.log.forget(versions[:-2])
        for name in gone:
            drop_path(self.spark, f"{self.path}/segments/{name}")

    def drop(self) -> None:
        drop_path(self.spark, self.path)
        self._load()

    # -- reading ---------------------------------------------------------------

    def _folded(self) -> list[str]:
        return [f"f{k}" for k in range(len(self.columns))]

    def _read(self, names: list[str], part: str, schema: str) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self._place(n, part) for n in names])

    def _rows(self, names: list[str]) -> DataFrame:
        kind = {f.name: f.dataType.simpleString() for f in self.df.schema}[self.key]
        return self._read(names, "rows", f"file bigint, row bigint, block bigint, key {kind}" + "".join(f", {f} string" for f in self._folded()))

    def _grams(self, names: list[str]) -> DataFrame:
        return self._read(names, "grams", "gram bigint, block bigint")

    def rows(self) -> DataFrame:
        """file, row, block, key and f0, f1 ...: the columns' folded texts, of all live files."""
        return self._of_files(self._rows([s["name"] for s in self.segments]), "file", self.dead, among=False)

    def candidates(self, needle: str) -> DataFrame | None:
        """Blocks that hold trigrams of a folded needle, evenly chosen ones if it has many; None if it has none."""
        own = grams([needle]).tolist()
        if not own:
            return None
        own = own[:: -(-len(own) // LOOKED_UP)]
        posted = self._grams([s["name"] for s in self.segments]).where(f"gram in ({_listed(own)})")
        per = posted.groupBy("block").agg(F.count("*").alias("n"))  # a gram is posted once a block
        return per.where(F.col("n") == len(own)).select("block")

    def _ordinal(self, rows: DataFrame) -> DataFrame:
        """rows with `ordinal`: ascending in order of the files' paths and of rows within."""
        order = [self.live[f] for f in self.files]
        if order == sorted(order):
            return rows.withColumn("ordinal", F.shiftleft("file", _FILE_BITS) + F.col("row"))
        ranks = self.spark.createDataFrame(list(zip(order, range(len(order)), strict=True)), "file bigint, rank bigint")
        return rows.join(F.broadcast(ranks) if len(order) <= 100 * LISTED else ranks, "file").withColumn("ordinal", F.shiftleft("rank", _FILE_BITS) + F.col("row"))

    def search(self, query: str, limit: int | None = None) -> DataFrame | None:
        """`key`, ordinal and matched_columns (the first 8) of rows with the query in any column; None if not ready.

        With `limit` the first rows in order of the files; common queries are
        answered from the first PREFIX rows of the first file.
        """
        if not self.ready():
            return None
        needle = query.strip().casefold()
        hits = F.array_compact(F.array(*[F.when(F.contains(f, F.lit(needle)), F.lit(c)) for f, c in zip(self._folded(), self.columns, strict=True)]))
        matched = lambda df: self._ordinal(df).select("key", "ordinal", F.slice(hits, 1, SHOWN).alias("matched_columns")).where(F.size("matched_columns") > 0)
        rows = self.rows()
        if not needle:
            return matched(rows.limit(0))
        if limit is not None and self.files:
            limit = clamp(limit)
            first = matched(rows.where((F.col("file") == self.live[next(iter(self.files))]) & (F.col("row") < PREFIX)))
            found = first.orderBy("ordinal").limit(limit).collect()
            if len(found) == limit:
                return self.spark.createDataFrame(found, first.schema)  # 100 rows at most
        blocks = self.candidates(needle)
        if blocks is not None:
            some = [r["block"] for r in blocks.limit(LISTED + 1).collect()]
            # few blocks are named in the scan, many are joined
            if len(some) <= LISTED:
                rows = rows.where(f"block in ({_listed(some)})") if some else rows.limit(0)
            else:
                rows = rows.join(blocks, "block", "left_semi")
        out = matched(rows)
        return out if limit is None else out.orderBy("ordinal").limit(limit)


def index_of(df: DataFrame, key: str, columns: list[str]) -> SearchIndex:
    """The index of df in the shared folder, brought up to date."""
    index = SearchIndex(df, key, columns)
    index.build()
    return index
