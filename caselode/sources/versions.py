"""Versioned tables: readers pin one version of several tables while writers publish the next.

A version is one entry of a log and names, for each table, its schema and the
folders that hold its rows. Folders are written once and never changed, so a
version stays readable as long as it is kept, whatever is published meanwhile;
a reader that pins a version sees all tables as of one moment. A writer stages
any number of changes and publishes them as one version or not at all. If
somebody else published in between, the changes are put onto that version,
unless it touched one of the same tables: then the writer gets a Conflict.

Updates and deletions write only those folders anew that hold a row concerned
(copy on write). There are no row locks: of two writers of one table one gets
a Conflict and starts again.

The log holds a folder's name, rows and bytes, not its rows; rows are counted
in the pass that writes them.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import drop_path
from .log import Conflict, Log, listing
from .tables import SourceError


class Pinned:
    """All tables of one version."""

    def __init__(self, store: Tables, version: int, value: dict):
        self.store, self.version, self._tables = store, version, value["tables"]

    def names(self) -> list[str]:
        return sorted(self._tables)

    def table(self, name: str) -> DataFrame:
        """The table as of this version; a folder that changed or went since raises."""
        entry = self._tables.get(name)
        if entry is None:
            raise SourceError("NO_SUCH_TABLE")
        spark, schema = self.store.spark, T.StructType.fromJson(json.loads(entry["schema"]))
        for part in entry["parts"]:
            there = listing(spark, self.store.folder(name, part["folder"]))
            if sum(size for file, (size, _) in there.items() if file.endswith(".parquet")) != part["bytes"]:
                raise SourceError("VERSION_DAMAGED" if there else "VERSION_GONE")
        if not entry["parts"]:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(*[self.store.folder(name, p["folder"]) for p in entry["parts"]])

    def rows(self, name: str) -> int:
        return sum(p["rows"] for p in self._tables[name]["parts"])


class Change:
    """Staged writes to some tables, published together."""

    def __init__(self, store: Tables, base: int, value: dict):
        self.store, self.base, self._before, self._staged = store, base, value, {}

    def _write(self, name: str, df: DataFrame) -> dict:
        folder, seen = uuid.uuid4().hex, Observation()
        path = self.store.folder(name, folder)
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").option("compression", "zstd").parquet(path)
        size = sum(size for file, (size, _) in listing(self.store.spark, path).items() if file.endswith(".parquet"))
        return {"folder": folder, "rows": seen.get["rows"], "bytes": size}

    def append(self, name: str, df: DataFrame) -> None:
        """Rows beside those that the table has; the columns must be its own."""
        entry = self._staged.get(name) or self._before["tables"].get(name)
        if entry is None:
            return self.replace(name, df)
        schema = T.StructType.fromJson(json.loads(entry["schema"]))
        if [(f.name, f.dataType) for f in schema] != [(f.name, f.dataType) for f in df.schema]:
            raise SourceError("SCHEMA_CHANGED")
        self._staged[name] = entry | {"parts": [*entry["parts"], self._write(name, df)]}

    def replace(self, name: str, df: DataFrame) -> None:
        """These rows in place of the table's; also makes a table."""
        # columns may be null whatever the plan knows: later parts may hold nulls
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])
        self._staged[name] = {"schema": schema.json(), "parts": [self._write(name, df)]}

    def _now(self, name: str) -> tuple[dict, list[tuple[dict, DataFrame]]]:
        """The table's entry with what is staged so far, and its parts with their rows."""
        entry = self._staged.get(name) or self._before["tables"].get(name)
        if entry is None:
            raise SourceError("NO_SUCH_TABLE")
        part = lambda p: Pinned(self.store, self.base, {"tables": {name: entry | {"parts": [p]}}}).table(name)
        return entry, [(p, part(p)) for p in entry["parts"]]

    def _rewrite(self, name: str, where: Column, change) -> int:
        """Write the parts anew that have rows for which `where` holds, each as change(part) has it; how many such rows there were."""
        entry, parts = self._now(name)
        kept, rows = [], 0
        for p, df in parts:
            n = df.where(where).count()
            rows += n
            kept.append(self._write(name, change(df).select(*df.columns)) if n else p)
        self._staged[name] = entry | {"parts": kept}
        return rows

    def update(self, name: str, where: Column, values: dict[str, Column]) -> DataFrame:
        """Set columns of the rows for which `where` holds (null doesn't); those rows as they are now. Parts without such rows stay."""
        entry, parts = self._now(name)
        kinds = {f.name: f.dataType for f in T.StructType.fromJson(json.loads(entry["schema"]))}
        hit = F.coalesce(where, F.lit(False))
        setting = {c: F.when(hit, v.cast(kinds[c])).otherwise(F.col(c)) for c, v in values.items()}
        spark = self.store.spark
        returned = [df.where(hit).withColumns({c: v.cast(kinds[c]) for c, v in values.items()}) for _, df in parts]
        self._rewrite(name, hit, lambda df: df.withColumns(setting))
        return reduce(DataFrame.unionByName, returned) if returned else spark.createDataFrame([], T.StructType.fromJson(json.loads(entry["schema"])))

    def delete(self, name: str, where: Column) -> int:
        """Take out the rows for which `where` holds; how many. Parts without such rows stay."""
        hit = F.coalesce(where, F.lit(False))
        return self._rewrite(name, hit, lambda df: df.where(~hit))

    def upsert(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        """Rows in place of those of equal keys, beside the others; only parts with such keys are written anew. Keys repeat in neither."""
        entry, parts = self._now(name)
        wanted = rows.select(*keys).distinct()
        kept = []
        for p, df in parts:
            left = df.join(wanted, keys, "left_anti").select(*df.columns)
            kept.append(p if df.join(wanted, keys, "left_semi").isEmpty() else self._write(name, left))
        self._staged[name] = entry | {"parts": kept}
        self.append(name, rows)

    def staged_rows(self, name: str) -> int:
        """How many rows these changes wrote to a table."""
        before = {p["folder"] for p in (self._before["tables"].get(name) or {"parts": []})["parts"]}
        return sum(p["rows"] for p in (self._staged.get(name) or {"parts": []})["parts"] if p["folder"] not in before)

    def drop(self, name: str) -> None:
        self._staged[name] = None

    def publish(self) -> int:
        """Make the next version; Conflict if one that came first touched the same tables."""
        while True:
            at, now = self.store.log.latest()
            now = now or {"tables": {}}
            for name in self._staged:
                if now["tables"].get(name) != self._before["tables"].get(name):
                    raise Conflict(name)
            tables = {k: v for k, v in (now["tables"] | self._staged).items() if v is not None}
            try:
                return self.store.log.append(at, {"tables": tables})
            except Conflict:
                continue  # somebody was faster: put the changes onto theirs


class Tables:
    """Versioned tables below a folder of the shared store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.log = spark, path, Log(spark, f"{path}/log")

    def folder(self, name: str, part: str) -> str:
        return f"{self.path}/data/{name}/{part}"

    def pin(self, version: int | None = None) -> Pinned:
        """A version, the newest if none is named."""
        if version is None:
            version, value = self.log.latest()
        elif version in self.log.versions():
            value = self.log.read(version)
        else:
            value = None
        if value is None:
            raise SourceError("NO_SUCH_VERSION")
        return Pinned(self, version, value)

    def change(self) -> Change:
        at, value = self.log.latest()
        return Change(self, at, value or {"tables": {}})

    def changed_rows(self, name: str, since: int, upto: int | None = None) -> DataFrame:
        """What two versions of a table differ in: its rows with `change`, ADDED or REMOVED.

        Parts that both versions hold are not read.
        """
        old, new = self.pin(since), self.pin(upto)
        before, after = ({p["folder"]: p for p in v._tables[name]["parts"]} for v in (old, new))

        def only(own: dict, other: dict, version: Pinned) -> DataFrame:
            entry = version._tables[name] | {"parts": [p for k, p in own.items() if k not in other]}
            return Pinned(self, version.version, {"tables": {name: entry}}).table(name)

        gone, come = only(before, after, old), only(after, before, new)
        kind = lambda df, x: df.withColumn("change", F.lit(x))
        return kind(come.exceptAll(gone), "ADDED").unionByName(kind(gone.exceptAll(come), "REMOVED"))

    def vacuum(self, keep: int = 2) -> list[str]:
        """Forget all but the newest versions and delete folders that no kept one names; the deleted folders.

        A folder that a writer has staged but not published isn't named either: run this while none writes.
        """
        versions = self.log.versions()
        self.log.forget(versions[: -keep or None])
        used = {(name, p["folder"]) for v in versions[-keep:] for name, entry in self.log.read(v)["tables"].items() for p in entry["parts"]}
        from .log import fs_of

        fs, data = fs_of(self.spark, f"{self.path}/data")
        gone = []
        for table in fs.listStatus(data) if fs.exists(data) else []:
            for part in fs.listStatus(table.getPath()):
                if (table.getPath().getName(), part.getPath().getName()) not in used:
                    gone.append(part.getPath().toString())
                    drop_path(self.spark, gone[-1])
        return gone
