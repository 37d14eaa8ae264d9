"""Numbered changes of versioned tables, each applied once, with a history of their checksums."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .tables import SourceError
from .versions import Tables

HISTORY = "migrations"
_KIND = "number int, name string, checksum string"


@dataclass
class Step:
    """A change of one table: `rule` says in words or SQL what `change` does; the checksum is of number, name, table and rule."""

    number: int
    name: str
    table: str
    rule: str
    change: Callable[[DataFrame | None], DataFrame]

    def checksum(self) -> str:
        return hashlib.sha256("\0".join((str(self.number), self.name, self.table, self.rule)).encode()).hexdigest()


def migrate(store: Tables, steps: list[Step]) -> list[int]:
    """Apply the steps that the history lacks, each as one version with its entry; their numbers.

    Raises if numbers aren't 1, 2, ..., or a step that was applied has another checksum now, or is gone.
    """
    if [s.number for s in steps] != list(range(1, len(steps) + 1)):
        raise SourceError("MIGRATION_NUMBERS")
    spark, done = store.spark, []
    known = {}
    if store.log.versions() and HISTORY in store.pin().names():
        known = {r["number"]: r["checksum"] for r in store.pin().table(HISTORY).collect()}  # a row a step
    if any(k not in {s.number for s in steps} for k in known):
        raise SourceError("MIGRATION_MISSING")
    for s in steps:
        if s.number in known:
            if known[s.number] != s.checksum():
                raise SourceError("MIGRATION_CHANGED")
            continue
        now = store.pin() if store.log.versions() else None
        there = now is not None and s.table in now.names()
        change = store.change()
        change.replace(s.table, s.change(now.table(s.table) if there else None))
        change.append(HISTORY, spark.createDataFrame([(s.number, s.name, s.checksum())], _KIND))
        change.publish()
        done.append(s.number)
    return done
