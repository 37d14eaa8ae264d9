"""Duplicates, candidate groups, cardinality, conflicts, and event replay of identities."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.suffix import Hashed
from ..functions.text import SLICE
from ..storage import dealt, materialize

#: Rows of a block that one task takes.
LARGE = 4096


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once: n and extra rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").withColumn("extra", F.col("n") - 1)


def candidate_groups(df: DataFrame, keys: list[str], id_col: str, day: str) -> DataFrame:
    """Keys (all known) shared by several ids, with whether they agree on one day; null days count as a value."""
    whole = df.dropna(subset=keys)
    out = whole.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        F.countDistinct(id_col).alias("n_ids"),
        (F.countDistinct(F.coalesce(F.col(day).cast("string"), F.lit(""))) == 1).alias("one_day"),
    )
    return out.where("n_ids > 1")


def incomplete_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that no candidate group can hold, for a null in the key."""
    return df.where(F.greatest(*[F.col(k).isNull().cast("int") for k in keys]) == 1 if len(keys) > 1 else F.col(keys[0]).isNull())


def classify_duplicates(df: DataFrame, keys: list[str], citation: str, day: str) -> DataFrame:
    """Groups of duplicates: SAME_CITATION, SAME_DATE or DIFFERENT."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(citation).alias("c"), F.countDistinct(day).alias("d")).where("n > 1")
    return g.withColumn("kind", F.when(F.col("c") == 1, "SAME_CITATION").when(F.col("d") == 1, "SAME_DATE").otherwise("DIFFERENT")).drop("c", "d")


def cardinality(df: DataFrame, left: str, right: str) -> DataFrame:
    """One row: keys of one side with several partners on the other, in both directions."""
    pairs = df.select(left, right).dropna().distinct()
    one = pairs.groupBy(left).count().agg(F.count_if(F.col("count") > 1).alias("left_with_many"), F.count("*").alias("left_keys"))
    two = pairs.groupBy(right).count().agg(F.count_if(F.col("count") > 1).alias("right_with_many"), F.count("*").alias("right_keys"))
    return one.join(two)  # one row each


def coverage_counts(df: DataFrame, left: Column, right: Column) -> DataFrame:
    """Rows that both, the left only, the right only or neither side covers."""
    state = F.when(left & right, "both").when(left, "left").when(right, "right").otherwise("neither")
    return df.select(F.coalesce(state, F.lit("neither")).alias("state")).groupBy("state").count()


def conflicts(df: DataFrame, alias: str, row: str, fields: list[str]) -> DataFrame:
    """Rows whose alias has two or more different known values of a field: both sides are flagged.

    Counting values per alias replaces a self-join: no pair of rows is made.
    """
    spread = df.groupBy(alias).agg(*[F.countDistinct(f).alias(f"_{f}") for f in fields])
    spread = spread.withColumn("conflicting", F.array_compact(F.array(*[F.when(F.col(f"_{f}") > 1, F.lit(f)) for f in fields]))).where(F.size("conflicting") > 0)
    return df.join(spread.select(alias, "conflicting"), alias).select(row, alias, "conflicting")


def agreement(ours: DataFrame, theirs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Per field: rows of the inner join that agree, differ, or lack a value."""
    j = ours.alias("a").join(theirs.alias("b"), key)
    cols = [F.when(F.col(f"a.{f}").isNull() | F.col(f"b.{f}").isNull(), "missing").when(F.col(f"a.{f}") == F.col(f"b.{f}"), "same").otherwise("different").alias(f) for f in fields]
    long = j.select(*cols).unpivot([], fields, "field", "state")
    return long.groupBy("field", "state").count()


def audit(rows: DataFrame, block: str, id_col: str, text: str, day: str) -> DataFrame:
    """Candidates of one identity: block, id, representative, copies, same_day, common, share of every class of equal texts in a block.

    A block's rows are classes of equal text, each known by its smallest id; the
    class of the smallest id of all is the block's representative, and every
    other class is held against it: whether they agree on the day, the length
    of the longest common substring, and its share of the shorter text. So a
    block of n classes gives n - 1 rows. Null blocks and texts are left out.

    A text is shuffled once: a block's rows stream through one task, which holds
    the representative's text and a few numbers a class. Blocks of more than
    LARGE rows go by classes, dealt in pieces beside their representative.
    """
    known = rows.where(F.col(block).isNotNull() & F.col(text).isNotNull()).select(F.col(block).alias("block"), F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(day).alias("day"))
    large = materialize(known.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > LARGE), "large-blocks")  # one for LARGE rows at most
    some = large.count() > 0
    kind = {f.name: f.dataType.simpleString() for f in known.schema}
    out = f"block {kind['block']}, representative {kind['id']}, id {kind['id']}, copies bigint, same_day boolean, common int, share double"

    def run(batches):
        held, found = None, []
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, len(b), SLICE)):
            kinds = [batch.schema.field(k).type for k in (0, 1, 1)] + [pa.int64(), pa.bool_(), pa.int32(), pa.float64()]
            for of, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held is None or not _equal(of, held.block):
                    found += held.rows() if held else []
                    held = _Block(of)
                held.add(*row)
            if len(found) >= 10_000:
                yield _batch(found, kinds)
                found = []
        if held is not None:
            yield _batch(found + held.rows(), kinds)

    streamed = dealt(known.join(F.broadcast(large), "block", "left_anti") if some else known, "block")
    streamed = streamed.sortWithinPartitions("block", F.asc_nulls_last("id"), "text").mapInArrow(run, out)
    return streamed.unionByName(_audit_large(known, large, out)) if some else streamed


def _audit_large(known: DataFrame, large: DataFrame, out: str) -> DataFrame:
    """The rows of `audit` for large blocks: equal texts are merged where they lie, and a block's classes are dealt to as many tasks as it has LARGE rows."""
    pieces = F.ceil(F.col("n") / LARGE)
    classes = known.join(F.broadcast(large), "block").groupBy("block", "n", F.sha2("text", 256).alias("h"))
    classes = classes.agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("text").alias("text"), F.min("day").alias("day"), F.max("day").alias("last")).where("id is not null")
    first = classes.groupBy("block", "n").agg(F.min(F.struct("id", "text", "day", "last")).alias("r"))
    first = first.select("block", "r", F.explode(F.sequence(F.lit(0).cast("bigint"), pieces - 1)).alias("piece"))
    pairs = classes.withColumn("piece", F.pmod(F.xxhash64("h"), pieces)).join(first, ["block", "piece"]).where("id <> r.id")
    same_day = F.col("day").eqNullSafe(F.col("last")) & F.col("r.day").eqNullSafe(F.col("r.last")) & F.col("day").eqNullSafe(F.col("r.day"))
    pairs = pairs.select("block", F.col("r.id").alias("representative"), "id", "copies", same_day.alias("same_day"), F.col("r.text").alias("a"), F.col("text").alias("b"), "piece")

    def run(batches):
        held, first = None, None  # a block's representative is hashed once for all of a piece's classes
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, len(b), SLICE)):
            found = []
            for a, b in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True):
                if first is None or a != held:
                    held, first = a, Hashed(a)
                found.append(_common(first, b))
            common, share = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(common, pa.int32()), pa.array(share)], names=[*batch.schema.names[:5], "common", "share"])

    return pairs.sortWithinPartitions("block", "piece").mapInArrow(run, out)


def _common(first: Hashed, text: str) -> tuple[int, float]:
    """Length of the longest common substring, and its share of the shorter text."""
    n = first.common_length(Hashed(text))
    return n, n / max(1, min(len(first.text), len(text)))


def _equal(x, y) -> bool:
    """As Spark groups: nulls and NaN are equal to themselves."""
    return x == y or (x != x and y != y)


def _batch(rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["block", "representative", "id", "copies", "same_day", "common", "share"])


class _Block:
    """The classes of one block, whose rows come in order of their ids; of texts it holds the representative's alone."""

    def __init__(self, block):
        self.block = block
        self.classes: dict[bytes, list] = {}  # id, copies, its one day, whether it has several, common, share; by the text's hash
        self.first: str | Hashed | None = None  # hashed once another class comes
        self.least = None

    def add(self, id, text: str, day) -> None:
        h = hashlib.sha256(text.encode()).digest()
        if h not in self.classes:
            if not self.classes:
                self.first, self.least = text, id
            held = [id, 0, None, False, 0, 0.0]
            if self._counts(id):
                self.first = self.first if isinstance(self.first, Hashed) else Hashed(self.first)
                held[4:] = _common(self.first, text)
            self.classes[h] = held
        held = self.classes[h]
        held[1] += 1
        if day is not None:
            held[3] = held[3] or (held[2] is not None and not _equal(held[2], day))
            held[2] = day

    def _counts(self, id) -> bool:
        """Not the representative, nor a text that shares its id."""
        return id is not None and not _equal(id, self.least)

    def rows(self) -> list[tuple]:
        _, _, day, several, _, _ = next(iter(self.classes.values()))
        return [
            (self.block, self.least, c[0], c[1], not (several or c[3]) and _equal(c[2], day), c[4], c[5])
            for c in self.classes.values()
            if self._counts(c[0])
        ]


def replay(events: DataFrame) -> DataFrame:
    """State after CREATE / MERGE / SPLIT / RELINK events (component, sequence, operation, entity, target, key).

    Events of one component are applied in order (null sequences last), which
    no set operation can do; components are independent. A task takes its
    components one after the other and holds the state of one, not its events.
    A later CREATE of a linked key, or an operation on an entity that isn't
    active, is kept out and counted as rejected.
    """
    kind = events.schema["component"].dataType.simpleString()
    out = StructType.fromDDL(f"component {kind}, entity string, state string, merged_into string, keys string, rejected long")
    columns = ["operation", "entity", "target", "key"]

    def run(batches):
        states, held, rows = _States(), None, []
        for batch in batches:
            component = batch.column(0)
            for k, event in enumerate(zip(*[batch.column(c).to_pylist() for c in range(1, 5)], strict=True)):
                if held is None or component[k] != held:
                    if held is not None:
                        rows += states.rows(held.as_py())
                    states, held = _States(), component[k]
                states.apply(*event)
            if len(rows) >= 10_000:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        if held is not None:
            rows += states.rows(held.as_py())
        yield pa.RecordBatch.from_pylist(rows, schema)

    schema = to_arrow_schema(out)
    order = events.repartition("component").sortWithinPartitions("component", F.asc_nulls_last("sequence"))
    return order.select("component", *columns).mapInArrow(run, out)


class _States:
    """Entities of one component, the keys that they hold, and into what they were merged."""

    def __init__(self):
        self.active: dict[str, set[str]] = {}
        self.owner: dict[str, str] = {}  # of each held key
        self.merged: dict[str, str] = {}
        self.rejected = 0

    def give(self, key: str, entity: str) -> None:
        if key in self.owner:
            self.active[self.owner[key]].discard(key)
        self.active.setdefault(entity, set()).add(key)
        self.owner[key] = entity

    def apply(self, operation: str, entity: str, target: str, key: str) -> None:
        active, merged, owner = self.active, self.merged, self.owner
        if operation == "CREATE" and entity not in active and entity not in merged and key not in owner:
            self.give(key, entity)
        elif operation == "MERGE" and entity in active and target in active and entity != target:
            for held in list(active[entity]):
                self.give(held, target)
            del active[entity]
            merged[entity] = target
        elif operation == "SPLIT" and entity in active and key in active[entity] and target not in active and target not in merged:
            self.give(key, target)
        elif operation == "RELINK" and target in active and key in owner:
            self.give(key, target)
        else:
            self.rejected += 1

    def rows(self, component) -> list[dict]:
        names = ("component", "entity", "state", "merged_into", "keys", "rejected")
        rows = [(component, name, "ACTIVE", "", ",".join(sorted(keys)), self.rejected) for name, keys in sorted(self.active.items())]
        rows += [(component, name, "MERGED", into, "", self.rejected) for name, into in sorted(self.merged.items())]
        return [dict(zip(names, r, strict=True)) for r in rows]
