"""Reachability over several kinds of nodes and relations, with a reason code for every broken rule.

Nodes are tables by kind, relations tables of links between two kinds. A walk
starts from roots and goes on in rounds, a table a kind: each round finds what
the links of the round before lead to and is written, so a plan never holds
more than one round and a lost executor costs its own tasks. What was found
before is passed over, so cycles end and a node counts once a root; only a
kind that comes again is compared with its own earlier rounds.

Everything in a round meets by the node's id: the pairs of roots and nodes are
dealt by it and told apart where they lie, the node's reasons and links lie
there too. So a round shuffles each pair, each node and each link of its kinds
once. Ids travel packed, two of their digits to a byte.

Rules are checked once a node, not once a path: a node's reasons are computed
with its table and meet the walk by a join.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize


@dataclass
class Kind:
    """Nodes with an `id`, and rules: a code for each condition that a sound node meets (null is not met)."""

    nodes: DataFrame
    rules: dict[str, Column] = field(default_factory=dict)


@dataclass
class Relation:
    """Links (source, target) from nodes of one kind to another; required: a node without one is broken."""

    name: str
    source: str
    target: str
    links: DataFrame
    required: bool = False


_SIGNS, _NIBBLES = "-_:./", "ABCDE"


def _packed(of: str) -> Column:
    """An id as bytes, a different one for every id: digits and signs four bits each behind one or two F, any other text behind a zero byte."""
    nibbles = reduce(lambda x, sign: F.replace(x, F.lit(sign[0]), F.lit(sign[1])), zip(_SIGNS, _NIBBLES), F.col(of))
    short = F.unhex(F.concat(F.when(F.length(of) % 2 == 0, F.lit("FF")).otherwise(F.lit("F")), nibbles))
    return F.when(F.col(of).rlike(r"^[0-9_:./-]*\z"), short).otherwise(F.concat(F.expr("x'00'"), F.col(of).cast("binary")))


def _unpacked(of: str) -> Column:
    digits = reduce(lambda x, sign: F.replace(x, F.lit(sign[1]), F.lit(sign[0])), zip(_SIGNS, _NIBBLES), F.expr(f"trim(LEADING 'F' FROM hex({of}))"))
    return F.when(F.substring(of, 1, 1) == F.expr("x'00'"), F.expr(f"cast(substring({of}, 2) as string)")).otherwise(digits)


def _codes(holds: dict[str, list[Column]]) -> Column:
    """The codes, in order, of which any condition holds."""
    if not holds:
        return F.expr("cast(array() as array<string>)")
    return F.array_compact(F.array(*[F.when(reduce(Column.__or__, holds[code]), F.lit(code)) for code in sorted(holds)]))


def _beside(kind: str, of: Kind, relations: list[Relation]) -> DataFrame:
    """id, reasons, via, target, first: a kind's nodes beside their links, a row a link or one without any; one row a node is its first."""
    broken = [~F.coalesce(ok, F.lit(False)) for ok in of.rules.values()]
    own = of.nodes.where("id is not null").select(F.col("id").cast("string").alias("id"), *[x.alias(f"broken{i}") for i, x in enumerate(broken)])
    nodes = own.withColumn("id", _packed("id")).groupBy("id").agg((F.count("*") > 1).alias("repeated"), *[F.max(f"broken{i}").alias(f"broken{i}") for i in range(len(broken))])
    holds = {"REPEATED": [F.col("repeated")]}
    for i, code in enumerate(of.rules):
        holds.setdefault(code, []).append(F.col(f"broken{i}"))
    leading = {i: r for i, r in enumerate(relations) if r.source == kind}
    if not leading:
        return nodes.select("id", _codes(holds).alias("reasons"), F.lit(None).cast("int").alias("via"), F.lit(None).cast("binary").alias("target"), F.lit(True).alias("first"))
    links = [r.links.where("source is not null and target is not null").select(F.col("source").cast("string").alias("id"), F.lit(i).alias("via"), F.col("target").cast("string").alias("target")) for i, r in leading.items()]
    links = reduce(DataFrame.unionByName, links).select(_packed("id").alias("id"), "via", _packed("target").alias("target")).repartition("id").distinct()
    node = Window.partitionBy("id")
    for name in sorted({r.name for r in leading.values() if r.required}):
        named = [i for i, r in leading.items() if r.name == name]
        none = F.col("via").isNull() if len(named) == len(leading) else ~F.coalesce(F.max(F.col("via").isin(named)).over(node), F.lit(False))
        holds.setdefault(f"NONE:{name}", []).append(none)
    out = nodes.join(links, "id", "left").withColumn("row", F.monotonically_increasing_id())
    return out.select("id", _codes(holds).alias("reasons"), "via", "target", (F.col("row") == F.min("row").over(node)).alias("first"))


def _arrived(step: DataFrame, before: list[DataFrame], names: dict[str, list[int]]) -> DataFrame:
    """root, id, lost: the pairs of a step that were not found before, dealt by id, and their codes if there is no such node."""
    step = step.select("root", "id", *[F.col("via").isin(own).alias(f"by{i}") for i, own in enumerate(names.values())] if len(names) > 1 else [])
    if before:
        old = reduce(DataFrame.unionByName, [x.where("first").select("root", "id", F.lit(True).alias("old")) for x in before])
        step = step.withColumn("old", F.lit(False)).unionByName(old, allowMissingColumns=True)
    flags = [c for c in step.columns if c not in ("root", "id")]
    step = step.repartition("id")
    step = step.groupBy("root", "id").agg(*[F.max(c).alias(c) for c in flags]) if flags else step.distinct()
    if before:
        step = step.where("not old")
    lost = {f"MISSING:{name}": [F.col(f"by{i}") if len(names) > 1 else F.lit(True)] for i, name in enumerate(names)}
    return step.select("root", "id", _codes(lost).alias("lost"))


def walk(kinds: dict[str, Kind], relations: list[Relation], root: str, roots: DataFrame | None = None) -> DataFrame:
    """root, kind, id, depth, reasons: every node that each root reaches, and what is wrong with it.

    roots (id): of kind `root`, all of its nodes if not given. Reasons are the
    codes of failed rules, `MISSING:<relation>` where a link leads to no node
    (the row stands for the missing node and is not followed), `REPEATED` where
    several nodes share an id, and `NONE:<relation>` where a required relation
    has no link. Null roots and links with a null end are left out.
    """
    columns = ["root", "id", "reasons", "first", "via", "target"]
    found: list[tuple[str, int, DataFrame]] = []
    beside: dict[str, DataFrame] = {}
    again: set[str] = set()
    steps: dict[str, tuple[DataFrame | None, dict[str, list[int]]]] = {root: (None, {})}  # pairs to look up, and the relations that lead to them by name
    if roots is not None:
        start = roots.where("id is not null").select(F.col("id").cast("string").alias("id")).select(_packed("id").alias("id"))
        steps = {root: (start.withColumn("root", F.col("id")), {"ROOT": []})}
    depth = 0
    while steps:
        rounds = {}
        for kind, (step, names) in steps.items():
            before = [x for k, _, x in found if k == kind]
            if kind not in beside:
                of = kinds.get(kind) or Kind(next(iter(kinds.values())).nodes.sparkSession.createDataFrame([], "id string"))  # no such nodes
                beside[kind] = _beside(kind, of, relations)
            elif kind not in again:  # it may come often
                again.add(kind)
                beside[kind] = materialize(beside[kind], "nodes")
            if step is None:
                here = beside[kind].withColumn("root", F.col("id"))
            else:
                here = _arrived(step, before, names).join(beside[kind], "id", "left")
                here = here.withColumns({"reasons": F.coalesce("reasons", "lost"), "first": F.coalesce("first", F.lit(True))})
            rounds[kind] = materialize(here.select(*columns), "round")
        rounds = {k: x for k, x in rounds.items() if not found or not x.isEmpty()}  # the first, for its columns
        found += [(k, depth, x) for k, x in rounds.items()]
        steps, depth = {}, depth + 1
        for kind in dict.fromkeys(r.target for r in relations if r.source in rounds):
            names, parts = {}, []
            for i, r in enumerate(relations):
                if r.target == kind and r.source in rounds:
                    names.setdefault(r.name, []).append(i)
            for source in dict.fromkeys(r.source for r in relations if r.target == kind and r.source in rounds):
                own = [i for i, r in enumerate(relations) if r.source == source and r.target == kind]
                parts.append(rounds[source].where(F.col("via").isin(own)).select("root", F.col("target").alias("id"), "via"))
            steps[kind] = reduce(DataFrame.unionByName, parts), names
    return reduce(DataFrame.unionByName, [x.where("first").select(_unpacked("root").alias("root"), F.lit(k).alias("kind"), _unpacked("id").alias("id"), F.lit(d).alias("depth"), "reasons") for k, d, x in found])


def verdicts(reached: DataFrame) -> DataFrame:
    """root, nodes (found, not missing), deepest, broken (nodes with a reason), reasons (distinct codes in order)."""
    lost = F.exists("reasons", lambda x: x.startswith("MISSING:"))
    counts = reached.select("root", "depth", lost.alias("lost"), (F.size("reasons") > 0).alias("bad")).groupBy("root").agg(
        F.count_if(~F.col("lost")).alias("nodes"),
        F.max("depth").alias("deepest"),
        F.count_if("bad").alias("broken"),
    )
    codes = reached.select("root", F.explode("reasons").alias("reason")).distinct().groupBy("root").agg(F.array_sort(F.collect_list("reason")).alias("reasons"))
    return counts.join(codes, "root", "left").withColumn("reasons", F.coalesce("reasons", F.expr("cast(array() as array<string>)")))


def reason_counts(reached: DataFrame) -> DataFrame:
    """kind, reason, roots, nodes: how many roots and distinct nodes each code stands at."""
    one = reached.select("root", "kind", "id", F.explode("reasons").alias("reason"))
    return one.groupBy("kind", "reason").agg(F.countDistinct("root").alias("roots"), F.countDistinct("id").alias("nodes"))
