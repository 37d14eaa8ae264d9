"""Conversation prefix tries, by radix partitioning over dictionary-encoded turns.

Turns are encoded by a written dictionary, so that a conversation is a
sequence of numbers; equal sequences become one row with a count. Buckets of
sequences that share a prefix are divided by their next turn, the most
significant first. A bucket of more than LOCAL turns is divided again in a
round of Spark jobs, from the end of the prefix that all of it shares (the
smallest and the largest sequence tell how far), so a round always splits; the
nodes passed are summed by partial aggregates, however large the bucket. All
smaller buckets are dealt to tasks, where a multikey quicksort finishes them:
its middle parts are the nodes. What large nodes need of their subtrees is
summed over the tops of the buckets below them, in one more job.

Ids of conversations that end at a node are joined in order, piece by piece:
sorted by range, each task joins its own, and one digest runs over the pieces.

Defined cases: turns of one conversation are ordered by turn (null first),
then role, then a hash of role and text; null role or text is empty; rows of a
null conversation id belong to no conversation and are left out; a
conversation without turns ends at the root; other columns are not read; an
empty table gives no nodes. A conversation's numbers (16 bytes a turn) are one
row, and the joined ids of equal conversations are hashed one after the other.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, if_small, materialize, table

#: Turns of a bucket that a task sorts; ids whose text is joined into one piece at most.
LOCAL, PIECE = 50_000, 100_000
NO_ENDS = hashlib.sha256(b"").hexdigest()


def encoded(rows: DataFrame, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, tie, turn_id, n_bytes: turns with their number in a dictionary of all distinct ones."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("conv_id"), F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text"))
    key = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))  # the length tells role and text apart
    turns = materialize(turns.select("conv_id", "turn", "role", key.alias("key"), F.octet_length("text").cast("bigint").alias("n_bytes")), "turns")
    numbers = materialize(turns.select("key").distinct().withColumn("turn_id", F.monotonically_increasing_id()), "dictionary")
    out = materialize(turns.join(if_small(numbers), "key").select("conv_id", "turn", "role", F.col("key").alias("tie"), "turn_id", "n_bytes"), "encoded")
    discard(turns, numbers)
    return out


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, ids, sizes: each conversation's turn numbers in order, and their texts' bytes."""
    whole = F.sort_array(F.collect_list(F.struct("turn", "role", "tie", "turn_id", "n_bytes")))
    out = turns.groupBy("conv_id").agg(whole.alias("x"))  # nulls sort first
    return out.select("conv_id", F.col("x.turn_id").alias("ids"), F.col("x.n_bytes").alias("sizes"))


def ends(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """key, digest: SHA-256 of each key's conversation ids, in order, joined by commas.

    rows: key, conv_id. Ids are joined where a range of them lies, in pieces of
    `piece`; only pieces of one key meet in one task, and run through it.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("key", "conv_id").repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")

    def join(batches):
        key, first, held = None, None, []

        def out():
            return pa.RecordBatch.from_pylist([{"key": key, "first": first, "joined": ",".join(held)}], schema=pa.schema([("key", pa.binary()), ("first", kind), ("joined", pa.string())]))

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (k != key or len(held) >= piece):
                    yield out()
                    held = []
                if not held:
                    key, first = k, c
                held.append(str(c))
        if held:
            yield out()

    def digest(batches):
        key, state = None, None
        for batch in batches:
            keys, digests = [], []
            for k, joined in zip(batch["key"].to_pylist(), batch["joined"].to_pylist(), strict=True):
                if k != key:
                    if state is not None:
                        keys.append(key)
                        digests.append(state.hexdigest())
                    key, state = k, hashlib.sha256(joined.encode())
                else:
                    state.update(f",{joined}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], names=["key", "digest"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["key", "digest"])

    kind = rows.schema["conv_id"].dataType.simpleString()
    pieces = dealt.mapInArrow(join, f"key binary, first {kind}, joined string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digest, "key binary, digest string")


def _prefix(ids: str | Column, n: str | Column) -> Column:
    return F.slice(F.col(ids) if isinstance(ids, str) else ids, F.lit(1), F.col(n) if isinstance(n, str) else n)


def _shared(a: str, b: str) -> Column:
    """How many numbers two arrays share from the start."""
    least = F.least(F.size(a), F.size(b))
    unlike = F.filter(F.sequence(F.lit(0), least), lambda i: (i >= least) | (F.get(a, i) != F.get(b, i)))
    return F.get(unlike, F.lit(0))


def sorted_nodes(bucket: list[tuple], depth: int) -> list[list]:
    """The nodes below a bucket's prefix of `depth` - 1 turns, in order from the top, by multikey quicksort.

    bucket: (ids, sizes, n, least, digest) of distinct sequences that share
    their first `depth` ids. A node: depth, parent (place in the list, -1 for
    none), bytes of its last text, least, n, children, leaves, saved, digest.
    """
    ids = [x[0] for x in bucket]
    nodes: list[list] = []

    def node(parent: int, at: int, of: int) -> int:
        nodes.append([at, parent, bucket[of][1][at - 1], None, 0, 0, 0, 0, None])
        return len(nodes) - 1

    todo = [(list(range(len(bucket))), depth, node(-1, depth, 0))]
    while todo:
        own, at, top = todo.pop()
        if len(own) == 1:  # a tail: nothing to sort
            (k,) = own
            for d in range(at + 1, len(ids[k]) + 1):
                top = node(top, d, k)
            nodes[top][3:5], nodes[top][8] = bucket[k][3:1:-1], bucket[k][4]
            continue
        # -1 where a sequence ends: smaller than any number
        now = [ids[k][at] if at < len(ids[k]) else -1 for k in own]
        pivot = sorted((now[0], now[len(now) // 2], now[-1]))[1]
        same = [k for k, x in zip(own, now) if x == pivot]
        for part in ([k for k, x in zip(own, now) if x < pivot], [k for k, x in zip(own, now) if x > pivot]):
            if part:
                todo.append((part, at, top))
        if pivot < 0:  # distinct sequences: one ends here
            nodes[top][3:5], nodes[top][8] = bucket[same[0]][3:1:-1], bucket[same[0]][4]
        else:
            todo.append((same, at + 1, node(top, at + 1, same[0])))
    for x in reversed(nodes):  # children come after their parents
        x[6] = x[6] or 1
        x[7] += (x[4] - 1) * x[2]
        if x[1] >= 0:
            up = nodes[x[1]]
            up[3] = x[3] if up[3] is None else min(up[3], x[3])
            up[4] += x[4]
            up[5] += 1
            up[6] += x[6]
            up[7] += x[7]
    return nodes


NODE = "conv_id {0}, depth bigint, parent_conv_id {0}, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def _local(buckets: DataFrame, kind: str) -> DataFrame:
    """The nodes of buckets that fit into a task, with `top` (prefix and path) at the top of each.

    buckets: edge (the prefix that a bucket shares), up (its parent's conv_id),
    path, and the columns of sequences.
    """
    dealt = buckets.select("edge", "up", "path", "ids", "sizes", "n", "least", "digest").repartition("edge").sortWithinPartitions("edge")
    schema = f"{NODE.format(kind)}, edge array<bigint>, path array<int>"

    def run(batches):
        names = [x.split()[0] for x in schema.split(", ")]

        def finished(edge, up, path, rows):
            nodes = sorted_nodes(rows, len(edge))
            out = [(x[3], x[0], up if x[1] < 0 else nodes[x[1]][3], x[4], x[5], x[6], x[7], x[8] or NO_ENDS, None, None) for x in nodes]
            out[0] = (*out[0][:-2], edge, path)
            for lo in range(0, len(out), 10_000):
                columns = list(zip(*out[lo : lo + 10_000], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        held, rows = None, []
        for batch in batches:
            own = batch.schema
            types = [own.field("up").type, pa.int64(), own.field("up").type, *[pa.int64()] * 4, pa.string(), own.field("edge").type, own.field("path").type]
            for edge, up, path, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and edge != held[0]:
                    yield from finished(*held, rows)
                    rows = []
                held = edge, up, path
                rows.append(tuple(row))
        if rows:
            yield from finished(*held, rows)

    return dealt.mapInArrow(run, schema)


def trie(convs: DataFrame, local: int = LOCAL) -> DataFrame:
    """The nodes of the prefix trie of conversations: conv_id, ids, sizes (any number of turns).

    A node: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens (bytes of text that members share with
    the first of them, in the whole subtree), ends_sha256.
    """
    kind = convs.schema["conv_id"].dataType.simpleString()
    keyed = materialize(convs.withColumn("key", F.unhex(F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256))), "sequences")
    whole = keyed.groupBy("key").agg(F.first("ids").alias("ids"), F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("least"))
    live = materialize(whole.join(ends(keyed), "key").select("ids", "sizes", "n", "least", "digest"), "distinct")
    # a large node is known by its prefix; the nodes on the way to it, from `start` on, have all its members
    level = live.agg(*_summary(), F.min("ids").alias("lo"), F.max("ids").alias("hi")).where("n is not null").withColumn("end", _shared("lo", "hi"))
    level = level.select(_prefix("lo", "end").alias("prefix"), F.lit(0).alias("start"), "n", "least", F.lit(None).cast(kind).alias("up"), _prefix("sizes", "end").alias("sizes"), F.array("end").alias("path"))
    level = materialize(level, "level")
    root = level.select(F.size("prefix").alias("end"), "least").first()
    if root is None:
        return live.select(*[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in NODE.format(kind).split(", ")])
    lives, levels, buckets = [], [], []
    live = live.withColumns({"to": F.lit(root["end"]), "up": F.lit(root["least"]).cast(kind), "path": F.array(F.lit(root["end"]))})
    n = 1
    while n:
        levels.append(level)
        live = materialize(live.withColumn("edge", F.when(F.size("ids") > F.col("to"), _prefix("ids", F.col("to") + 1))), "live")
        lives.append(live)
        under = live.where("edge is not null")
        turns = F.sum(F.size("ids") - F.col("to")).alias("turns")
        below = under.groupBy("edge").agg(*_summary(), *[F.first(c).alias(c) for c in ("to", "up", "path")], turns, F.count("*").alias("rows"), F.min("ids").alias("lo"), F.max("ids").alias("hi"))
        below = below.where((F.col("turns") > local) & (F.col("rows") > 1)).withColumn("end", _shared("lo", "hi"))
        level = below.select(_prefix("lo", "end").alias("prefix"), (F.col("to") + 1).alias("start"), "n", "least", "up", _prefix("sizes", "end").alias("sizes"), F.concat("path", F.array("end")).alias("path"))
        level = materialize(level, "level")
        n = level.count()
        on = if_small(level.select(_prefix("prefix", "start").alias("edge"), F.size("prefix").alias("deeper"), F.col("least").alias("own"), F.col("path").alias("on")), n)
        buckets.append(under.join(on, "edge", "left_anti") if n else under)
        live = under.join(on, "edge").select("ids", "sizes", "n", "least", "digest", F.col("deeper").alias("to"), F.col("own").alias("up"), F.col("on").alias("path"))
    nodes = materialize(_local(reduce(DataFrame.unionByName, buckets), kind), "nodes")
    ended = reduce(DataFrame.unionByName, [x.where("edge is null").select(F.col("ids").alias("prefix"), "digest") for x in lives])
    passed = materialize(_passed(reduce(DataFrame.unionByName, levels), nodes.where("edge is not null"), ended), "passed")
    discard(keyed, level, *levels, *lives)
    return nodes.select(*passed.columns).unionByName(passed)


def _summary() -> list[Column]:
    return [F.sum("n").alias("n"), F.min("least").alias("least"), F.first("sizes").alias("sizes")]


def _passed(large: DataFrame, tops: DataFrame, ended: DataFrame) -> DataFrame:
    """The nodes that rounds passed, with the sums of what lies below them.

    large: prefix, start, n, least, up, sizes, path (ends of the large nodes
    from the root to it); tops: the uppermost nodes of buckets, with edge and
    path; ended: prefix and digest where a sequence ends.
    """
    cost = lambda since: F.aggregate(F.slice("sizes", F.greatest(since, F.lit(1)), F.size("sizes")), F.lit(0).cast("bigint"), lambda x, size: x + size) * (F.col("n") - 1)
    small = tops.select("edge", "n_leaves", "saved_tokens", F.col("path").alias("above"))
    again = large.where("start > 0").select(F.col("prefix").alias("edge"), F.lit(0).cast("bigint").alias("n_leaves"), cost(F.col("start")).alias("saved_tokens"), F.expr("slice(path, 1, size(path) - 1)").alias("above"))
    below = small.unionByName(again).select("*", F.posexplode("above").alias("k", "at"))
    child = F.when(F.col("k") == F.size("above") - 1, 1)
    below = below.groupBy(_prefix("edge", "at").alias("prefix")).agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.count(child).alias("children"))
    out = large.join(below, "prefix", "left").join(ended, "prefix", "left").withColumn("end", F.size("prefix"))
    out = out.withColumn("depth", F.explode(F.sequence("start", "end")))
    return out.select(
        F.col("least").alias("conv_id"),
        F.col("depth").cast("bigint").alias("depth"),
        F.when(F.col("depth") == F.col("start"), F.col("up")).otherwise(F.col("least")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(F.col("depth") < F.col("end"), F.lit(1)).otherwise(F.coalesce("children", F.lit(0))).cast("bigint").alias("n_children"),
        F.coalesce("leaves", F.lit(1)).alias("n_leaves"),
        (F.coalesce("saved", F.lit(0)) + cost(F.col("depth"))).alias("saved_tokens"),
        F.when((F.col("depth") == F.col("end")) & F.col("digest").isNotNull(), F.col("digest")).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def rebuilt(convs: DataFrame, group: int = 5, spread: int = 9) -> DataFrame:
    """Conversations that share openings: the first turns of the group's first conversation, then each one's own from there on.

    How many, 0 to spread - 1, is the crc32 of the decimal conv_id.
    """
    n = F.crc32(F.col("conv_id").cast("string")) % spread
    opening = convs.select(F.col("conv_id").alias("first"), _prefix("ids", F.lit(spread - 1)).alias("ids_0"), _prefix("sizes", F.lit(spread - 1)).alias("sizes_0"))
    out = convs.withColumn("first", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", n.cast("int")).join(opening, "first", "left")
    whole = lambda c: F.concat(F.coalesce(F.slice(f"{c}_0", F.lit(1), F.col("h")), F.expr("cast(array() as array<bigint>)")), F.slice(c, F.col("h") + 1, F.size(c))).alias(c)
    return out.select("conv_id", whole("ids"), whole("sizes"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = encoded(table(spark, sf_dir, "conversations"))
    convs = materialize(sequences(turns), "conversations")
    return trie(rebuilt(convs))


def trie_sql() -> str:
    """The same in DuckDB, by all prefixes of all conversations."""
    table_of = "list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i))"
    return f"""
WITH t AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS seq
      FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
m AS MATERIALIZED (SELECT {table_of} AS crc),
h AS (SELECT conv_id, seq, xor(4294967295, list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT),
      lambda c, b: xor(crc[xor(c & 255, b) + 1], c >> 8), 4294967295)) % 9 AS h FROM t, m),
r AS (SELECT h.conv_id, list_concat(coalesce(f.seq[1:h], []), h.seq[h + 1:]) AS seq FROM h LEFT JOIN t f ON f.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, len(seq) AS whole, unnest(range(0, len(seq) + 1)) AS depth, seq FROM r),
n AS (SELECT seq[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
      sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE whole = depth), '')) AS ends_sha256 FROM p GROUP BY ALL),
c AS (SELECT node[1:depth - 1] AS node, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
o AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * strlen(node[depth].text) ELSE 0 END AS own FROM n LEFT JOIN c USING (node, depth)),
a AS (SELECT node[1:up] AS node, up AS depth, sum(own) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM o) GROUP BY ALL)
SELECT o.conv_id, o.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, o.n_convs, o.n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, o.ends_sha256
FROM o JOIN a USING (node, depth) LEFT JOIN o u ON o.depth > 0 AND u.depth = o.depth - 1 AND u.node = o.node[1:o.depth - 1]
"""
