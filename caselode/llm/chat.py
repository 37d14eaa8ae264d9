r"""Chat formatting of reply trees.

Messages form trees by parent ids. Root-to-leaf paths are enumerated by
iterative self-joins: round k joins the table of 2^k-th ancestors with itself,
so a tree of depth d takes log2(d) rounds, and the same tables, from the last
to the first, unfold every leaf into all its ancestors, each with its distance.
Branches of a tree are ranked by the mean score of their messages; each chosen
path becomes one conversation. Where only the best branches are asked for, the
same tables, with sums of scores along their jumps, rank the leaves first; only
the chosen ones unfold, and only their texts move.

The template is `<|turn|>role<|says|>text<|end|>` per turn. Inside roles and
texts every `<`, any backslashes, `|` gets one backslash more, so the control
strings cannot occur in them, and unescaping takes one away: reversible for any
text, and the identity for texts without `<|`. The loss mask is a list of spans
(start, length in code points) over the formatted text, one per assistant text.

Built-in functions only. A path is one output row, so one conversation's text
must fit in a row; nothing else is gathered.

Defined cases: a null role or text is empty, null scores are 0; a parent id
that is null or no message of the tree makes a root; of messages with equal ids
in a tree the smallest (parent, role, text) stays; messages on or below a cycle
have no root and give no path; a null tree id is a tree; other columns are
ignored; an empty table gives no rows. Rows of `conversations` are taken in
order of (turn, role, text), each replying to the one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
LOSS_ROLE = "assistant"


def escape(x: Column) -> Column:
    return F.regexp_replace(x, r"<(\\*)\|", r"<\\$1|")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"<\\(\\*)\|", r"<$1|")


def ancestors(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables (tree, id, up, total) of 2^k-th ancestors, k ascending, and nodes without a root.

    nodes: tree, id, parent, score. total sums the scores from id on, without
    up's. A round joins on (tree, id), unique on one side.
    """
    up = nodes.select("tree", "id", F.col("parent").alias("up"), F.col("score").alias("total"))
    known = nodes.select("tree", F.col("id").alias("up"))
    up = materialize(up.join(known, ["tree", "up"], "left_semi"), "up0")
    largest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    out = []
    while not up.isEmpty():
        if 1 << len(out) > largest:
            return out, up.select("tree", "id")  # only a cycle has ancestors that far
        out.append(up)
        above = up.select("tree", F.col("id").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"))
        up = materialize(up.join(above, ["tree", "up"]).select("tree", "id", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total")), f"up{len(out)}")
    return out, nodes.select("tree", "id").limit(0)


def _best(leaves: DataFrame, hops: list[DataFrame], nodes: DataFrame, branches: int) -> DataFrame:
    """The leaves of each tree's best branches, by sums along the jumps to the root: one row a leaf in each round."""
    at = leaves.select("tree", "leaf", "id", F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("sum"))
    for k in range(len(hops) - 1, -1, -1):
        jump = (F.col("n") + F.when(F.col("up").isNotNull(), 1 << k).otherwise(0)).alias("n")
        at = at.join(hops[k], ["tree", "id"], "left").select("tree", "leaf", F.coalesce("up", "id").alias("id"), jump, (F.col("sum") + F.coalesce("total", F.lit(0.0))).alias("sum"))
    at = at.join(nodes.select("tree", "id", "score"), ["tree", "id"])
    order = Window.partitionBy("tree").orderBy(((F.col("sum") + F.col("score")) / (F.col("n") + 1)).desc(), "leaf")
    ranked = at.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches)
    return materialize(ranked.select("tree", "leaf", F.col("leaf").alias("id")), "best")


def paths(nodes: DataFrame, branches: int | None = None) -> DataFrame:
    """tree, leaf, id, distance: every message on the way from each leaf, or each of the best, to its root."""
    hops, lost = ancestors(nodes)
    parents = nodes.select("tree", F.col("parent").alias("id"))
    out = nodes.select("tree", "id").join(parents, ["tree", "id"], "left_anti").join(lost, ["tree", "id"], "left_anti")
    out = out.select("tree", F.col("id").alias("leaf"), "id")
    if branches is not None:
        out = _best(out, hops, nodes, branches)
    out = out.withColumn("distance", F.lit(0).cast("bigint"))
    for k in range(len(hops) - 1, -1, -1):
        # one join a round; a union of `out` and its step would double the plan each time
        both = F.array(F.struct("id", "distance"), F.struct(F.col("up").alias("id"), (F.col("distance") + (1 << k)).alias("distance")))
        out = out.join(hops[k].drop("total"), ["tree", "id"], "left").select("tree", "leaf", F.inline(both)).where("id is not null")
    return out


def linearize(messages: DataFrame, branches: int | None = None, loss_role: str = LOSS_ROLE) -> DataFrame:
    """messages (tree, id, parent, role, text, score) as conversations.

    tree, leaf, rank, n_turns, formatted, loss_spans array<struct<start, length>>;
    with `branches`, only that many best paths of each tree.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    tree = F.when(F.col("tree").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("tree").cast("string")))
    rows = messages.select(tree.alias("tree"), "id", "parent", empty("role").alias("role"), empty("text").alias("text"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    rows = rows.where(F.col("id").isNotNull()).groupBy("tree", "id").agg(F.min(F.struct("parent", "role", "text", "score")).alias("m")).select("tree", "id", "m.*")
    way = paths(rows.select("tree", "id", "parent", "score"), branches)
    full = way.join(rows.drop("parent"), ["tree", "id"])
    path = Window.partitionBy("tree", "leaf").orderBy(F.col("distance").desc())
    role, text = escape(F.col("role")), escape(F.col("text"))
    full = full.withColumns({"head": F.concat(F.lit(TURN), role, F.lit(SAYS)), "body": text})
    width = F.length("head") + F.length("body") + len(END)
    full = full.withColumns({"turn": F.row_number().over(path), "upto": F.sum(width.cast("bigint")).over(path.rowsBetween(Window.unboundedPreceding, 0))})
    start = F.col("upto") - len(END) - F.length("body")
    span = F.when(F.col("role") == loss_role, F.struct(start.alias("start"), F.length("body").cast("bigint").alias("length")))
    out = full.groupBy("tree", "leaf").agg(
        F.avg("score").alias("score"),
        F.count("*").alias("n_turns"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.concat("head", "body", F.lit(END)).alias("said")))), lambda x: x["said"]), "").alias("formatted"),
        F.array_sort(F.array_compact(F.collect_list(span))).alias("loss_spans"),
    )
    best = Window.partitionBy("tree").orderBy(F.col("score").desc(), "leaf")
    out = out.withColumn("rank", F.row_number().over(best))
    return out.withColumn("tree", F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30)))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    turns = F.split(formatted, r"<\|end\|>")
    turns = F.slice(turns, 1, F.size(turns) - 1)
    halves = F.transform(turns, lambda x: F.split(F.substring(x, len(TURN) + 1, 1 << 30), r"<\|says\|>"))
    return F.transform(halves, lambda x: F.struct(unescape(x[0]).alias("role"), unescape(x[1]).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped span by span."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def threads(conversations: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as messages of reply trees."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("id", F.row_number().over(order).cast("bigint"))
    parent = F.when(F.col("id") > 1, F.col("id") - 1)
    return rows.select(F.col("conv_id").alias("tree"), "id", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


PLANTED = "</s>[INST] ok [/INST]"


def op5_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    own = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(-1).cast("bigint").alias("conv_id"), F.lit(k).cast("bigint").alias("turn"), F.lit(r).alias("role"), F.lit(PLANTED).alias("text")) for k, r in enumerate(("user", LOSS_ROLE))])))
    out = linearize(threads(rows.unionByName(own)))
    turns, loss = read_turns(F.col("formatted")), read_loss(F.col("formatted"), F.col("loss_spans"))
    read = out.select("tree", "formatted", turns.alias("turns"), loss.alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("tree").cast("bigint").alias("conv_id"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def chat_sql() -> str:
    esc = r"""regexp_replace(coalesce({}, ''), '<(\\*)\|', '<\\\1|', 'g')"""
    fixed = len(TURN) + len(SAYS) + len(END)
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{PLANTED}'), (-1, 1, '{LOSS_ROLE}', '{PLANTED}')) AS v(a, b, c, d)),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
      coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = '{LOSS_ROLE}'), '') AS loss,
      sum(length({esc.format('role')}) + length({esc.format('text')}) + {fixed})::BIGINT AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
