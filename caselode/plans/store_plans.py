"""Stores that change: incremental indexes, versioned tables, sealed outputs, fingerprints, archives."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import html as H
from ..operators import identity, merkle, search, sinks, staleness
from ..operators import requests as asking
from ..operators.search_index import SearchIndex
from ..operators.walk import Kind, Relation, reason_counts, verdicts, walk
from ..session import ship
from ..sources import archives, footers, windows
from ..sources.log import listing
from ..sources.sealed import sidecars, write_sealed
from ..sources.versions import Tables
from ..storage import drop_path, materialize, scratch_path
from .registry import query

NEEDLE = "555-"


@query(
    "d17_incremental_search",
    f"""SELECT doc_id, concat_ws(',', CASE WHEN contains(text, '{NEEDLE}') THEN 'text' END, CASE WHEN contains(source, '{NEEDLE}') THEN 'source' END) AS matched, 2 AS segments,
               (SELECT count(*) FROM documents WHERE lang <> 'en')::BIGINT AS indexed_last
        FROM documents WHERE contains(text, '{NEEDLE}') OR contains(source, '{NEEDLE}')""",
)
def _(t):
    """Documents come in two parts; the second adds a segment of its own rows to the index of the first."""
    docs, path = t.documents.select("doc_id", "text", "source", "lang"), scratch_path(t.documents.sparkSession, "growing")
    docs.where("lang = 'en'").write.parquet(path)
    first = SearchIndex(docs.sparkSession.read.parquet(path), "doc_id", ["text", "source"])
    first.build()
    docs.where("lang <> 'en'").write.mode("append").parquet(path)
    index = SearchIndex(docs.sparkSession.read.parquet(path), "doc_id", ["text", "source"])
    old = {s["name"] for s in index.segments}
    index.build()
    last = sum(s["rows"] for s in index.segments if s["name"] not in old)
    hits = index.search(NEEDLE).select(F.col("key").alias("doc_id"), F.array_join("matched_columns", ",").alias("matched"))
    return hits.select("*", F.lit(len(index.segments)).alias("segments"), F.lit(last).cast("bigint").alias("indexed_last"))


@query(
    "d17_changed_sources",
    f"SELECT doc_id, false AS stale FROM documents WHERE lang = 'en' AND contains(text, '{NEEDLE}')",
)
def _(t):
    """After a table's other languages were taken out of it, the index finds what a scan finds, by tombstones alone."""
    spark, path = t.documents.sparkSession, scratch_path(t.documents.sparkSession, "shrinking")
    docs = t.documents.select("doc_id", "text", "lang")
    docs.where("lang = 'en'").write.parquet(path)
    own = listing(spark, path)
    docs.where("not lang <=> 'en'").write.mode("append").parquet(path)
    SearchIndex(spark.read.parquet(path), "doc_id", ["text"], name="shrinking").build()
    for file in listing(spark, path).keys() - own.keys():
        drop_path(spark, f"{path}/{file}")
    left = spark.read.parquet(path)
    index = SearchIndex(left, "doc_id", ["text"], name="shrinking")  # the same folder, so the index that was built; it is ready
    found = index.search(NEEDLE).select(F.col("key").alias("doc_id"))
    scan = search.search(left, NEEDLE, columns=["text"]).select("doc_id", F.lit(True).alias("there"))
    # the rows are the index's own: with those that only the scan finds, what the index lost would not show
    return found.join(scan, "doc_id", "left").select("doc_id", F.col("there").isNull().alias("stale"))


@query(
    "r14_pinned_tables",
    """WITH old AS (SELECT 1::BIGINT AS version, o_orderpriority, count(DISTINCT o_orderkey) AS orders, sum(l_quantity) AS quantity
                    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
            new AS (SELECT 2::BIGINT AS version, '9-' || o_orderpriority AS o_orderpriority, count(DISTINCT o_orderkey) AS orders, sum(l_quantity) AS quantity
                    FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag <> 'R' GROUP BY ALL)
       SELECT * FROM old UNION ALL SELECT * FROM new""",
)
def _(t):
    """A reader that pinned two tables before the next version was published, beside one that came after."""
    spark = t.orders.sparkSession
    store = Tables(spark, scratch_path(spark, "versions"))
    orders, lines = t.orders.select("o_orderkey", "o_orderpriority"), t.lineitem.select("l_orderkey", "l_quantity", "l_returnflag")
    first = store.change()
    first.replace("orders", orders)
    first.replace("lineitem", lines)
    first.publish()
    pinned = store.pin()
    second = store.change()
    second.replace("orders", orders.withColumn("o_orderpriority", F.concat(F.lit("9-"), "o_orderpriority")))
    second.replace("lineitem", lines.where("l_returnflag <> 'R'"))
    second.publish()

    def summed(of):
        j = of.table("orders").join(of.table("lineitem"), F.expr("o_orderkey = l_orderkey"))
        out = j.groupBy("o_orderpriority").agg(F.countDistinct("o_orderkey").alias("orders"), F.sum("l_quantity").alias("quantity"))
        return out.select(F.lit(of.version).cast("bigint").alias("version"), "*")

    return summed(pinned).unionByName(summed(store.pin()))


@query(
    "r14_changed_rows",
    """SELECT l_returnflag, change, count(*) AS rows FROM (
         SELECT l_returnflag, 'REMOVED' AS change FROM lineitem WHERE l_returnflag = 'R' UNION ALL
         SELECT 'R', 'ADDED' FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25) GROUP BY ALL""",
)
def _(t):
    """What two versions differ in; the parts that both hold are not read."""
    spark = t.lineitem.sparkSession
    store = Tables(spark, scratch_path(spark, "versions"))
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    first = store.change()
    first.replace("kept", lines.where("l_returnflag <> 'R'"))
    first.append("kept", lines.where("l_returnflag = 'R'"))
    first.publish()
    second = store.change()
    second.replace("kept", lines.where("l_returnflag <> 'R'"))
    second.append("kept", lines.where("l_returnflag = 'R' and l_quantity > 25").withColumn("l_quantity", -F.col("l_quantity")))
    second.publish()
    return store.changed_rows("kept", 1).groupBy("l_returnflag", "change").agg(F.count("*").alias("rows"))


#: What stands at an order's nodes in `d60_reference_walk`.
BROKEN = {"part": "p_partkey % 17 <> 0", "supplier": "s_acctbal >= 0", "line": "l_quantity <= 49"}


#: What tells lines apart: order and number do not.
_LINE_ID = "l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)"


def _order_graph(t):
    """Orders, their lines, the lines' parts and each part's first supplier; some parts are not there, some nodes break a rule."""
    line = F.expr(f"concat_ws('-', {_LINE_ID})")
    kinds = {
        "order": Kind(t.orders.select(F.col("o_orderkey").alias("id"))),
        "line": Kind(t.lineitem.select(line.alias("id"), "l_quantity"), {"LARGE_QUANTITY": F.expr(BROKEN["line"])}),
        "part": Kind(t.part.where(BROKEN["part"]).select(F.col("p_partkey").alias("id"))),
        "supplier": Kind(t.supplier.select(F.col("s_suppkey").alias("id"), "s_acctbal"), {"NEGATIVE_BALANCE": F.expr(BROKEN["supplier"])}),
    }
    first = t.lineitem.groupBy("l_partkey").agg(F.min("l_suppkey").alias("l_suppkey"))
    links = lambda df, a, b: df.select(a.alias("source"), b.alias("target"))
    relations = [
        Relation("lines", "order", "line", links(t.lineitem, F.col("l_orderkey"), line), required=True),
        Relation("part", "line", "part", links(t.lineitem, line, F.col("l_partkey")), required=True),
        Relation("supplier", "part", "supplier", links(first, F.col("l_partkey"), F.col("l_suppkey"))),
    ]
    return walk(kinds, relations, "order")


_ORDER_GRAPH = f"""
WITH f AS (SELECT l_partkey AS p, min(l_suppkey) AS s FROM lineitem GROUP BY 1),
l AS (SELECT l_orderkey AS o, 'line' AS kind, concat_ws('-', {_LINE_ID}) AS id, 1 AS depth, CASE WHEN NOT {BROKEN["line"]} THEN 'LARGE_QUANTITY' END AS why FROM lineitem),
p AS (SELECT DISTINCT l_orderkey AS o, 'part' AS kind, l_partkey::VARCHAR AS id, 2 AS depth, CASE WHEN p_partkey IS NULL THEN 'MISSING:part' END AS why
      FROM lineitem LEFT JOIN (SELECT * FROM part WHERE {BROKEN["part"]}) ON l_partkey = p_partkey),
s AS (SELECT DISTINCT o, 'supplier' AS kind, f.s::VARCHAR AS id, 3 AS depth, CASE WHEN s_suppkey IS NULL THEN 'MISSING:supplier' WHEN NOT {BROKEN["supplier"]} THEN 'NEGATIVE_BALANCE' END AS why
      FROM p JOIN f ON p.id = f.p::VARCHAR LEFT JOIN supplier ON s_suppkey = f.s WHERE why IS NULL),
r AS (SELECT o_orderkey AS o, 'order' AS kind, o_orderkey::VARCHAR AS id, 0 AS depth, CASE WHEN o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) THEN 'NONE:lines' END AS why FROM orders),
every AS (SELECT * FROM r UNION ALL SELECT * FROM l UNION ALL SELECT * FROM p UNION ALL SELECT * FROM s)
"""


@query(
    "d60_reference_walk",
    _ORDER_GRAPH
    + """SELECT o::VARCHAR AS root, count(*) FILTER (WHERE why IS NULL OR why NOT LIKE 'MISSING:%') AS nodes, max(depth)::INT AS deepest, count(why) AS broken,
                coalesce(string_agg(DISTINCT why, ',' ORDER BY why), '') AS reasons FROM every GROUP BY o""",
)
def _(t):
    return verdicts(_order_graph(t)).withColumn("reasons", F.array_join("reasons", ","))


@query("d60_reason_counts", _ORDER_GRAPH + "SELECT kind, why AS reason, count(DISTINCT o) AS roots, count(DISTINCT id) AS nodes FROM every WHERE why IS NOT NULL GROUP BY ALL")
def _(t):
    return reason_counts(_order_graph(t))


@query(
    "c5_case_references",
    """WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, text FROM conversations),
            c AS (SELECT conv_id, max(n) AS last, CASE WHEN conv_id % 10 = 3 THEN least(max(n), 2) ELSE max(n) END AS upto FROM t GROUP BY conv_id),
            n AS (SELECT t.conv_id, CASE WHEN n = upto AND upto < last THEN 'MISSING:next' WHEN length(text) < 40 THEN 'SHORT' END AS why, n, upto, last FROM t JOIN c USING (conv_id) WHERE n <= upto)
       SELECT conv_id::VARCHAR AS root, 1 + count(*) FILTER (WHERE why IS NULL OR why <> 'MISSING:next') AS nodes, count(why) AS broken,
              coalesce(string_agg(DISTINCT why, ',' ORDER BY why), '') AS reasons FROM n GROUP BY conv_id""",
)
def _(t):
    """Conversations lead to their first turn and turns to the next, at any depth; some second turns are gone."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    of = lambda n: F.concat_ws("-", "conv_id", n)
    turns = t.conversations.withColumn("n", F.row_number().over(order)).withColumn("last", F.max("n").over(Window.partitionBy("conv_id")))
    there = turns.where("not (conv_id % 10 = 3 and n = 2 and last > 2)").select(of("n").alias("id"), "text")
    kinds = {"case": Kind(t.conversations.select(F.col("conv_id").alias("id")).distinct()), "turn": Kind(there, {"SHORT": F.length("text") >= 40})}
    relations = [
        Relation("first", "case", "turn", turns.where("n = 1").select(F.col("conv_id").alias("source"), of("n").alias("target")), required=True),
        Relation("next", "turn", "turn", turns.where("n < last").select(of("n").alias("source"), of(F.col("n") + 1).alias("target"))),
    ]
    return verdicts(walk(kinds, relations, "case")).select("root", "nodes", "broken", F.array_join("reasons", ",").alias("reasons"))


@query(
    "d38_coverage_sidecars",
    """SELECT 'orders' AS "table", 'COMPLETE' AS status, '' AS reasons, count(*) AS rows, round(sum(o_totalprice), 1) AS total, 1::BIGINT AS input_files FROM orders UNION ALL
       SELECT 'lineitem', CASE WHEN count(*) FILTER (WHERE l_discount > 0.09) > 0 THEN 'INCOMPLETE' ELSE 'COMPLETE' END, CASE WHEN count(*) FILTER (WHERE l_discount > 0.09) > 0 THEN 'HIGH_DISCOUNT' ELSE '' END, count(*), round(sum(l_extendedprice), 1), 1 FROM lineitem UNION ALL
       SELECT 'customer', 'COMPLETE', '', count(*), round(sum(c_acctbal), 1), 1 FROM customer""",
)
def _(t):
    """A sidecar a table, from the pass that writes it."""
    spark, path = t.orders.sparkSession, scratch_path(t.orders.sparkSession, "sealed")
    of = {"orders": ("o_totalprice", {}), "lineitem": ("l_extendedprice", {"HIGH_DISCOUNT": F.count_if(F.col("l_discount") > 0.09)}), "customer": ("c_acctbal", {})}
    seals = [write_sealed(getattr(t, name), f"{path}/{name}", name, {"total": F.sum(column)}, complete) for name, (column, complete) in of.items()]
    rows = sidecars(spark, seals)
    return rows.select("table", "status", F.array_join("reasons", ",").alias("reasons"), "rows", F.round(F.col("metrics")["total"], 1).alias("total"), "input_files")


#: The second version of lineitem in `d63`.
SECOND = "CASE WHEN l_orderkey % 997 = 0 THEN l_quantity + 1 ELSE l_quantity END"


LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def _two_versions(t):
    spark, path = t.lineitem.sparkSession, scratch_path(t.lineitem.sparkSession, "fingerprinted")
    keys, lines = [*LINE], t.lineitem.select(*LINE, "l_quantity", "l_shipdate")
    second = lines.where("l_orderkey % 1009 <> 1").withColumn("l_quantity", F.expr(SECOND))
    more = lines.where("l_orderkey % 1013 = 2").withColumn("l_orderkey", -F.col("l_orderkey"))
    return merkle.fingerprint(lines, keys, f"{path}/first"), merkle.fingerprint(second.unionByName(more), keys, f"{path}/second")


@query(
    "d63_differing_rows",
    f"""WITH a AS (SELECT {", ".join(LINE)}, l_quantity FROM lineitem),
             b AS (SELECT {", ".join(LINE)}, {SECOND} AS l_quantity FROM lineitem WHERE l_orderkey % 1009 <> 1 UNION ALL SELECT -l_orderkey, {", ".join(LINE[1:])}, l_quantity FROM lineitem WHERE l_orderkey % 1013 = 2)
        SELECT {", ".join(LINE)}, CASE WHEN b.l_quantity IS NULL THEN 'REMOVED' WHEN a.l_quantity IS NULL THEN 'ADDED' ELSE 'CHANGED' END AS change, a.l_quantity AS was, b.l_quantity AS is_now
        FROM a FULL JOIN b USING ({", ".join(LINE)}) WHERE a.l_quantity IS DISTINCT FROM b.l_quantity""",
)
def _(t):
    out = merkle.differing_rows(*_two_versions(t))
    return out.select(*LINE, "change", F.get("before", F.lit(0))["l_quantity"].alias("was"), F.get("after", F.lit(0))["l_quantity"].alias("is_now"))


@query(
    "d63_cross_validation",
    """SELECT count(*) AS audited, count(*) FILTER (WHERE l_orderkey % 1009 <> 1) + count(*) FILTER (WHERE l_orderkey % 1013 = 2) AS candidates, count(*) FILTER (WHERE l_orderkey % 1013 = 2) AS added,
              count(*) FILTER (WHERE l_orderkey % 1009 = 1) AS removed, count(*) FILTER (WHERE l_orderkey % 997 = 0 AND l_orderkey % 1009 <> 1) AS changed, 0::BIGINT AS count, false AS equal FROM lineitem""",
)
def _(t):
    return merkle.cross_validate(*_two_versions(t)).withColumn("audited", F.col("audited").cast("bigint")).withColumn("candidates", F.col("candidates").cast("bigint"))


@query(
    "d64_archive_blobs",
    """WITH d AS (SELECT doc_id, sha256(text) AS h, strlen(text) AS size FROM documents),
            m AS (SELECT CASE WHEN doc_id % 11 = 0 THEN sha256('changed ' || doc_id) ELSE sha256(text) END AS h, sha256(text) AS claimed FROM documents WHERE doc_id % 7 <> 0),
            w AS (SELECT DISTINCT h FROM d), f AS (SELECT h, count(*) AS places FROM m GROUP BY h)
       SELECT h AS sha256, CASE WHEN places IS NOT NULL THEN 'RESTORABLE' WHEN h IN (SELECT claimed FROM m) THEN 'CHANGED' ELSE 'MISSING' END AS status, coalesce(places, 0) AS places FROM w LEFT JOIN f USING (h)
       UNION ALL SELECT h, 'UNKNOWN', places FROM f WHERE h NOT IN (SELECT h FROM w)""",
)
def _(t):
    """Texts against archives that hold most of them, some with other content under their name."""
    docs = t.documents.select("doc_id", "text", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("size_bytes"))
    own = docs.where("doc_id % 7 <> 0").withColumn("body", F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("changed "), "doc_id")).otherwise(F.col("text")))
    made = archives.write_tars(own, "sha256", "body", scratch_path(docs.sparkSession, "tars"))
    paths = [r["archive"] for r in materialize(made, "archives").collect()]  # a path a task
    return archives.reconcile(archives.tar_members(docs.sparkSession, paths), docs.select("sha256", "size_bytes"))


# -- footers ---------------------------------------------------------------------------


def _clustered(t):
    """Orders in eight files of ascending keys."""
    spark, path = t.orders.sparkSession, scratch_path(t.orders.sparkSession, "clustered")
    t.orders.select("o_orderkey", "o_custkey", "o_orderpriority").repartitionByRange(8, "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(path)
    return spark.read.parquet(path)


@query(
    "r6_zone_map",
    """SELECT 'o_orderkey' AS "column", count(*)::BIGINT AS rows, 0::BIGINT AS nulls, min(o_orderkey)::VARCHAR AS low, max(o_orderkey)::VARCHAR AS high FROM orders UNION ALL
       SELECT 'o_custkey', count(*), 0, min(o_custkey)::VARCHAR, max(o_custkey)::VARCHAR FROM orders UNION ALL SELECT 'o_orderpriority', count(*), 0, min(o_orderpriority), max(o_orderpriority) FROM orders""",
)
def _(t):
    zones = footers.zone_map(_clustered(t))
    number = F.when(F.col("column") != "o_orderpriority", F.col("low").cast("bigint")), F.when(F.col("column") != "o_orderpriority", F.col("high").cast("bigint"))
    out = zones.groupBy("column").agg(F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.coalesce(F.min(number[0]).cast("string"), F.min("low")).alias("low"), F.coalesce(F.max(number[1]).cast("string"), F.max("high")).alias("high"))
    return out.select("column", "rows", "nulls", "low", "high")


@query("r3_zone_lookup", "SELECT *, 1::BIGINT AS row_groups FROM (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) - 7 FROM orders))")
def _(t):
    """Of eight files one is named before anything is read."""
    df = _clustered(t)
    wanted = t.orders.agg(F.max("o_orderkey")).first()[0] - 7
    return footers.zone_lookup(df, footers.zone_map(df, ["o_orderkey"]), "o_orderkey", wanted).select("o_orderkey", "o_custkey", "row_groups")


@query("r6_footer_columns", "SELECT count(DISTINCT column_name)::BIGINT AS columns FROM (SELECT unnest(['doc_id', 'text', 'lang', 'source', 'n_chars']) AS column_name)")
def _(t):
    """The columns that Spark's own footer entry names, of documents written again."""
    spark, path = t.documents.sparkSession, scratch_path(t.documents.sparkSession, "footers")
    t.documents.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(path)
    schema = footers.footer_value(spark.read.parquet(path), "org.apache.spark.sql.parquet.row.metadata")
    return spark.createDataFrame([(len(schema["fields"]),)], "columns bigint")


# -- listings by windows ------------------------------------------------------------------

DAYS, PAGE = 7, 50


def _served(t) -> dict:
    """Events as pages of a listing by weeks, a line a page, many to a file; the options that read them."""
    spark, path = t.events.sparkSession, scratch_path(t.events.sparkSession, "pages")
    first, last = t.events.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    week = F.date_add(F.lit(first), (F.floor(F.datediff(F.to_date("ts"), F.lit(first)) / DAYS) * DAYS).cast("int"))
    row = F.struct(F.col("event_id").alias("id"), F.date_format("ts", "yyyyMMdd").alias("day"), F.col("event_type").alias("kind"), "value")
    at = F.row_number().over(Window.partitionBy("week").orderBy("event_id"))
    rows = t.events.withColumn("week", week).select("week", row.alias("row"), at.alias("at"), F.count("*").over(Window.partitionBy("week")).alias("total"))
    pages = rows.groupBy("week", F.ceil(F.col("at") / PAGE).cast("int").alias("page"), "total").agg(F.array_sort(F.collect_list(F.struct("at", "row"))).alias("x"))  # PAGE rows
    body = F.to_json(F.struct(F.struct("total", F.col("x.row").alias("items")).alias("list")))
    bundled = pages.select(body.alias("value"), "week", "page", F.floor((F.col("page") - 1) / windows.BUNDLE).cast("int").alias("bundle"))
    bundled = bundled.repartition("week", "bundle").sortWithinPartitions("week", "bundle", "page")  # a task a bundle, so a file
    bundled.drop("page").write.partitionBy("week", "bundle").text(path)
    url = f"{path}/week={{first}}/page={{page}}"
    return {"fetch": "caselode.sources.windows:bundled_pages", "url": url, "from": first.isoformat(), "to": last.isoformat(), "days": str(DAYS), "root": "list", "total": "total", "items": "items", "id": "id", "day": "day"}


_EVENTS = "SELECT event_id::VARCHAR AS id, ts::DATE::VARCHAR AS day, event_type AS kind FROM events"


@query("r17_windowed_listing", _EVENTS)
def _(t):
    options, spark = _served(t), t.events.sparkSession
    spark.dataSource.register(windows.WindowedListing)
    return spark.read.format("windowed_listing").options(**options).load().select("id", F.col("day").cast("string").alias("day"), F.get_json_object("row", "$.kind").alias("kind"))


@query("r15_resumed_listing", _EVENTS)
def _(t):
    """The same as a stream that ends after some windows and is started again: each row once."""
    options, spark = _served(t), t.events.sparkSession
    spark.dataSource.register(windows.WindowedListing)
    path = scratch_path(spark, "listed")
    every = windows.windows(*map(windows.date.fromisoformat, (options["from"], options["to"])), DAYS)
    for last in (every[len(every) // 2].last, every[-1].last):
        rows = spark.readStream.format("windowed_listing").options(**options | {"to": last.isoformat()}).load()
        rows.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/rows").awaitTermination()
    return spark.read.schema(windows.SCHEMA).parquet(f"{path}/rows").select("id", F.col("day").cast("string").alias("day"), F.get_json_object("row", "$.kind").alias("kind"))


# -- what a change makes stale -----------------------------------------------------------


def _turn_graph(t):
    """Turns that saw the turn before; in some conversations the first one has changed since."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = t.conversations.withColumn("n", F.row_number().over(order)).withColumn("before", F.lag("text").over(order))
    of = lambda n: F.concat_ws("-", "conv_id", n)
    items = turns.select(of("n").alias("id"), F.sha2("text", 256).alias("hash"), "conv_id", "n")
    seen = F.when((F.col("conv_id") % 10 == 3) & (F.col("n") == 2), F.sha2(F.concat(F.lit("old "), "before"), 256)).otherwise(F.sha2("before", 256))
    links = turns.where("n > 1").select(of("n").alias("id"), of(F.col("n") - 1).alias("upstream"), seen.alias("seen"))
    return items, links


_TURNS = "SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations"


@query("c6_stale_turns", f"SELECT conv_id || '-' || n AS id, CASE WHEN conv_id % 10 = 3 AND n > 1 THEN 'STALE' ELSE 'FRESH' END AS state, CASE WHEN conv_id % 10 = 3 AND n > 1 THEN n - 2 END::INT AS depth, (conv_id % 10 = 3 AND n = 2)::INT::BIGINT AS changed FROM ({_TURNS})")
def _(t):
    items, links = _turn_graph(t)
    return staleness.staleness(items, links)


@query(
    "c6_stale_gold",
    f"""SELECT conv_id || '-' || n AS id, NOT (length(text) < 40 OR n % 4 = 0 OR (conv_id % 10 = 3 AND n > 1)) AS gold,
               CASE WHEN n % 4 = 0 THEN 'REVISION_CHANGED' WHEN conv_id % 10 = 3 AND n > 1 THEN 'UPSTREAM_STALE' WHEN length(text) < 40 THEN 'NOT_PASSED' ELSE '' END AS reasons FROM ({_TURNS})""",
)
def _(t):
    """Reviews hold for the revision that they saw and as long as nothing upstream has changed."""
    items, links = _turn_graph(t)
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = t.conversations.withColumn("n", F.row_number().over(order))
    saw = F.when(F.col("n") % 4 == 0, "another").otherwise(F.sha2("text", 256))
    reviews = turns.select(F.concat_ws("-", "conv_id", "n").alias("id"), saw.alias("revision"), (F.length("text") >= 40).alias("passed"))
    out = staleness.gold(staleness.review_states(reviews, items, staleness.staleness(items, links)))
    return out.select("id", "gold", F.array_join("reasons", ",").alias("reasons"))


# -- one pass, several sinks; requests; candidates ----------------------------------------

_LINKS = "(length(html) - length(replace(html, '<a href=', ''))) // 8"


@query(
    "d36_corpus_inventory",
    f"""SELECT 'rows' AS sink, count(*)::BIGINT AS rows FROM pages UNION ALL SELECT 'links', sum({_LINKS})::BIGINT FROM pages UNION ALL SELECT 'errors', count(*) FILTER ({_LINKS} < 8)::BIGINT FROM pages""",
)
def _(t):
    """Rows, links and errors of pages from one pass over them, with the counts that were seen."""
    ship(t.pages.sparkSession)
    seen = t.pages.select("page_id", H.occurrences_udf("a")(F.col("html")).alias("links"), F.sha2("html", 256).alias("sha256"))
    links = F.transform("links", lambda x: F.struct(F.col("page_id"), x["order"].alias("order"), x["target"].alias("target")))
    few = F.when(F.size("links") < 8, F.struct("page_id", F.lit("FEW_LINKS").alias("code")))
    return sinks.write_sinks(seen, {"rows": F.struct("page_id", "sha256", F.size("links").alias("links")), "links": links, "errors": F.array_compact(F.array(few))}, scratch_path(t.pages.sparkSession, "sinks"))


def told(endpoint: str, params: str) -> str:
    """A transport for the queries: it gives back what was asked, and for some documents another language."""
    asked = json.loads(params)
    if asked["id"].endswith("13"):
        raise TimeoutError
    return json.dumps(asked | ({"lang": "xx"} if asked["id"].endswith("7") else {}))


@query(
    "d52_recovered_identities",
    """SELECT doc_id, CASE WHEN doc_id % 100 = 13 THEN 'REQUEST_FAILED' WHEN doc_id % 10 = 7 THEN 'IDENTITY_EVIDENCE_MISMATCH' ELSE 'RECOVERED' END AS state, CASE WHEN doc_id % 10 = 7 THEN 'lang' ELSE '' END AS mismatched,
              (SELECT count(*) FROM documents) AS asked, 0::BIGINT AS asked_again FROM documents""",
)
def _(t):
    """Identities from answers that are asked for once; the second run asks nothing."""
    spark = t.documents.sparkSession
    cache = Tables(spark, scratch_path(spark, "requests"))
    rows = t.documents.select("doc_id", "lang", "source", F.lit("detail").alias("endpoint"), F.create_map(F.lit("id"), F.col("doc_id").cast("string"), F.lit("lang"), "lang", F.lit("source"), "source").alias("params"))
    first, asked = asking.ask(rows, cache, "caselode.plans.store_plans:told")
    _, again = asking.ask(rows, cache, "caselode.plans.store_plans:told")
    answer = lambda k: F.get_json_object("answer", f"$.{k}")
    out = asking.recovered(first, {"lang": (F.col("lang"), answer("lang")), "source": (F.col("source"), answer("source"))})
    return out.select("doc_id", "state", F.array_join(F.coalesce("mismatched", F.array()), ",").alias("mismatched"), F.lit(asked).cast("bigint").alias("asked"), F.lit(again).cast("bigint").alias("asked_again"))


@query(
    "d42_identity_candidates",
    """SELECT doc_id AS block, doc_id AS representative, doc_id + 1000000000 AS id, 2::BIGINT AS copies, doc_id % 3 <> 0 AS same_day, greatest(length(text) // 3, length(text) - length(text) // 3 - 1)::INT AS common FROM documents WHERE length(text) > 0""",
)
def _(t):
    """Each text beside two copies of it with one character changed, as candidates of one identity."""
    ship(t.documents.sparkSession)
    p = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.left("text", p), F.lit("\uffff"), F.substr("text", p + 2))
    docs = t.documents.where("length(text) > 0").select("doc_id", "text", edited.alias("edited"), F.when(F.col("doc_id") % 3 == 0, 2).otherwise(1).alias("day"))
    row = lambda more, text, day: F.struct(F.col("doc_id").alias("block"), (F.col("doc_id") + more).alias("id"), F.col(text).alias("text"), day.alias("day"))
    # one beside the other: what shuffles them writes little for those that are like the one before
    rows = F.array(row(0, "text", F.lit(1)), row(1_000_000_000, "edited", F.col("day")), row(1_000_000_001, "edited", F.col("day")))
    return identity.audit(docs.select(F.inline(rows)), "block", "id", "text", "day").drop("share")
