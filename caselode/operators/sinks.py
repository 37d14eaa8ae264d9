"""One pass into several outputs, with counts that must agree.

Each row unfolds into (sink, JSON) rows, which are written at once, a folder a
sink; the counts are observed in that pass and compared with what lies there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.log import write_once
from ..sources.tables import SourceError


def write_sinks(df: DataFrame, sinks: dict[str, Column], path: str) -> DataFrame:
    """Write each sink's structs (a struct a row, or an array of them) below path; sink, rows of each.

    Fields keep their nulls. The manifest <path>/_sinks.json is made once the counts agree.
    """
    spark, seen = df.sparkSession, Observation()
    options = {"ignoreNullFields": "false"}
    kinds = df.select(*[c.alias(n) for n, c in sinks.items()]).schema

    def bodies(name: str) -> Column:
        own = sinks[name] if kinds[name].dataType.typeName() == "array" else F.array(sinks[name])
        one = F.transform(own, lambda x: F.struct(F.lit(name).alias("sink"), F.to_json(x, options).alias("value")))
        return F.coalesce(one, F.expr("cast(array() as array<struct<sink:string,value:string>>)"))

    rows = df.select(F.inline(F.concat(*map(bodies, sinks)))).where("value is not null")
    counted = rows.observe(seen, *[F.count_if(F.col("sink") == n).alias(n) for n in sinks])
    counted.write.mode("errorifexists").partitionBy("sink").option("compression", "gzip").text(path)
    lies = {r["sink"]: r["count"] for r in spark.read.schema("value string, sink string").text(path).groupBy("sink").count().collect()}
    got = seen.get
    if any(got[n] != lies.get(n, 0) for n in sinks):
        raise SourceError("SINK_COUNT_MISMATCH")
    write_once(spark, f"{path}/_sinks.json", got)
    return spark.createDataFrame(sorted(got.items()), "sink string, rows bigint")


def read_sink(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """The rows of one sink; none if it got none."""
    from ..sources.log import exists

    there = f"{path}/sink={name}"
    return spark.read.schema(schema).json(there) if exists(spark, there) else spark.createDataFrame([], schema)
