from pyspark.sql import functions as F

from caselode.streaming import ingest


def test_append_once(spark, tmp_path):
    a, b = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.range(5).select("id", F.lit("x").alias("v")).write.parquet(a)
    read = lambda: spark.readStream.schema("id long, v string").parquet(a)
    ingest.append_once(read(), b, ["id"], f"{tmp_path}/c1")
    spark.range(3, 8).select("id", F.lit("y").alias("v")).write.mode("append").parquet(a)
    ingest.append_once(read(), b, ["id"], f"{tmp_path}/c1")
    ingest.append_once(read(), b, ["id"], f"{tmp_path}/c2")  # replays everything
    assert sorted(r.id for r in spark.read.parquet(b).collect()) == list(range(8))


def test_dedup_and_windows(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:11:00")]
    spark.createDataFrame(rows, "k int, t string").select("k", F.col("t").cast("timestamp").alias("t")).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("k int, t timestamp").parquet(f"{tmp_path}/in")
    for name, df, mode in (("d", ingest.deduplicated(stream(), ["k"], "t", "1 hour"), "append"), ("w", ingest.windowed_counts(stream(), "t", "10 minutes", "1 hour"), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("d").count() == 2 and sorted(r.n for r in spark.table("w").collect()) == [1, 2]
