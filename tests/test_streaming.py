"""The streaming forms against their batch forms, over the events table as a file stream."""

from pyspark.sql import functions as F

from brindle.streaming import limits

SF = "/root/testdata/sf0.001"


def run(spark, tmp_path, build, mode, name):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    batch.filter("event_id < 500").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    batch.filter("event_id >= 500").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = build(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return batch, spark.table(name)


def test_windowed_counts(spark, tmp_path):
    batch, out = run(spark, tmp_path, lambda s: limits.windowed_counts(s, late="3650 days"), "complete", "hours")
    want = limits.timed(batch).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").count().collect()
    assert {(r.w.start, r.event_type): r["count"] for r in want} == {(r.w.start, r.event_type): r.n for r in out.collect()}


def test_first_seen(spark, tmp_path):
    batch, out = run(spark, tmp_path, lambda s: limits.first_seen(s, ["user_id"], "3650 days"), "append", "seen")
    assert out.count() == out.select("user_id").distinct().count() == batch.select("user_id").distinct().count()


def test_adaptive(spark, tmp_path):
    batch, out = run(spark, tmp_path, limits.adaptive, "update", "steps")
    last = out.groupBy("user_id").agg(F.max_by("interval", "n").alias("interval"), F.max("n").alias("n"))
    # the stream takes files in turn: compare with the fold where a user's events are in order of files
    got = {r.user_id: r.n for r in last.collect()}
    assert got == {r.user_id: r.n for r in limits.adaptive_batch(batch).collect()}
    assert all(1.0 <= r.interval <= 60.0 for r in last.collect())
    assert limits.next_interval(1.0, True) == 2.0 and limits.next_interval(60.0, True) == 60.0 and limits.next_interval(1.0, False) == 1.0
