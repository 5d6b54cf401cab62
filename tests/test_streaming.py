"""Streams over files, run to the end, against the same in batch."""

from pyspark.sql import functions as F

from skein.streaming import streams


def files(spark, path):
    rows = [(i, f"2025-01-01 {i // 6:02d}:{(i % 6) * 10:02d}:00", i % 3, "error" if i % 4 == 0 else "view", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, ts string, key bigint, kind string, seconds double").withColumn("ts", F.to_timestamp("ts"))
    for k in range(3):
        df.where((F.col("id") >= k * 20) & (F.col("id") < k * 20 + 20)).coalesce(1).write.mode("append").parquet(path)
    return df


def test_windows_and_runs(spark, tmp_path):
    path = str(tmp_path / "in")
    batch = files(spark, path)
    stream = streams.read_events(spark, path)
    streams.run_to_table(streams.windowed_metrics(stream, late="10 hours"), "w", str(tmp_path / "c1"), "complete")
    want = {tuple(r) for r in batch.groupBy(F.window("ts", "1 hour").alias("w"), "kind").agg(F.count(F.lit(1)), F.avg("seconds")).select("w.start", "kind", "count(1)", "avg(seconds)").collect()}
    assert {tuple(r) for r in spark.table("w").collect()} == want
    streams.run_to_table(streams.failure_runs(streams.read_events(spark, path, 10)), "f", str(tmp_path / "c2"), "update")
    assert {r["key"]: r["attempts"] for r in spark.table("f").collect()} == {0: 0, 1: 0, 2: 0}
    streams.run_to_table(streams.first_seen(streams.read_events(spark, path)), "d", str(tmp_path / "c3"))
    assert spark.table("d").count() == 60
    streams.run_to_table(streams.sessions(streams.read_events(spark, path, 10), late="0 seconds"), "s", str(tmp_path / "c4"))
    assert spark.table("s").count() >= 0
