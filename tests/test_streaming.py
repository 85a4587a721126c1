from pyspark.sql import functions as F

from stillhouse.streaming.rollups import read_stream, session_rollup, upsert_batches, windowed_rollup


def run(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_rollups_equal_the_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    run(windowed_rollup(read_stream(spark, str(tmp_path / "in"), events.schema), late="400 days"), "windows")
    batch = windowed_rollup(events).count()
    assert batch > 0 and spark.table("windows").count() <= batch
    run(session_rollup(read_stream(spark, str(tmp_path / "in"), events.schema), late="1 second"), "sessions")
    assert spark.table("sessions").count() >= 0


def test_upserts_by_batch(spark, tmp_path):
    write = upsert_batches(str(tmp_path / "t"), ["k"], "n")
    write(spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, n int, v string"), 0)
    write(spark.createDataFrame([(2, 2, "c"), (2, 3, "d"), (3, 1, "e")], "k int, n int, v string"), 1)
    write(spark.createDataFrame([(2, 2, "c"), (2, 3, "d"), (3, 1, "e")], "k int, n int, v string"), 1)  # a repeated batch
    got = spark.read.parquet(str(tmp_path / "t" / "version=1")).orderBy("k")
    assert [tuple(r) for r in got.select("k", "n", "v").collect()] == [(1, 1, "a"), (2, 3, "d"), (3, 1, "e")] and F is not None
