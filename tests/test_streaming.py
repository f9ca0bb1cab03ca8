from pyspark.sql import functions as F

from tidemark.streaming import live


def run(spark, df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def source(spark, folder, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/b={k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/in/*")


def test_counter_state_passes_batches(spark, tmp_path):
    schema = "id int, t bigint, n bigint"
    stream = source(spark, tmp_path, [[(1, 1, 10), (2, 1, 7)], [(1, 2, 15), (2, 2, 3)], [(1, 3, 15)]], schema)
    out = run(spark, live.counter_diff_stream(stream, ["id"], "n", "t"), "append", "diffs")
    got = sorted(tuple(r) for r in out.select("id", "ts", "delta", "reason").collect())
    assert [g[:2] for g in got] == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2)]
    assert sorted(r.reason or f"delta {r.delta}" for r in out.collect()) == ["delta 0", "delta 5", "first_point", "first_point", "reset"]


def test_windows_and_sessions(spark, tmp_path):
    rows = [[(k, f"2024-01-01 00:{m:02d}:00")] for k, m in ((1, 0), (1, 1), (1, 9), (1, 30), (1, 59))]
    stream = source(spark, tmp_path, rows, "k int, s string").withColumn("time", F.to_timestamp("s"))
    got = run(spark, live.tumbling(stream, "time", "5 minutes", ["k"], "1 minute", F.count("*").alias("n")), "complete", "tumble")
    assert sorted(r.n for r in got.collect()) == [1, 1, 1, 2]
    got = run(spark, live.sliding(stream, "time", "10 minutes", "5 minutes", ["k"], "1 minute", F.count("*").alias("n")), "complete", "slide")
    assert sum(r.n for r in got.collect()) == 10
    got = run(spark, live.sessions(stream, "time", "5 minutes", ["k"], "1 minute"), "complete", "sess")
    assert sorted(r.n for r in got.collect()) == [1, 1, 1, 2]


def test_segment_sink_can_be_repeated(spark, tmp_path):
    sink = live.segment_sink(str(tmp_path / "out"))
    sink(spark.range(3), 7)
    sink(spark.range(3), 7)
    sink(spark.range(0), 8)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("segment_id").count().collect()[0]["count"] == 3


def test_freshness(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', timestamp_ntz'2024-01-01 00:00:00'), ('b', timestamp_ntz'2024-01-01 11:59:00') AS t(k, t)")
    assert [r.stale for r in live.freshness(df, ["k"], "t", "2024-01-01 12:00:00", "1 hour").orderBy("k").collect()] == [True, False]
