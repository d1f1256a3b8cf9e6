from datetime import datetime

from pyspark.sql import functions as F

from marlstone.operators import heat
from marlstone.streaming import heat_stream


def test_daily_pairs_equal_the_batch_operator(spark, tmp_path):
    rows = [(datetime(2024, 1, 1 + i % 3, i % 24), i % 4, i % 5) for i in range(60)]
    batch = spark.createDataFrame(rows, "ts timestamp, k int, actor int")
    for n in range(3):
        batch.where(F.col("actor") % 3 == n).write.parquet(str(tmp_path / "in" / f"p{n}"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in" / "*"))
    run = heat_stream.daily_pairs(stream).writeStream.outputMode("complete").format("memory").queryName("pairs").start()
    run.processAllAvailable()
    run.stop()
    got = {(r.day, r.k, r.n) for r in spark.table("pairs").groupBy("day", "k").agg(F.count(F.lit(1)).alias("n")).collect()}
    obs = batch.select("k", "actor", F.unix_date(F.to_date("ts")).alias("day"))
    assert got == {(r.day, r.k, r.n) for r in heat.daily_distinct(obs).collect()}


def test_replays_are_dropped(spark, tmp_path):
    rows = [("c", 1, s, d, datetime(2024, 1, 1, 0, s)) for s, d in ((1, "a"), (2, "b"), (2, "b"), (3, "c"), (1, "a"), (3, "other"))]
    schema = "crawler string, epoch long, sequence long, digest string, ts timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    run = heat_stream.exactly_once(stream).writeStream.outputMode("append").format("memory").queryName("once").start()
    run.processAllAvailable()
    run.stop()
    assert sorted((r.sequence, r.digest) for r in spark.table("once").collect()) == [(1, "a"), (2, "b"), (3, "c"), (3, "other")]


def test_sink_writes_a_replayed_batch_once(spark, tmp_path):
    write = heat_stream.merge_sink(str(tmp_path / "out"), ["a"])
    df = spark.createDataFrame([(1,), (1,), (2,)], "a int")
    write(df, 0)
    write(df, 0)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def _counts(spark, tmp_path, made, name):
    """Rows of a stream operator over hours of observations and a last row that closes all windows."""
    rows = [(datetime(2024, 1, 1, i % 6, i % 60), i % 3, i * 7 % 5) for i in range(120)]
    schema = "ts timestamp, k int, actor int"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in" / "p0"))
    spark.createDataFrame([(datetime(2024, 1, 9), 9, 9)], schema).write.parquet(str(tmp_path / "in" / "p1"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    run = made(stream).writeStream.outputMode("append").format("memory").queryName(name).start()
    run.processAllAvailable()
    run.stop()
    return rows, [r for r in spark.table(name).collect() if r.k != 9]


def test_hourly_counts_are_exact(spark, tmp_path):
    rows, got = _counts(spark, tmp_path, heat_stream.hourly_counts, "hourly")
    want = {(h, k): len({a for t, kk, a in rows if t.hour == h and kk == k}) for h in range(6) for k in range(3)}
    assert {(r.w.start.hour, r.k): r.n for r in got} == {x: n for x, n in want.items() if n}


def test_rolling_counts_are_exact(spark, tmp_path):
    rows, got = _counts(spark, tmp_path, lambda s: heat_stream.rolling_counts(s, 3), "rolling")
    want = {}
    for end in range(1, 9):
        for k in range(3):
            if n := len({a for t, kk, a in rows if end - 3 <= t.hour < end and kk == k}):
                want[datetime(2024, 1, 1, end), k] = n
    assert {(r.w.end, r.k): r.n for r in got} == want
