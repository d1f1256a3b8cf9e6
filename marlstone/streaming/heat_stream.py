"""Streaming forms of the heat operators. The batch operators are their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hourly_pairs(stream: DataFrame, late: str = "30 minutes") -> DataFrame:
    """Exact (hour, k, actor) of observations (ts, k, actor), each once; an hour's state goes when the watermark has passed it."""
    hour = F.window("ts", "1 hour").alias("w")
    seen = stream.withWatermark("ts", late).groupBy(hour, "k", "actor").agg(F.count(F.lit(1)).alias("hits"))
    return seen.select(F.floor(F.unix_seconds("w.start") / 3600).alias("hour"), "k", "actor", "hits")


def hourly_counts(stream: DataFrame, late: str = "30 minutes") -> DataFrame:
    """(w, k, n) of observations (ts, k, actor): exact distinct actors of each closed hour, by two windowed aggregations in turn."""
    once = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "k", "actor").agg(F.count(F.lit(1)).alias("hits"))
    return once.groupBy(F.window("w", "1 hour").alias("w"), "k").agg(F.count(F.lit(1)).alias("n"))


def rolling_counts(stream: DataFrame, hours: int = 24, late: str = "30 minutes") -> DataFrame:
    """(w, k, n): exact distinct actors of each window of closed hours, one window an hour; late rows are left out by the watermark."""
    w = F.window("ts", f"{hours} hours", "1 hour").alias("w")
    once = stream.withWatermark("ts", late).groupBy(w, "k", "actor").agg(F.count(F.lit(1)).alias("hits"))
    # A window is known by the hour that it ends with.
    counts = once.groupBy(F.window(F.window_time("w"), "1 hour").alias("last"), "k").agg(F.count(F.lit(1)).alias("n"))
    whole = F.struct((F.col("last.end") - F.expr(f"interval {hours} hours")).alias("start"), F.col("last.end").alias("end"))
    return counts.select(whole.alias("w"), "k", "n")


def daily_pairs(stream: DataFrame, late: str = "30 minutes") -> DataFrame:
    """Exact (day, k, actor), each once; state goes when the day is closed."""
    day = F.window("ts", "1 day").alias("w")
    seen = stream.withWatermark("ts", late).select(day, "k", "actor").groupBy("w", "k", "actor").agg(F.count(F.lit(1)).alias("hits"))
    return seen.select(F.unix_date(F.to_date("w.start")).alias("day"), "k", "actor", "hits")


def exactly_once(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Deliveries (crawler, epoch, sequence, digest, ts) without replays: the same range with another digest is no replay
    and stays, for commit_deliveries to refuse."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["crawler", "epoch", "sequence", "digest"])


def judge_deliveries(batch: DataFrame, committed: DataFrame) -> DataFrame:
    """batch (crawler, epoch, sequence, end_sequence, digest) with verdict against what is committed: accepted, replay (the same
    range and digest), or conflict (another digest or end, or a gap behind the stream's head)."""
    key = ["crawler", "epoch", "sequence"]
    order = Window.partitionBy("crawler", "epoch").orderBy("sequence")
    first = batch.groupBy(*key).agg(F.min(F.struct("digest", "end_sequence")).alias("first"), F.count_distinct("digest", "end_sequence").alias("kinds"))
    was = committed.groupBy(*key).agg(F.min(F.struct("digest", "end_sequence")).alias("was"))
    heads = committed.groupBy("crawler", "epoch").agg(F.max("end_sequence").alias("head"))
    known = first.join(was, key, "left").join(heads, ["crawler", "epoch"], "left")
    new = F.col("was").isNull()
    # New ranges must follow each other from the head on; behind a gap or a conflict nothing is accepted.
    before = F.max(F.when(new, F.col("first.end_sequence"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    follows = F.col("sequence") == F.coalesce(before, "head", F.col("sequence") - 1) + 1
    sound = F.coalesce(F.min(F.when(new, (follows & (F.col("kinds") == 1)).cast("int"))).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1)) == 1
    judged = known.withColumn("sound", sound).select(*key, "first", "was", "sound")
    own = F.struct("digest", "end_sequence")
    verdict = F.when(F.col("was").isNotNull(), F.when(own == F.col("was"), "replay").otherwise("conflict")).when(F.col("sound"), "accepted").otherwise("conflict")
    return batch.join(judged, key).select(*batch.columns, verdict.alias("verdict"))


def commit_deliveries(path: str):
    """A foreachBatch function: accepted deliveries of a batch go to path, once; replays add nothing and conflicts go to path/refused.

    A batch that is run again finds what was committed before it, and overwrites its own folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        committed = spark.createDataFrame([], batch.schema)
        for b in range(batch_id):
            if spark._jvm.org.apache.hadoop.fs.Path(f"{path}/accepted/batch={b}").getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/accepted/batch={b}")):
                committed = committed.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/accepted/batch={b}"))
        judged = judge_deliveries(batch.dropDuplicates(["crawler", "epoch", "sequence", "end_sequence", "digest"]), committed).persist()
        judged.where("verdict = 'accepted'").drop("verdict").write.mode("overwrite").parquet(f"{path}/accepted/batch={batch_id}")
        judged.where("verdict = 'conflict'").drop("verdict").write.mode("overwrite").parquet(f"{path}/refused/batch={batch_id}")
        judged.unpersist()

    return write


def split_late(stream: DataFrame, current_hour: int, hours: int = 24) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) observations by their hour."""
    from ..operators.heat import accept_observations

    hour = stream.withColumn("hour", F.floor(F.unix_seconds("ts") / 3600))
    judged = accept_observations(hour, current_hour, hours)
    return judged.where("verdict = 'accepted'").drop("verdict"), judged.where("verdict <> 'accepted'")


def merge_sink(path: str, keys: list[str]):
    """A foreachBatch function that writes each batch once: a replayed batch overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.dropDuplicates(keys).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
