"""Activity heat: exact distinct actors by day, over windows of days, and over the last closed hours.

An observation is (k, actor, hour): key, actor id, unix hour. Window heat is the sum of each day's distinct actors;
the 24-hour heat is the number of distinct actors in 24 closed hours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOWS = (3, 7, 15)
HOURS = 24


def daily_distinct(obs: DataFrame) -> DataFrame:
    """(day, k, n): exact distinct actors. The distinct step adds up in tasks before its shuffle, so a hot key is spread by actor."""
    return obs.select("day", "k", "actor").distinct().groupBy("day", "k").agg(F.count(F.lit(1)).alias("n"))


def rolling_distinct(obs: DataFrame, last_hour: int, hours: int = HOURS) -> DataFrame:
    """(k, heat24h): distinct actors in the closed hours [last_hour - hours + 1, last_hour]."""
    inside = obs.where(F.col("hour").between(last_hour - hours + 1, last_hour))
    return inside.select("k", "actor").distinct().groupBy("k").agg(F.count(F.lit(1)).alias("heat24h"))


def _sums(day: int) -> list:
    return [F.sum(F.when(F.col("day").between(day - w + 1, day), F.col("n")).otherwise(0)).alias(f"heat{w}d") for w in WINDOWS]


def window_heat(daily: DataFrame, day: int) -> DataFrame:
    """Heat vectors of every key with a count in the widest window."""
    return daily.where(F.col("day").between(day - max(WINDOWS) + 1, day)).groupBy("k").agg(*_sums(day))


def incremental_heat(daily: DataFrame, day: int) -> DataFrame:
    """Vectors of the keys whose vector differs from the day before's, those that fell to 0 included: both vectors of a key
    come from one pass over the days that either window holds."""
    before = [c.alias(f"was{w}") for c, w in zip(_sums(day - 1), WINDOWS)]
    both = daily.where(F.col("day").between(day - max(WINDOWS), day)).groupBy("k").agg(*_sums(day), *before)
    changed = F.lit(False)
    for w in WINDOWS:
        changed = changed | (F.col(f"heat{w}d") != F.col(f"was{w}"))
    return both.where(changed).select("k", *[f"heat{w}d" for w in WINDOWS])


def trailing_heat(daily: DataFrame) -> DataFrame:
    """Vectors of each key on each of its days, by range frames."""
    frame = lambda w: Window.partitionBy("k").orderBy("day").rangeBetween(-(w - 1), 0)
    return daily.select("day", "k", *[F.sum("n").over(frame(w)).alias(f"heat{w}d") for w in WINDOWS])


def top_two_hours(obs: DataFrame) -> DataFrame:
    """(k, actor, last_hour, previous_hour) of each pair."""
    last = obs.select("k", "actor", "hour").distinct()
    rank = F.row_number().over(Window.partitionBy("k", "actor").orderBy(F.desc("hour")))
    two = last.withColumn("r", rank).where("r <= 2")
    pick = lambda r: F.max(F.when(F.col("r") == r, F.col("hour")))
    return two.groupBy("k", "actor").agg(pick(1).alias("last_hour"), pick(2).alias("previous_hour"))


def actor_hour_counts(obs: DataFrame) -> DataFrame:
    """(hour, k, n): actors new to an hour."""
    return obs.select("hour", "k", "actor").distinct().groupBy("hour", "k").agg(F.count(F.lit(1)).alias("n"))


def day_coverage(obs: DataFrame, sources: DataFrame) -> DataFrame:
    """(day, status): 1 when every expected source was seen that day, 2 when some were missing. sources: source, one row each."""
    seen = obs.select("day", "source").distinct().join(sources, "source", "left_semi").groupBy("day").agg(F.count(F.lit(1)).alias("seen"))
    expected = sources.agg(F.count(F.lit(1)).alias("expected"))
    joined = seen.join(F.broadcast(expected))  # one row
    return joined.select("day", F.when(F.col("seen") == F.col("expected"), 1).otherwise(2).alias("status"))


def coverage_mask(coverage: DataFrame, day: int) -> DataFrame:
    """One row: the mask of complete days (bit i: day - i) and the covered hours of each window."""
    inside = coverage.where((F.col("status") == 1) & F.col("day").between(day - max(WINDOWS) + 1, day))
    mask = inside.agg(F.coalesce(F.bit_or(F.expr(f"shiftleft(1, cast({day} - day as int))")), F.lit(0)).alias("mask"))
    return mask.select("mask", *[(F.bit_count(F.col("mask").bitwiseAND(F.lit((1 << w) - 1))) * 24).cast("long").alias(f"hours{w}d") for w in WINDOWS])


def complete_only(daily: DataFrame, coverage: DataFrame) -> DataFrame:
    """Counts of complete days: a partial day adds nothing to heat."""
    return daily.join(coverage.where("status = 1").select("day"), "day", "left_semi")


def missing_days(coverage: DataFrame, first: int, last: int) -> DataFrame:
    days = coverage.sparkSession.range(first, last + 1).withColumnRenamed("id", "day")
    return days.join(coverage, "day", "left_anti")


def project(full: DataFrame, rolling: DataFrame) -> DataFrame:
    """Heat vectors with the 24-hour heat; a key absent from either side has 0 there."""
    r = rolling.withColumnRenamed("k", "rk")
    joined = full.join(r, F.col("k") == F.col("rk"), "full")
    return joined.select(F.coalesce("k", "rk").alias("k"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("heat3d", "heat7d", "heat15d", "heat24h")])


def receipt_gaps(receipts: DataFrame) -> DataFrame:
    """(stream, ok): whether each stream's receipts (start_sequence, end_sequence) are contiguous from 1."""
    before = F.lag("end_sequence", 1, 0).over(Window.partitionBy("stream").orderBy("start_sequence", "end_sequence"))
    linked = receipts.withColumn("fits", F.col("start_sequence") == before + 1)
    return linked.groupBy("stream").agg(F.bool_and("fits").alias("contiguous"), F.max("end_sequence").alias("head"), F.count(F.lit(1)).alias("receipts"))


def accept_observations(obs: DataFrame, current_hour: int, hours: int = HOURS) -> DataFrame:
    """obs with verdict: future hours are retryable, hours before the window are late, the rest is accepted."""
    verdict = F.when(F.col("hour") > current_hour, "retry").when(F.col("hour") < current_hour - hours, "late").otherwise("accepted")
    return obs.withColumn("verdict", verdict)


def drop_fanout(obs: DataFrame, most: int) -> DataFrame:
    """Counts by key without actors that touch more than most keys. The anti join's side is materialised by its own aggregation."""
    pairs = obs.select("k", "actor").distinct()
    wide = pairs.groupBy("actor").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > most).select("actor")
    return pairs.join(wide, "actor", "left_anti").groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def changed_keys(now: DataFrame, projected: DataFrame) -> DataFrame:
    """(k, n, state): mapped counts against those projected before: new, changed, unchanged or gone (n = 0)."""
    p = projected.select(F.col("k").alias("pk"), F.col("n").alias("was"))
    joined = now.join(p, F.col("k") == F.col("pk"), "full")
    state = F.when(F.col("pk").isNull(), "new").when(F.col("k").isNull(), "gone").when(F.col("n") != F.col("was"), "changed").otherwise("unchanged")
    return joined.select(F.coalesce("k", "pk").alias("k"), F.coalesce("n", F.lit(0)).alias("n"), state.alias("state"))


def sketch_distinct(obs: DataFrame) -> DataFrame:
    """(k, estimate): HyperLogLog distinct actors, apart from the exact operators."""
    return obs.groupBy("k").agg(F.hll_sketch_estimate(F.hll_sketch_agg("actor", F.lit(12))).alias("estimate"))


def audit_sketch(exact: DataFrame, estimate: DataFrame) -> DataFrame:
    """Under- and over-counts of estimates against exact counts, as one row."""
    e = estimate.select(F.col("k").alias("ek"), "estimate")
    d = exact.join(e, F.col("k") == F.col("ek"), "full").select((F.coalesce("estimate", F.lit(0)) - F.coalesce("n", F.lit(0))).alias("d"), F.coalesce("n", F.lit(0)).alias("n"))
    over, under = F.sum(F.greatest(F.col("d"), F.lit(0))), F.sum(F.greatest(-F.col("d"), F.lit(0)))
    return d.agg(F.count(F.lit(1)).alias("keys"), over.alias("over"), under.alias("under"), F.max(F.abs("d")).alias("max_error"), F.sum("n").alias("total"))


def projection_watermark(done: DataFrame, shards: int = 64) -> DataFrame:
    """One row: the last day up to which, from the first on, every shard of every day is done. done: day, shard."""
    whole = done.select("day", "shard").distinct().groupBy("day").agg((F.count(F.lit(1)) >= shards).alias("whole"))
    order = Window.orderBy("day")  # one row a day
    held = whole.withColumn("gap", F.coalesce(F.col("day") - F.lag("day").over(order) > 1, F.lit(False)) | ~F.col("whole"))
    sound = held.withColumn("lost", F.max(F.col("gap").cast("int")).over(order))
    return sound.agg(F.max(F.when(F.col("lost") == 0, F.col("day"))).alias("day"))


def days_to_seal(seen: DataFrame, sealed: DataFrame, latest: int, most: int = 4) -> DataFrame:
    """(day, place): the days of a sealing pass, in order: those seen up to the latest sealable day that are not sealed, most at most."""
    open_days = seen.select("day").distinct().join(sealed.select("day"), "day", "left_anti").where(F.col("day") <= latest)
    first = open_days.orderBy("day").limit(most)
    return first.withColumn("place", F.row_number().over(Window.orderBy("day")))


def loss_account(offered: DataFrame, kept: DataFrame, by: str = "source") -> DataFrame:
    """(by, offered, kept, lost) of a bounded queue: what came in against what came out."""
    a = offered.groupBy(by).agg(F.count(F.lit(1)).alias("offered"))
    b = kept.groupBy(F.col(by).alias("of")).agg(F.count(F.lit(1)).alias("kept"))
    joined = a.join(b, F.col(by).eqNullSafe(F.col("of")), "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    return joined.select(by, "offered", "kept", (F.col("offered") - F.col("kept")).alias("lost"))
