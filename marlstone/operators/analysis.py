"""Analysis operators: overlays, counters, series, paired experiments and retrieval quality."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Overlay kinds by priority.
PRIORITY = {"F": 4, "S": 3, "H": 2, "R": 1}
#: Bounds of latency buckets in ms.
BUCKETS = (1, 10, 100, 500, 1000, 2000, 5000, 10000, 10001)
#: Seconds that part retry ages, and the age at which a cohort ends.
RETRY_AGES, RETRY_END = ((120, "under_2m"), (480, "2m_8m"), (960, "8m_16m"), (1860, "16m_31m")), 1860


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or missing."""
    return F.when(b != 0, a / b)


def best_kind(overlay: DataFrame) -> DataFrame:
    """(info_hash, kind): the kind of the highest priority."""
    rank = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    return overlay.groupBy("info_hash").agg(F.max_by("kind", rank[F.col("kind")]).alias("kind"))


def compare_overlays(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row of set measures of two hash sets, from one full join."""
    x, y = a.select(F.col("info_hash").alias("x")).distinct(), b.select(F.col("info_hash").alias("y")).distinct()
    both = x.join(y, F.col("x") == F.col("y"), "full")
    n = lambda c: F.count_if(c)
    has_x, has_y = F.col("x").isNotNull(), F.col("y").isNotNull()
    out = both.agg(n(has_x).alias("a_size"), n(has_y).alias("b_size"), n(has_x & has_y).alias("shared"), F.count(F.lit(1)).alias("either"), n(has_x & ~has_y).alias("only_a"), n(~has_x & has_y).alias("only_b"))
    return out.withColumns({"jaccard": ratio(F.col("shared"), F.col("either")), "overlap": ratio(F.col("shared"), F.least("a_size", "b_size"))})


def counter_steps(series: DataFrame, by: str = "series") -> DataFrame:
    """series (by, t, v) with delta and rate per hour against the last sample."""
    w = Window.partitionBy(by).orderBy("t")
    d, dt = F.col("v") - F.lag("v").over(w), F.col("t") - F.lag("t").over(w)
    return series.select(by, "t", d.alias("delta"), F.when(dt > 0, d * 3600 / dt).alias("per_hour"))


def counter_summary(series: DataFrame, by: str = "series") -> DataFrame:
    first, last = F.min_by("v", "t"), F.max_by("v", "t")
    return series.groupBy(by).agg(F.sum("v").alias("total"), (last - first).alias("signed_delta"), F.greatest(F.lit(0), last - first).alias("delta"), last.alias("last"))


def monotone(series: DataFrame, by: str = "series") -> DataFrame:
    """Samples that keep a counter rising: no zero once anything is positive, none below one kept before.

    A kept sample is a running maximum, so comparing with the running maximum of all earlier ones is the same.
    """
    positive = F.max("v").over(Window.partitionBy(by)) > 0
    sane = series.withColumn("__z", (F.col("v") == 0) & positive).where(F.col("v").isNotNull() & ~F.isnan(F.col("v").cast("double")) & ~F.col("__z"))
    before = F.max("v").over(Window.partitionBy(by).orderBy("t").rowsBetween(Window.unboundedPreceding, -1))
    return sane.withColumn("__m", before).where(F.col("__m").isNull() | (F.col("v") >= F.col("__m"))).select(by, "t", "v")


def split_rates(series: DataFrame, middle: float, by: str = "series") -> DataFrame:
    """Mean rate a second before and after the middle of the pairs' times."""
    w = Window.partitionBy(by).orderBy("t")
    pair = series.select(by, ((F.col("t") + F.lag("t").over(w)) / 2).alias("at"), ((F.col("v") - F.lag("v").over(w)) / (F.col("t") - F.lag("t").over(w))).alias("rate")).where("rate is not null")
    return pair.groupBy(by).agg(F.avg(F.when(F.col("at") < middle, F.col("rate"))).alias("first"), F.avg(F.when(F.col("at") >= middle, F.col("rate"))).alias("second"))


def slope(points: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Least-squares slope of each group of three points or more."""
    return points.groupBy(by).agg(F.when(F.count(F.lit(1)) >= 3, F.regr_slope(y, x)).alias("slope"))


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def summary(df: DataFrame, by: str, value: str) -> DataFrame:
    v = finite(F.col(value).cast("double"))
    return df.groupBy(by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("p50"), F.percentile(v, F.lit(0.95)).alias("p95"), F.min(v).alias("least"), F.max(v).alias("most")
    )


def histogram_p95(df: DataFrame, by: str, value: str) -> DataFrame:
    """The bound of the bucket in which 95 in 100, rounded up, are reached."""
    chain = None
    for k, b in enumerate(BUCKETS[:-1]):
        chain = F.when(F.col(value) < b, k) if chain is None else chain.when(F.col(value) < b, k)
    counts = df.groupBy(by, chain.otherwise(len(BUCKETS) - 1).alias("bucket")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(by)
    run = counts.select(by, "bucket", F.sum("c").over(w.orderBy("bucket")).alias("run"), F.sum("c").over(w).alias("total"))
    reached = run.where(F.col("run") >= F.floor((F.col("total") * 95 + 99) / 100))
    return reached.groupBy(by).agg(F.element_at(F.array(*map(F.lit, BUCKETS)), F.min("bucket") + 1).alias("p95"))


def numbered(rows: DataFrame, by: list[str], order: str, ranges: int = 1024) -> DataFrame:
    """rows with n, their number from 0 in each group of by in order of a unique number.

    Ranges of order are numbered each and moved by the rows in the ranges before, so a large group is spread over many tasks.
    """
    ends = F.broadcast(rows.agg(F.min(order).cast("double").alias("__low"), F.max(order).cast("double").alias("__high")))
    share = (F.col(order).cast("double") - F.col("__low")) / (F.col("__high") - F.col("__low") + 1) * ranges
    cut = rows.crossJoin(ends).withColumn("__range", F.coalesce(F.floor(share), F.lit(-1))).drop("__low", "__high")
    counts = cut.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__c"))
    before = F.sum("__c").over(Window.partitionBy(*by).orderBy("__range")) - F.col("__c")
    names = [*by, "__range"]
    counts = counts.select(*[F.col(c).alias(f"__of_{k}") for k, c in enumerate(names)], before.alias("__before"))
    own = cut.withColumn("n", F.row_number().over(Window.partitionBy(*names).orderBy(order)) - 1)
    same = [F.col(c).eqNullSafe(F.col(f"__of_{k}")) for k, c in enumerate(names)]
    return own.join(counts, same).select(*rows.columns, (F.col("n") + F.col("__before")).alias("n"))


def arm_plan(runs: DataFrame) -> DataFrame:
    """(id, arm): runs (id) in order of id dealt to two arms as A, B, B, A."""
    n = F.col("n")
    return numbered(runs.select("id"), [], "id").select("id", F.when(F.floor(n / 2) % 2 == n % 2, "A").otherwise("B").alias("arm"))


def pair_runs(runs: DataFrame) -> DataFrame:
    """runs (cohort, seq, arm, rate) paired with the next in blocks of two: delta, percent, log ratio, control if the arms agree."""
    block = numbered(runs, ["cohort"], "seq").withColumn("block", F.floor(F.col("n") / 2)).withColumn("place", F.col("n") % 2)
    left = block.where("place = 0").select("cohort", "block", F.col("arm").alias("arm_a"), F.col("rate").alias("rate_a"))
    right = block.where("place = 1").select("cohort", "block", F.col("arm").alias("arm_b"), F.col("rate").alias("rate_b"))
    swap = F.col("arm_a") > F.col("arm_b")
    base, other = F.when(swap, F.col("rate_b")).otherwise(F.col("rate_a")), F.when(swap, F.col("rate_a")).otherwise(F.col("rate_b"))
    joined = left.join(right, ["cohort", "block"]).select("cohort", "block", (F.col("arm_a") == F.col("arm_b")).alias("control"), base.alias("base"), other.alias("other"))
    return joined.select(
        "cohort", "block", "control", (F.col("other") - F.col("base")).alias("delta"), ratio((F.col("other") - F.col("base")) * 100, F.col("base")).alias("percent"),
        F.when((F.col("base") > 0) & (F.col("other") > 0), F.ln(F.col("other") / F.col("base"))).alias("log_ratio"),
    )


def bootstrap_ci(values: list[float], samples: int = 5000, seed: int = 0xC0FFEE) -> tuple[float, float] | None:
    """2.5 and 97.5 percentiles of the medians of resamples."""
    if not values:
        return None
    import numpy as np

    # The draws of random.Random(seed).choices: the same generator, many samples at once.
    state = random.Random(seed).getstate()[1]
    draw = np.random.RandomState()
    draw.set_state(("MT19937", state[:-1], state[-1]))
    n, held = len(values), np.sort(np.asarray(values, float))
    rank = np.argsort(np.argsort(values, kind="stable"), kind="stable")
    low, high = (n - 1) // 2, n // 2
    medians, each = [], max(1, 1_000_000 // n)
    for first in range(0, samples, each):
        took = rank[(draw.random_sample((min(each, samples - first), n)) * n).astype(np.int64)]
        took.partition((low, high), axis=1)
        medians += ((held[took[:, low]] + held[took[:, high]]) / 2 if low < high else held[took[:, low]]).tolist()
    medians.sort()

    def at(p: float) -> float:
        place = (len(medians) - 1) * p
        low = math.floor(place)
        return medians[low] + (medians[min(low + 1, len(medians) - 1)] - medians[low]) * (place - low)

    return at(0.025), at(0.975)


def sign_test(positive: Column, negative: Column) -> dict[str, Column]:
    """Exact binomial tails from the numbers of positive and negative deltas; null beyond 20 in all, where factorials leave the long range."""
    n = positive + negative
    choose = lambda k: F.factorial(n) / (F.factorial(k) * F.factorial(n - k))
    small = n <= 20
    tail = lambda a, b: F.aggregate(F.sequence(a, b), F.lit(0.0), lambda s, k: s + choose(k)) / F.pow(F.lit(2.0), n)
    two = F.least(F.lit(1.0), 2 * tail(F.lit(0).cast("int"), F.least(positive, negative)))
    return {"two_sided_p": F.when(small & (n > 0), two), "improvement_p": F.when(small & (n > 0), tail(positive, n))}


def sign_tails(positive: int, negative: int) -> tuple[float, float] | None:
    """(two-sided, improvement) binomial tails of any number of signs, by logarithms of the factorials."""
    import numpy as np

    n = positive + negative
    if n == 0:
        return None
    k = np.arange(1, n + 1)
    share = np.exp(np.concatenate([[0.0], np.cumsum(np.log((n - k + 1) / k))]) - n * math.log(2.0))
    return min(1.0, 2 * float(share[: min(positive, negative) + 1].sum())), min(1.0, float(share[positive:].sum()))


def effect(pairs: DataFrame) -> DataFrame:
    """Per cohort: pairs, mean and median delta, bootstrap interval and the effect of the median log ratio in percent.

    A cohort's resamples follow one generator's draws, so its deltas go to one function call.
    """

    import pyarrow as pa

    def whole(key, table):
        d = sorted(x for x in table.column("delta").to_pylist() if x is not None)
        ci = bootstrap_ci(d) or (None, None)
        tails = sign_tails(sum(x > 0 for x in d), sum(x < 0 for x in d)) or (None, None)
        made = {"low": ci[0], "high": ci[1], "two_sided": tails[0], "improvement": tails[1]}
        return pa.table({"c": [key[0].as_py()]} | {k: pa.array([v], pa.float64()) for k, v in made.items()})

    real = pairs.where(~F.col("control"))
    ci = real.select("cohort", "delta").groupBy("cohort").applyInArrow(whole, "c string, low double, high double, two_sided double, improvement double")
    stats = real.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("pairs"), F.avg("delta").alias("mean"), F.median("delta").alias("median"), ((F.exp(F.median("log_ratio")) - 1) * 100).alias("effect_percent"),
        F.count_if(F.col("delta") > 0).cast("int").alias("positive"), F.count_if(F.col("delta") < 0).cast("int").alias("negative"),
    )
    small = sign_test(F.col("positive"), F.col("negative"))
    tails = {k: F.coalesce(small[k], F.col(c)) for k, c in (("two_sided_p", "two_sided"), ("improvement_p", "improvement"))}
    return stats.join(ci, F.col("cohort") == F.col("c")).withColumns(tails).drop("c", "two_sided", "improvement")


def retrieval_quality(hits: DataFrame, judged: DataFrame) -> DataFrame:
    """(query, recall20, ndcg10, mrr): hits (query, doc, rank) against judged (query, doc, grade > 0)."""
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + 1)
    ideal = judged.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade"), "doc")))
    ideal = ideal.groupBy("query").agg(F.count(F.lit(1)).alias("relevant"), F.sum(F.when(F.col("r") <= 10, gain(F.col("grade"), F.col("r"))).otherwise(0.0)).alias("ideal"))
    got = judged.join(hits, ["query", "doc"])
    got = got.groupBy("query").agg(
        F.count_if(F.col("rank") <= 20).alias("in20"), F.sum(F.when(F.col("rank") <= 10, gain(F.col("grade"), F.col("rank"))).otherwise(0.0)).alias("dcg"), F.min("rank").alias("first")
    )
    g = got.withColumnRenamed("query", "q")
    joined = ideal.join(g, F.col("query") == F.col("q"), "left")
    zero = F.lit(0.0)
    return joined.select("query", F.coalesce(F.col("in20") / F.col("relevant"), zero).alias("recall20"), F.coalesce(F.col("dcg") / F.col("ideal"), zero).alias("ndcg10"), F.coalesce(F.lit(1.0) / F.col("first"), zero).alias("mrr"))


def retry_class(age: Column) -> Column:
    chain = F.when(age.isNull(), "first")
    for limit, label in RETRY_AGES:
        chain = chain.when(age < limit, label)
    return chain.otherwise("first")


def retry_ages(attempts: DataFrame) -> DataFrame:
    """attempts (key, t) with the class of their age since the last one; beyond RETRY_END a cohort begins anew."""
    age = F.col("t") - F.lag("t").over(Window.partitionBy("key").orderBy("t", "id"))
    return attempts.withColumn("class", retry_class(age))


def efficiency(df: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """Sum of a against sum of b by group; null where b is not positive."""
    total = df.groupBy(by).agg(F.sum(a).alias("a"), F.sum(b).alias("b"))
    return total.select(by, "a", "b", F.when(F.col("b") > 0, F.col("a") / F.col("b")).alias("ratio"))


def window_coverage(samples: DataFrame, by: str, seconds: int, width: int = 30) -> DataFrame:
    """Observed windows against those that the duration holds, at least 1; at most 1 in all."""
    seen = samples.groupBy(by).agg(F.count_distinct(F.floor(F.col("t") / width)).alias("windows"))
    return seen.select(by, F.least(F.lit(1.0), F.col("windows") / max(1, seconds // width)).alias("coverage"))


def failed_gates(runs: DataFrame, gates: list[tuple[str, Column]], by: str) -> DataFrame:
    """(by, gate) of each gate that a run fails."""
    names = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in gates]))
    return runs.select(by, F.explode(names).alias("gate"))


def signatures(runs: DataFrame, by: str, *columns: str) -> DataFrame:
    """Distinct treatment signatures of each arm; consistent iff there is one at most."""
    n = runs.select(by, F.struct(*columns).alias("s")).distinct().groupBy(by).agg(F.count(F.lit(1)).alias("signatures"))
    return n.select(by, "signatures", (F.col("signatures") <= 1).alias("consistent"))


def xor_nearest(df: DataFrame, key: str, target: int, k: int) -> DataFrame:
    """The k rows whose 63-bit keys are nearest to target in XOR distance."""
    return df.withColumn("distance", F.col(key).bitwiseXOR(F.lit(target).cast("long"))).orderBy("distance", key).limit(k)


def ttl_first(df: DataFrame, key: str, t: str, ttl: int) -> DataFrame:
    """Rows that a TTL deduplicator admits: the first of a key, then the next after the admitted one's TTL has run out.

    Whether a row is admitted depends on the last admitted one. Times after a pause of a TTL or more begin a chain of their own,
    so a key with pauses is split into its chains; a chain's times arrive sorted and are gone through once, none kept.
    """
    times = df.where(F.col(t).isNotNull()).select(F.col(key).alias("k"), F.col(t).cast("long").alias("t")).distinct()
    order = Window.partitionBy("k").orderBy("t")
    begins = F.coalesce(F.col("t") - F.lag("t").over(order) >= ttl, F.lit(True)).cast("long")
    chained = times.withColumn("begins", begins).withColumn("chain", F.sum("begins").over(order)).select("k", "chain", "t")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def admit(batches):
        import pyarrow as pa

        chain, last = None, 0
        for batch in batches:
            keep = []
            for k, c, x in zip(*(col.to_pylist() for col in batch.columns)):
                keep.append((k, c) != chain or x - last >= ttl)
                if keep[-1]:
                    chain, last = (k, c), x
            yield batch.filter(pa.array(keep, pa.bool_())).drop_columns(["chain"])

    dealt = chained.repartition(n, "k", "chain").sortWithinPartitions("k", "chain", "t")
    made = dealt.mapInArrow(admit, times.schema)
    return made.select(F.col("k").alias(key), F.col("t").alias(t))


def ranked(rows: DataFrame, by: str, value: str, tie: str) -> DataFrame:
    """rows with rank, from 1 in each group of by: the largest value first, then the smallest tie.

    Rows are counted by value first, so that a group's window is over its distinct values and not over its rows.
    """
    counts = rows.groupBy(by, value).agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(Window.partitionBy(by).orderBy(F.desc(value))) - F.col("c")
    before = counts.select(F.col(by).alias("of_group"), F.col(value).alias("of_value"), before.alias("before"))
    own = rows.withColumn("own", F.row_number().over(Window.partitionBy(by, value).orderBy(tie)))
    same = F.col(by).eqNullSafe(F.col("of_group")) & F.col(value).eqNullSafe(F.col("of_value"))
    return own.join(before, same).select(*rows.columns, (F.col("own") + F.col("before")).alias("rank"))


def chunked(values: Column, size: int) -> Column:
    """An array cut into arrays of size at most."""
    starts = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.floor((F.size(values) - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.slice(values, k * size + 1, F.lit(size)))
