"""Next snapshots of state tables, and joins that keep them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .analysis import best_kind


def upsert_receipts(stored: DataFrame, batches: DataFrame) -> DataFrame:
    """(stream, epoch, last_end, accepted, duplicates): batches (stream, epoch, start_sequence, end_sequence, digest, accepted,
    duplicates) added to the stored counters.

    A batch that is delivered again adds nothing. Of a stream's batches those count that continue the stored range without a
    gap; a range that was stored already, one that leaves a gap, and one that comes with two digests are left out, and so is all after.
    """
    key = ["stream", "epoch"]
    once = batches.groupBy(*key, "start_sequence").agg(
        F.count_distinct("end_sequence", "digest").alias("kinds"), F.max("end_sequence").alias("end_sequence"), F.max("accepted").alias("accepted"), F.max("duplicates").alias("duplicates")
    )
    head = stored.select(F.col("stream").alias("s"), F.col("epoch").alias("e"), F.col("last_end").alias("head"))
    same = F.col("stream").eqNullSafe(F.col("s")) & F.col("epoch").eqNullSafe(F.col("e"))
    after = once.join(head, same, "left").where(F.col("start_sequence") > F.coalesce("head", F.lit(0)))
    order = Window.partitionBy(*key).orderBy("start_sequence")
    fits = (F.col("start_sequence") == F.coalesce(F.lag("end_sequence").over(order), "head", F.lit(0)) + 1) & (F.col("kinds") == 1)
    new = after.withColumn("fits", fits).withColumn("sound", F.min(F.col("fits").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1).where("sound")
    both = stored.select(*key, "last_end", "accepted", "duplicates").unionByName(new.select(*key, F.col("end_sequence").alias("last_end"), "accepted", "duplicates"))
    return both.groupBy(*key).agg(F.max("last_end").alias("last_end"), F.sum("accepted").alias("accepted"), F.sum("duplicates").alias("duplicates"))


def receipt_faults(receipts: DataFrame) -> DataFrame:
    """Rows that break delivered = accepted + duplicates or a non-negative count."""
    bad = (F.col("delivered") != F.col("accepted") + F.col("duplicates")) | (F.least("accepted", "duplicates") < 0)
    return receipts.where(F.coalesce(bad, F.lit(True)))


def merge_overlays(production: DataFrame, *overlays: DataFrame) -> DataFrame:
    """One kind of each hash over all overlays: the highest priority wins."""
    for o in overlays:
        production = production.select("info_hash", "kind").unionByName(o.select("info_hash", "kind"))
    return best_kind(production)


def import_staged(staged: DataFrame, catalog: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new catalogue rows, decisions that stay) of a staged import: first row of each hash, known hashes left out."""
    first = staged.groupBy("info_hash").agg(F.min(F.struct(*[c for c in staged.columns if c != "info_hash"])).alias("r")).select("info_hash", "r.*")
    new = first.join(catalog.select("info_hash"), "info_hash", "left_anti")
    known = catalog.select("info_hash").unionByName(new.select("info_hash"))
    return new, decisions.join(known, "info_hash", "left_anti")


def mark_done(requests: DataFrame, ingested: DataFrame) -> DataFrame:
    """requests (id, info_hash, status): pending ones whose hash was ingested are done."""
    i = ingested.select(F.col("info_hash").alias("got")).distinct()
    joined = requests.join(i, F.col("info_hash") == F.col("got"), "left")
    return joined.select("id", "info_hash", F.when(F.col("got").isNotNull(), "done").otherwise(F.col("status")).alias("status"))


def rebuild_outbox(catalog: DataFrame, now: int) -> DataFrame:
    """An outbox that marks every item once."""
    null = lambda t: F.lit(None).cast(t)
    at = F.lit(now).cast("long")
    return catalog.select("id", F.lit(1).cast("long").alias("generation"), at.alias("enqueued_at"), at.alias("available_at"), null("string").alias("owner"), null("long").alias("lease_until"), F.lit(0).alias("attempts"))


def map_observed(counts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Counts by hash with catalogue ids; state tells the unmapped, which are tried again later."""
    c = catalog.select(F.col("info_hash").alias("ch"), "id")
    joined = counts.join(c, F.col("info_hash") == F.col("ch"), "left")
    return joined.select("info_hash", "id", "n", F.when(F.col("id").isNull(), "unmapped").otherwise("mapped").alias("state"))


def within_ranges(df: DataFrame, value: str, ranges: DataFrame) -> DataFrame:
    """Rows whose number, from 0 to 2^62, lies in a range (low, high).

    A range joins by the blocks that make it up, at levels of 256 times the last one's size: at most 510 blocks a level however wide
    it is, and a row joins by its block at each level, so the join is by equality.
    """
    levels = range(8)
    at_level = lambda blocks, k: F.transform(blocks, lambda b: F.struct(F.lit(k).alias("level"), b.alias("block")))
    # A level's blocks are those of the range's ends that the next level's whole blocks do not hold.
    pieces = []
    floor = lambda x, k: F.shiftright(x.cast("long"), 8 * k)
    ceil = lambda x, k: F.shiftright(x.cast("long") + F.lit((1 << 8 * k) - 1), 8 * k)
    for k in levels:
        first, last = ceil(F.col("low"), k), floor(F.col("high") + 1, k) - 1
        if k < len(levels) - 1:
            whole_first, whole_last = ceil(F.col("low"), k + 1), floor(F.col("high") + 1, k + 1) - 1
            has = whole_first <= whole_last
        else:
            whole_first, whole_last, has = F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(False)
        some = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
        left = some(first, F.when(has, whole_first * 256 - 1).otherwise(last))
        right = F.when(has, some((whole_last + 1) * 256, last)).otherwise(F.array().cast("array<bigint>"))
        pieces.append(at_level(F.concat(left, right), k))
    r = ranges.where("low <= high").select(F.explode(F.concat(*pieces)).alias("piece")).distinct()
    own = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(F.col(value).cast("long"), 8 * k).alias("block")) for k in levels])
    numbered = df.withColumn("__row", F.monotonically_increasing_id())
    found = numbered.select("__row", F.explode(own).alias("own")).join(r, F.col("own") == F.col("piece"), "left_semi").select("__row").distinct()
    return numbered.join(found, "__row", "left_semi").drop("__row")


def denied(attempts: DataFrame, denials: DataFrame, ttl: int) -> DataFrame:
    """Attempts (endpoint, t) without those within ttl after a denial of the endpoint: as-of by a window over both tables' rows."""
    tagged = attempts.select("endpoint", "t", F.lit(None).cast("long").alias("denied_at"), F.lit(1).alias("kind"))
    both = tagged.unionByName(denials.select("endpoint", "t", F.col("t").alias("denied_at"), F.lit(0).alias("kind")))
    last = F.max("denied_at").over(Window.partitionBy("endpoint").orderBy("t", "kind"))
    return both.withColumn("last", last).where((F.col("kind") == 1) & (F.col("last").isNull() | (F.col("t") - F.col("last") > ttl))).select("endpoint", "t")


def summary_valid(representatives: Column, extensions: Column, total_files: Column, total_bytes: Column) -> Column:
    """A summary body: at most 64 representatives and 128 extensions, names unique without case, sums within the totals."""
    names = F.transform(extensions, lambda e: F.lower(e["extension"]))
    files = F.aggregate(extensions, F.lit(0).cast("long"), lambda a, e: a + e["files"])
    size = F.aggregate(extensions, F.lit(0).cast("long"), lambda a, e: a + e["bytes"])
    sane = F.forall(extensions, lambda e: (e["files"] > 0) & (e["bytes"] >= 0) & (F.octet_length(e["extension"]) <= 32))
    return (F.size(representatives) <= 64) & (F.size(extensions) <= 128) & (F.size(F.array_distinct(names)) == F.size(names)) & sane & (files <= total_files) & (size <= total_bytes)


def xor_nearest_hash(df: DataFrame, column: str, target: str, k: int) -> DataFrame:
    """The k hashes (40 hex digits) nearest in XOR distance: the distance as three numbers, compared in turn."""
    cuts = [(1, 14), (15, 14), (29, 12)]  # 56, 56 and 48 bits, none negative
    part = lambda c, a, n: F.conv(F.substring(c, a, n), 16, 10).cast("long")
    d = [part(F.col(column), a, n).bitwiseXOR(F.lit(int(target[a - 1 : a - 1 + n], 16))) for a, n in cuts]
    named = df.withColumns({f"d{i}": x for i, x in enumerate(d)})
    return named.orderBy("d0", "d1", "d2", column).limit(k)


def schema_is_private(df: DataFrame, forbidden: set[str]) -> bool:
    """No field of the schema, at any depth, has a forbidden name or holds raw bytes."""
    from pyspark.sql import types as T

    def clean(kind) -> bool:
        if isinstance(kind, T.StructType):
            return all(f.name.lower() not in forbidden and clean(f.dataType) for f in kind.fields)
        if isinstance(kind, T.ArrayType):
            return clean(kind.elementType)
        if isinstance(kind, T.MapType):
            return clean(kind.keyType) and clean(kind.valueType)
        return not isinstance(kind, T.BinaryType)

    return clean(df.schema)


def durable_win(effects: DataFrame, pairs: int = 6, positive: int = 5, controls: int = 3) -> DataFrame:
    """(cohort, wins): enough pairs, enough of them positive, and enough controls. effects: cohort, pairs, positive, controls, median."""
    wins = (F.col("pairs") >= pairs) & (F.col("positive") >= positive) & (F.col("controls") >= controls) & (F.col("median") > 0)
    return effects.select("cohort", F.coalesce(wins, F.lit(False)).alias("wins"))
