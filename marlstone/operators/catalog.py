"""Catalogue operators: validation, deduplicating ingest, retention, outbox and ranked reads.

All are DataFrame to DataFrame. State tables are snapshots: a transition gives the next snapshot. Nothing asks for
the time; it is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Decision codes and the limits of retention.
HASH_ONLY, REJECT, HASH_ONLY_CAP, REJECT_CAP, INVALID = 1, 2, 3, 4, 5
SUMMARY_ABOVE_FILES, SUMMARY_ABOVE_PATH_BYTES, MAX_PATH_BYTES, TOP_EXTENSIONS = 2000, 512 * 1024, 4096, 32


# Validation


def valid_hash(c: Column) -> Column:
    """40 lower-case hex digits after trimming and lower-casing."""
    return F.lower(F.trim(c)).rlike("^[a-f0-9]{40}$")


def normal_hashes(df: DataFrame, column: str = "info_hash") -> DataFrame:
    """Distinct valid hashes, trimmed and in lower case."""
    return df.where(valid_hash(F.col(column))).select(F.lower(F.trim(column)).alias(column)).distinct()


def bounded_text(c: Column, most: int) -> Column:
    """Non-empty, no NUL, valid UTF-8 of at most most bytes."""
    return F.coalesce((F.length(c) > 0) & (F.instr(c, "\0") == 0) & F.is_valid_utf8(c) & (F.octet_length(c) <= most), F.lit(False))


def file_list_errors(files: DataFrame, totals: DataFrame, most: int = 10_000) -> DataFrame:
    """(id, files, valid): 1..most files, none negative, lengths adding up to the total. totals: id, total_length."""
    by_id = files.groupBy("id").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("sum"), F.min("length").alias("least"))
    t = totals.select(F.col("id").alias("tid"), "total_length")
    joined = t.join(by_id, F.col("id") == F.col("tid"), "left")
    ok = F.col("files").between(1, most) & (F.col("least") >= 0) & (F.col("sum") == F.col("total_length"))
    return joined.select(F.col("tid").alias("id"), F.coalesce("files", F.lit(0)).alias("files"), F.coalesce(ok, F.lit(False)).alias("valid"))


def first_failure(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule that fails; null if all hold."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in rules])


def code_matches(encoding: Column, code: Column) -> Column:
    """Hash-only records bear codes 1, 3, 5; rejects 2, 4; others none."""
    return F.when(encoding == "hash_only", code.isin(1, 3, 5)).when(encoding == "reject", code.isin(2, 4)).otherwise(code.isNull())


# Ingest


def best_record(df: DataFrame, complete: Column, ordinal: str = "ordinal", key: str = "info_hash") -> DataFrame:
    """One record of each key: a complete one first, then by input order."""
    order = Window.partitionBy(key).orderBy(F.desc("__c"), ordinal)
    return df.withColumn("__c", complete).withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__c", "__r")


def best_decision(df: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """One decision of each hash: rejects beat hash-only, then input order. A min of structs adds up before its shuffle."""
    rank = F.when(F.col("code").isin(REJECT, REJECT_CAP), 0).otherwise(1)
    return df.groupBy("info_hash").agg(F.min(F.struct(rank.alias("r"), ordinal, "code")).alias("m")).select("info_hash", F.col("m.code").alias("code"))


def new_records(batch: DataFrame, catalog: DataFrame, key: str = "info_hash") -> DataFrame:
    return batch.join(catalog.select(key), key, "left_anti")


def insert_decisions(batch: DataFrame, stored: DataFrame, catalog: DataFrame) -> DataFrame:
    """Decisions to add: of hashes that are neither in the catalogue nor decided."""
    return best_decision(batch).join(catalog.select("info_hash"), "info_hash", "left_anti").join(stored.select("info_hash"), "info_hash", "left_anti")


def supersede_decisions(stored: DataFrame, catalog: DataFrame) -> DataFrame:
    """Decisions that stay: of hashes that did not become catalogue items."""
    return stored.join(catalog.select("info_hash"), "info_hash", "left_anti")


def processed(hashes: DataFrame, catalog: DataFrame, decisions: DataFrame) -> DataFrame:
    """The hashes that are in the catalogue or decided."""
    known = catalog.select("info_hash").unionByName(decisions.select("info_hash"))
    return hashes.select("info_hash").distinct().join(known, "info_hash", "left_semi")


def accepted_split(batch: DataFrame, catalog: DataFrame) -> DataFrame:
    """(accepted, duplicates): each new hash counts once, everything else is a duplicate."""
    by_hash = batch.groupBy("info_hash").agg(F.count(F.lit(1)).alias("c"))
    fresh = by_hash.join(catalog.select("info_hash"), "info_hash", "left_anti").agg(F.count(F.lit(1)).alias("accepted"))
    total = batch.agg(F.count(F.lit(1)).alias("total"))
    return fresh.join(F.broadcast(total)).select("accepted", (F.col("total") - F.col("accepted")).alias("duplicates"))  # one row each


def apply_receipts(stored: DataFrame, batches: DataFrame) -> DataFrame:
    """Stored receipts (stream, epoch, last_end, accepted, duplicates) with contiguous batches added.

    verdict: replay if the range and digest are the last ones, conflict if the digest differs or the start is not next.
    """
    s = stored.select(F.col("stream").alias("s_stream"), F.col("epoch").alias("s_epoch"), "last_start", "last_end", "last_digest")
    joined = batches.join(s, (F.col("stream") == F.col("s_stream")) & (F.col("epoch") == F.col("s_epoch")), "left")
    same = (F.col("start_sequence") == F.col("last_start")) & (F.col("end_sequence") == F.col("last_end"))
    follows = F.col("start_sequence") == F.coalesce("last_end", F.lit(0)) + 1
    verdict = F.when(same & (F.col("digest") == F.col("last_digest")), "replay").when(same, "conflict").when(follows, "accepted").otherwise("conflict")
    return joined.select("stream", "epoch", "start_sequence", "end_sequence", verdict.alias("verdict"))


# Retention and filters


def filter_reason(count: Column, cjk: Column, numeric: Column, too_many: int = 10_000, no_cjk_above: int = 1_000, numeric_above: int = 100) -> Column:
    """The first rule that rejects; a limit of 0 or less turns its rule off."""
    rules = []
    if too_many > 0:
        rules.append(F.when(count > too_many, "too_many_files"))
    if no_cjk_above > 0:
        rules.append(F.when((count > no_cjk_above) & ~cjk, "non_cjk_high_file_count"))
    if numeric_above > 0:
        rules.append(F.when((count > numeric_above) & numeric, "numeric_only_names"))
    return F.coalesce(*rules, F.lit(None).cast("string"))


def retention(count: Column, path_bytes: Column, longest_path: Column, valid: Column, downgrade: Column, reject_above: int = 0, hash_only_above: int = 0,
              summary_above: int = SUMMARY_ABOVE_FILES, summary_path_bytes: int = SUMMARY_ABOVE_PATH_BYTES, longest: int = MAX_PATH_BYTES) -> Column:
    """Struct (action, reason, code): caps come first, then validity, then what makes a record a summary."""
    made = lambda action, reason, code: F.struct(F.lit(action).alias("action"), reason.alias("reason"), F.lit(code).cast("int").alias("code"))
    chain = F.when(F.coalesce(count, F.lit(0)) == 0, made("hash_only", F.lit("invalid"), INVALID))
    if reject_above > 0:
        chain = chain.when(count > reject_above, made("reject", F.lit("reject_cap"), REJECT_CAP))
    if hash_only_above > 0:
        chain = chain.when(count > hash_only_above, made("hash_only", F.lit("hash_only_cap"), HASH_ONLY_CAP))
    chain = chain.when(~F.coalesce(valid, F.lit(False)), made("hash_only", F.lit("invalid"), INVALID))
    chain = chain.when(downgrade.isNotNull(), made("summary", F.concat(F.lit("rule_downgrade:"), downgrade), None))
    chain = chain.when(count > summary_above, made("summary", F.lit("file_count"), None))
    chain = chain.when((path_bytes > summary_path_bytes) | (longest_path > longest), made("summary", F.lit("path_bytes"), None))
    return chain.otherwise(made("full", F.lit("full"), None))


def extension_summary(files: DataFrame, top: int = TOP_EXTENSIONS) -> DataFrame:
    """(id, extension, files, bytes, rank): exact totals of every extension, the top ones by bytes, files and name."""
    by = files.groupBy("id", "extension").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
    order = Window.partitionBy("id").orderBy(F.desc("bytes"), F.desc("files"), "extension")
    return by.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


# Outbox


def enqueue(outbox: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """outbox (id, generation, enqueued_at, available_at, owner, lease_until, attempts) with ids marked: a new generation, no lease."""
    i = ids.select(F.col("id").alias("nid")).distinct()
    joined = outbox.join(i, F.col("id") == F.col("nid"), "full")
    marked, new = F.col("nid").isNotNull(), F.lit(now).cast("long")
    keep = lambda c, v: F.when(marked, v).otherwise(F.col(c)).alias(c)
    return joined.select(
        F.coalesce("nid", "id").alias("id"),
        F.when(marked, F.coalesce("generation", F.lit(0)) + 1).otherwise(F.col("generation")).alias("generation"),
        keep("enqueued_at", new), keep("available_at", new), keep("owner", F.lit(None).cast("string")),
        keep("lease_until", F.lit(None).cast("long")), keep("attempts", F.lit(0)),
    )


def due(now: int) -> Column:
    return (F.col("available_at") <= now) & (F.col("lease_until").isNull() | (F.col("lease_until") <= now))


def claim(outbox: DataFrame, now: int, owner: str, lease: int, most: int) -> DataFrame:
    """The first most due rows by (available_at, id), leased to owner."""
    got = outbox.where(due(now)).orderBy("available_at", "id").limit(most)
    return got.withColumns({"owner": F.lit(owner), "lease_until": F.lit(now + lease).cast("long"), "attempts": F.col("attempts") + 1})


def complete(outbox: DataFrame, done: DataFrame) -> DataFrame:
    """outbox without rows whose (id, generation, owner) are done: a row marked anew meanwhile stays."""
    return outbox.join(done.select("id", "generation", "owner"), ["id", "generation", "owner"], "left_anti")


def backoff(attempts: Column, base: int, most: int) -> Column:
    """base * 2^(attempts - 1) seconds, at most most."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0))), F.lit(float(most))).cast("long")


def fail(outbox: DataFrame, failed: DataFrame, now: int, base: int = 5, most: int = 3600) -> DataFrame:
    """Failed rows lose their lease and wait for their back-off."""
    f = failed.select(F.col("id").alias("fid"), F.col("generation").alias("fg"), F.col("owner").alias("fo"))
    hit = (F.col("id") == F.col("fid")) & (F.col("generation") == F.col("fg")) & (F.col("owner") == F.col("fo"))
    joined, was = outbox.join(f, hit, "left"), F.col("fid").isNotNull()
    return joined.select(
        "id", "generation", "enqueued_at", F.when(was, now + backoff(F.col("attempts"), base, most)).otherwise(F.col("available_at")).alias("available_at"),
        F.when(~was, F.col("owner")).alias("owner"), F.when(~was, F.col("lease_until")).alias("lease_until"), "attempts",
    )


def backlog(outbox: DataFrame, now: int) -> DataFrame:
    leased = F.col("lease_until") > now
    return outbox.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(due(now)).alias("due"), F.count_if(leased).alias("leased"), F.count_if(F.col("attempts") > 0).alias("retried"),
        F.sum("attempts").alias("attempts"), (F.lit(now) - F.min("enqueued_at")).alias("oldest_age"),
    )


# Reads


def ranked_page(catalog: DataFrame, heat: DataFrame, window: str = "heat7d", page: int = 1, size: int = 20) -> DataFrame:
    """One page by heat, then newest first, then id. Only the page's rows are sorted to the end (TakeOrderedAndProject)."""
    size = 20 if size == 0 else min(max(size, 1), 100)
    h = heat.select(F.col("id").alias("hid"), F.col(window).alias("heat"))
    joined = catalog.join(h, F.col("id") == F.col("hid"), "left").select("id", "name", "created", F.coalesce("heat", F.lit(0)).alias("heat"))
    return joined.orderBy(F.desc("heat"), F.desc("created"), "id").offset((max(page, 1) - 1) * size).limit(size)


def hydrate(hits: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalogue rows of ranked hits (id, rank), in rank order."""
    c = catalog.withColumnRenamed("id", "cid")
    return hits.join(c, F.col("id") == F.col("cid")).drop("cid").orderBy("rank")


def _word_score(words: Column, t: str, slack: int) -> Column:
    near = F.exists(words, lambda w: F.levenshtein(w, F.lit(t)) <= slack) if slack else F.lit(False)
    return F.when(F.array_contains(words, t), 3).when(F.exists(words, lambda w: w.startswith(t)), 2).when(near, 1).otherwise(0)


def text_score(text: Column, query: str, all_terms: bool) -> Column:
    """Matched query words, exact before prefix before typo (1 from 5 letters, 2 from 8); null if too few match.

    all_terms asks for every word; otherwise only the last may be missing.
    """
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    hits = []
    for t in query.lower().split():
        slack = 2 if len(t) >= 8 else 1 if len(t) >= 5 else 0
        hits.append(_word_score(words, t, slack))
    needed = hits if all_terms or len(hits) < 2 else hits[:-1]
    enough = F.lit(True)
    for h in needed:
        enough = enough & (h > 0)
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return F.when(enough, total)


def search(catalog: DataFrame, heat: DataFrame, query: str, window: str = "heat7d", page: int = 1, size: int = 20) -> DataFrame:
    """Ranked text search. A query in Han script matches all words, any other may miss its last one."""
    import re

    scored = catalog.withColumn("score", text_score(F.col("name"), query, bool(re.search("[一-鿿]", query)))).where("score is not null")
    h = heat.select(F.col("id").alias("hid"), F.col(window).alias("heat"))
    joined = scored.join(h, F.col("id") == F.col("hid"), "left").select("id", "name", "created", "score", F.coalesce("heat", F.lit(0)).alias("heat"))
    return joined.orderBy(F.desc("score"), F.desc("heat"), F.desc("created"), "id").offset((max(page, 1) - 1) * size).limit(size)


def file_page(files: DataFrame, text: str = "", by: str = "path", ascending: bool = True, page: int = 1, size: int = 50, most: int = 500) -> DataFrame:
    """(id, path, length, place) of one page of each item's file list (id, ordinal, path, length): its first files, filtered by a
    part of the path in any case, sorted by a column and then by ordinal."""
    first = files.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("ordinal"))).where(F.col("n") <= most)
    kept = first.where(F.instr(F.lower("path"), text.lower()) > 0) if text else first
    order = F.col(by).asc() if ascending else F.col(by).desc()
    placed = kept.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(order, "ordinal")))
    return placed.where(F.col("place").between((page - 1) * size + 1, page * size)).select("id", "path", "length", "place")


def next_batch(spool: DataFrame, heads: DataFrame, most: int) -> DataFrame:
    """(stream, ordinal, payload): of each stream's spool the rows that follow its head (stream, head) without a gap, most at most."""
    h = heads.select(F.col("stream").alias("s"), "head")
    after = spool.join(h, F.col("stream") == F.col("s"), "left").withColumn("head", F.coalesce("head", F.lit(-1))).where("ordinal > head")
    n = F.row_number().over(Window.partitionBy("stream").orderBy("ordinal"))
    return after.withColumn("n", n).where((F.col("ordinal") == F.col("head") + F.col("n")) & (F.col("n") <= most)).select("stream", "ordinal", "payload")
