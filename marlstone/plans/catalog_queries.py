"""Queries on the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import catalog
from .adapters import DECISIONS, FILES, HASHED, ITEMS, decisions, files, hashed, items
from .registry import query

_CAT = "cat as (select distinct info_hash from hashed where ordinal % 3 = 0)"
_BATCH = "batch as (select * from hashed where ordinal % 2 = 0)"


def _tables(read):
    h = hashed(read("documents"))
    return h, h.where("ordinal % 3 = 0").select("info_hash").distinct(), h.where("ordinal % 2 = 0")


def _files(read):
    return files(read("lineitem"), read("part"))


@query("src_point_lookup", f"with {ITEMS} select id, name, total_length from items where info_hash = sha1('7')")
def _(read):
    from hashlib import sha1

    return items(read("orders")).where(F.col("info_hash") == sha1(b"7").hexdigest()).select("id", "name", "total_length")


@query("src_processed_scan", f"with {DECISIONS}, {_CAT} select info_hash from cat union all select info_hash from decisions")
def _(read):
    _, cat, _ = _tables(read)
    return cat.unionByName(decisions(read("labels"), read("documents")).select("info_hash"))


@query("src_keyset_page", f"with {ITEMS} select id, created from items where id > 100 order by id limit 51")
def _(read):
    return items(read("orders")).where("id > 100").orderBy("id").limit(51).select("id", "created")


@query("src_unnest", "select conv_id, unnest(list_sort(list(turn))) as turn from conversations group by conv_id")
def _(read):
    return read("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("t")).select("conv_id", F.explode("t").alias("turn"))


@query("src_pending_requests", f"with {ITEMS} select id, created from items where name like 'O%' order by created, id limit 10")
def _(read):
    return items(read("orders")).where(F.col("name").startswith("O")).orderBy("created", "id").limit(10).select("id", "created")


@query("src_json_extract", "select event_id, cast(json_extract_string(props, '$.k') as integer) as k from events")
def _(read):
    return read("events").select("event_id", F.from_json("props", "k int").k.alias("k"))


@query("ingest_dedupe_best", f"with {HASHED}, r as (select *, row_number() over (partition by info_hash order by case when n_chars > 500 then 1 else 0 end desc, ordinal) as r from hashed) select info_hash, ordinal from r where r = 1")
def _(read):
    return catalog.best_record(hashed(read("documents")), (F.col("n_chars") > 500).cast("int")).select("info_hash", "ordinal")


@query("ingest_best_decision", f"with {DECISIONS}, r as (select *, row_number() over (partition by info_hash order by case when code in (2, 4) then 0 else 1 end, ordinal) as r from decisions) select info_hash, code from r where r = 1")
def _(read):
    return catalog.best_decision(decisions(read("labels"), read("documents")))


@query("ingest_new_records", f"with {HASHED}, {_CAT}, {_BATCH} select ordinal from batch where info_hash not in (select info_hash from cat)")
def _(read):
    _, cat, batch = _tables(read)
    return catalog.new_records(batch, cat).select("ordinal")


@query("decisions_insert_absent", f"""with {DECISIONS}, {_CAT}, stored as (select distinct info_hash from decisions where ordinal % 5 = 0),
r as (select *, row_number() over (partition by info_hash order by case when code in (2, 4) then 0 else 1 end, ordinal) as r from decisions)
select info_hash, code from r where r = 1 and info_hash not in (select info_hash from cat) and info_hash not in (select info_hash from stored)""")
def _(read):
    _, cat, _ = _tables(read)
    d = decisions(read("labels"), read("documents"))
    return catalog.insert_decisions(d, d.where("ordinal % 5 = 0"), cat)


@query("decisions_supersede", f"with {DECISIONS}, {_CAT} select info_hash, ordinal, code from decisions where info_hash not in (select info_hash from cat)")
def _(read):
    _, cat, _ = _tables(read)
    return catalog.supersede_decisions(decisions(read("labels"), read("documents")), cat)


@query("processed_check", f"with {DECISIONS}, {_CAT}, {_BATCH} select distinct info_hash from batch where info_hash in (select info_hash from cat union select info_hash from decisions)")
def _(read):
    _, cat, batch = _tables(read)
    return catalog.processed(batch, cat, decisions(read("labels"), read("documents")))


@query("processed_union", f"with {DECISIONS}, {_CAT} select info_hash from cat union select info_hash from decisions")
def _(read):
    _, cat, _ = _tables(read)
    return cat.union(decisions(read("labels"), read("documents")).select("info_hash")).distinct()


@query("pending_except", f"with {HASHED}, {_CAT} select distinct info_hash from hashed where info_hash not in (select info_hash from cat)")
def _(read):
    h, cat, _ = _tables(read)
    return h.select("info_hash").distinct().join(cat, "info_hash", "left_anti")


@query("accepted_duplicate_split", f"with {HASHED}, {_CAT}, {_BATCH}, n as (select count(distinct info_hash) as accepted from batch where info_hash not in (select info_hash from cat)) select accepted, (select count(*) from batch) - accepted as duplicates from n")
def _(read):
    _, cat, batch = _tables(read)
    return catalog.accepted_split(batch, cat)


@query("duplicate_check", f"with {HASHED} select info_hash, count(*) as n from hashed group by info_hash having count(*) > 1")
def _(read):
    return hashed(read("documents")).groupBy("info_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("file_array_validity", f"""with {FILES}, {ITEMS}, f as (select id, count(*) as files, sum(length) as s, min(length) as l from files group by id)
select i.id, coalesce(files, 0) as files, coalesce(files between 1 and 10000 and l >= 0 and s = total_length, false) as valid from items i left join f on i.id = f.id""")
def _(read):
    return catalog.file_list_errors(_files(read), items(read("orders")))


@query("extension_summary_topk", f"""with {FILES}, b as (select id, split_part(path, '.', 2) as extension, count(*) as files, cast(sum(length) as bigint) as bytes from files group by all),
r as (select *, row_number() over (partition by id order by bytes desc, files desc, extension) as rank from b) select id, extension, files, bytes, rank from r where rank <= 2""")
def _(read):
    return catalog.extension_summary(_files(read).withColumn("extension", text.extension_key(F.col("path"))), 2)


@query("path_bytes", f"with {FILES} select id, cast(sum(length) as bigint) as bytes, cast(sum(octet_length(encode(path))) as bigint) as path_bytes, cast(max(octet_length(encode(path))) as bigint) as longest from files group by id")
def _(read):
    size = F.octet_length("path").cast("long")
    return _files(read).groupBy("id").agg(F.sum("length").alias("bytes"), F.sum(size).alias("path_bytes"), F.max(size).alias("longest"))


_COUNTS = "c as (select id, count(*) as n, sum(octet_length(encode(path))) as pb, max(octet_length(encode(path))) as lp, bool_and(regexp_full_match(split_part(path, '_', 1), '[0-9]+')) as num from files group by id)"


def _counts(read):
    size = F.octet_length("path")
    return _files(read).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("pb"), F.max(size).alias("lp"), F.bool_and(text.ascii_digits(F.substring_index("path", "_", 1))).alias("num"))


@query("filter_chain_reason", f"with {FILES}, {_COUNTS} select id, case when n > 6 then 'too_many_files' when n > 4 then 'non_cjk_high_file_count' when n > 2 and num then 'numeric_only_names' end as reason from c")
def _(read):
    return _counts(read).select("id", catalog.filter_reason(F.col("n"), F.lit(False), F.col("num"), 6, 4, 2).alias("reason"))


@query("retention_decision", f"""with {FILES}, {_COUNTS} select id, case when n > 6 then 'reject' when n > 5 then 'hash_only' when id % 7 = 0 or n > 3 or pb > 20 or lp > 12 then 'summary' else 'full' end as action,
case when n > 6 then 'reject_cap' when n > 5 then 'hash_only_cap' when id % 7 = 0 then 'rule_downgrade:seven' when n > 3 then 'file_count' when pb > 20 or lp > 12 then 'path_bytes' else 'full' end as reason,
case when n > 6 then 4 when n > 5 then 3 end as code from c""")
def _(read):
    c = _counts(read)
    made = catalog.retention(F.col("n"), F.col("pb"), F.col("lp"), F.lit(True), F.when(F.col("id") % 7 == 0, F.lit("seven")), 6, 5, 3, 20, 12)
    return c.select("id", made.alias("m")).select("id", "m.action", "m.reason", "m.code")


_OUT = f"""{ITEMS}, outbox as (select id, id % 3 + 1 as generation, created as enqueued_at, created + 60 as available_at,
case when id % 4 = 0 then 'w1' end as owner, case when id % 4 = 0 then 1700000000 + id end as lease_until, cast(id % 5 as integer) as attempts from items)"""
_NOW = 1_700_005_000


def _outbox(read):
    leased = F.col("id") % 4 == 0
    return items(read("orders")).select(
        "id", (F.col("id") % 3 + 1).alias("generation"), F.col("created").alias("enqueued_at"), (F.col("created") + 60).alias("available_at"),
        F.when(leased, "w1").alias("owner"), F.when(leased, F.lit(1_700_000_000) + F.col("id")).alias("lease_until"), (F.col("id") % 5).cast("int").alias("attempts"),
    )


@query("outbox_backlog", f"""with {_OUT} select count(*) as total, count(*) filter (where available_at <= {_NOW} and (lease_until is null or lease_until <= {_NOW})) as due,
count(*) filter (where lease_until > {_NOW}) as leased, count(*) filter (where attempts > 0) as retried, cast(sum(attempts) as bigint) as attempts, {_NOW} - min(enqueued_at) as oldest_age from outbox""")
def _(read):
    return catalog.backlog(_outbox(read), _NOW)


@query("outbox_ready", f"with {_OUT}, w as (select * from outbox where available_at <= {_NOW} and (lease_until is null or lease_until <= {_NOW}) order by available_at, id limit 500) select count(*) as ready, min(enqueued_at) as oldest from w")
def _(read):
    return _outbox(read).where(catalog.due(_NOW)).orderBy("available_at", "id").limit(500).agg(F.count(F.lit(1)).alias("ready"), F.min("enqueued_at").alias("oldest"))


@query("outbox_enqueue", f"""with {_OUT} select id, case when id % 2 = 0 then generation + 1 else generation end as generation, case when id % 2 = 0 then {_NOW} else enqueued_at end as enqueued_at,
case when id % 2 = 0 then {_NOW} else available_at end as available_at, case when id % 2 = 1 then owner end as owner, case when id % 2 = 1 then lease_until end as lease_until,
case when id % 2 = 0 then 0 else attempts end as attempts from outbox""")
def _(read):
    o = _outbox(read)
    return catalog.enqueue(o, o.where("id % 2 = 0").select("id"), _NOW)


@query("outbox_claim", f"with {_OUT} select id, generation, enqueued_at, available_at, 'w2' as owner, {_NOW + 30} as lease_until, attempts + 1 as attempts from outbox where available_at <= {_NOW} and (lease_until is null or lease_until <= {_NOW}) order by available_at, id limit 100")
def _(read):
    return catalog.claim(_outbox(read), _NOW, "w2", 30, 100)


@query("outbox_complete", f"with {_OUT} select * from outbox where not (coalesce(owner, '') = 'w1' and id % 8 = 0 and generation = 1)")
def _(read):
    o = _outbox(read)
    return catalog.complete(o, o.where("owner = 'w1' and id % 8 = 0").withColumn("generation", F.lit(1).cast("long")))


@query("outbox_fail", f"""with {_OUT} select id, generation, enqueued_at, case when owner = 'w1' then {_NOW} + cast(least(5 * power(2, greatest(attempts - 1, 0)), 3600) as bigint) else available_at end as available_at,
case when owner = 'w1' then null else owner end as owner, case when owner = 'w1' then null else lease_until end as lease_until, attempts from outbox""")
def _(read):
    o = _outbox(read)
    return catalog.fail(o, o.where("owner = 'w1'"), _NOW)


_HEAT = "heat as (select l_orderkey as id, cast(count(*) as bigint) as heat7d from lineitem group by l_orderkey)"


def _heat(read):
    return read("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("heat7d"))


@query("recent_top", f"with {ITEMS} select id, created from items order by created desc, id limit 100")
def _(read):
    return items(read("orders")).orderBy(F.desc("created"), "id").limit(100).select("id", "created")


@query("ranked_page", f"with {ITEMS}, {_HEAT} select i.id, name, created, coalesce(heat7d, 0) as heat from items i left join heat h on i.id = h.id order by heat desc, created desc, i.id limit 20 offset 40")
def _(read):
    return catalog.ranked_page(items(read("orders")), _heat(read), page=3)


@query("hydrate_ranked", f"with {ITEMS}, h as (select id, row_number() over (order by total_length desc, id) as rank from items qualify rank <= 25) select h.id, h.rank, i.name from h join items i on h.id = i.id")
def _(read):
    from pyspark.sql import Window

    i = items(read("orders"))
    top = i.orderBy(F.desc("total_length"), "id").limit(25)
    hits = top.select("id", F.row_number().over(Window.orderBy(F.desc("total_length"), "id")).alias("rank"))
    return catalog.hydrate(hits, i).select("id", "rank", "name")


@query("text_search")
def _(read):
    p = read("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("created"))
    h = read("lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count(F.lit(1)).alias("heat7d"))
    return catalog.search(p, h, "red widget")


@query("catalog_dto", f"with {ITEMS} select id, 'magnet:?xt=urn:btih:' || info_hash as magnet, created * 1000 as first_seen from items")
def _(read):
    return items(read("orders")).select("id", F.concat(F.lit("magnet:?xt=urn:btih:"), "info_hash").alias("magnet"), (F.col("created") * 1000).alias("first_seen"))


@query("catalog_counts", f"with {ITEMS} select count(*) as total, count(*) filter (where created >= 850000000) as today, cast(sum(total_length) as bigint) as bytes from items")
def _(read):
    return items(read("orders")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("created") >= 850_000_000).alias("today"), F.sum("total_length").alias("bytes"))


@query("durable_totals", "select conv_id as stream, min(turn) as first, max(turn) as last, count(*) as delivered, count(*) filter (where role = 'assistant') as accepted, count(*) filter (where role <> 'assistant') as duplicates from conversations group by conv_id")
def _(read):
    a = F.col("role") == "assistant"
    return read("conversations").groupBy(F.col("conv_id").alias("stream")).agg(F.min("turn").alias("first"), F.max("turn").alias("last"), F.count(F.lit(1)).alias("delivered"), F.count_if(a).alias("accepted"), F.count_if(~a).alias("duplicates"))


@query("receipt_verdicts", """with s as (select conv_id as stream, max(turn) as last_end from conversations where turn < 2 group by conv_id)
select c.conv_id as stream, 1 as epoch, c.turn as start_sequence, c.turn as end_sequence, case when c.turn = s.last_end then case when c.role = 'user' then 'replay' else 'conflict' end
when c.turn = coalesce(s.last_end, 0) + 1 then 'accepted' else 'conflict' end as verdict from conversations c left join s on c.conv_id = s.stream""")
def _(read):
    c = read("conversations").select(F.col("conv_id").alias("stream"), F.lit(1).alias("epoch"), F.col("turn").alias("start_sequence"), F.col("turn").alias("end_sequence"), F.col("role").alias("digest"))
    s = c.where("start_sequence < 2").groupBy("stream").agg(F.max("end_sequence").alias("last_end"))
    return catalog.apply_receipts(s.select("stream", F.lit(1).alias("epoch"), F.col("last_end").alias("last_start"), "last_end", F.lit("user").alias("last_digest")), c)


@query("hash_validity", "select distinct lower(trim(h)) as info_hash from (select case when doc_id % 3 = 0 then ' ' || upper(sha1(text)) when doc_id % 3 = 1 then sha1(text) else substr(sha1(text), 2) end as h from documents) where regexp_full_match(lower(trim(h)), '[a-f0-9]{40}')")
def _(read):
    h, d = F.sha1(F.col("text").cast("binary")), F.col("doc_id") % 3
    made = F.when(d == 0, F.concat(F.lit(" "), F.upper(h))).when(d == 1, h).otherwise(F.substring(h, 2, 40))
    return catalog.normal_hashes(read("documents").select(made.alias("info_hash")))


@query("peer_count_validity", "select event_id, value from events where value > 0 and regexp_full_match(event_type, '[a-z]+')")
def _(read):
    return read("events").where((F.col("value") > 0) & F.col("event_type").rlike("^[a-z]+$")).select("event_id", "value")


@query("bounded_text_check", "select doc_id, length(text) > 0 and octet_length(encode(text)) <= 16384 as ok from documents")
def _(read):
    return read("documents").select("doc_id", catalog.bounded_text(F.col("text"), 16384).alias("ok"))


@query("encoding_code_match", "select doc_id, case when quality = 0 then toxic + 1 in (1, 3, 5) else toxic + 1 in (2, 4) end as ok from labels")
def _(read):
    return read("labels").select("doc_id", catalog.code_matches(F.when(F.col("quality") == 0, "hash_only").otherwise("reject"), F.col("toxic") + 1).alias("ok"))


@query("import_validation", f"with {ITEMS} select count(*) as n, count(*) filter (where length(info_hash) <> 40) as bad_hash, count(*) filter (where total_length < 0) as bad_length, count(*) - count(distinct id) as repeated from items")
def _(read):
    i = items(read("orders"))
    return i.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("info_hash") != 40).alias("bad_hash"), F.count_if(F.col("total_length") < 0).alias("bad_length"), (F.count(F.lit(1)) - F.count_distinct("id")).alias("repeated"))


@query("partial_document_merge", f"with {ITEMS}, {_HEAT} select coalesce(i.id, h.id) as id, i.name, coalesce(heat7d, 0) as heat7d from (select * from items where id % 2 = 0) i full join (select * from heat where id % 3 = 0) h on i.id = h.id")
def _(read):
    i = items(read("orders")).where("id % 2 = 0").select("id", "name")
    h = _heat(read).where("id % 3 = 0").withColumnRenamed("id", "hid")
    return i.join(h, F.col("id") == F.col("hid"), "full").select(F.coalesce("id", "hid").alias("id"), "name", F.coalesce("heat7d", F.lit(0)).alias("heat7d"))
