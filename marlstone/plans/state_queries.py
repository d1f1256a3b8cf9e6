"""Queries of state tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import state
from .adapters import DECISIONS, HASHED, ITEMS, OBS, decisions, hashed, items, observations
from .registry import query

_CAT = "cat as (select distinct info_hash from hashed where ordinal % 3 = 0)"


_BATCHES = """turns as (select conv_id as stream, 1 as epoch, row_number() over (partition by conv_id order by turn) as n, count(*) over (partition by conv_id) as most, role from conversations),
b as (select *, n = 3 and stream % 5 = 0 as gap from turns)"""


#: Every turn is a batch; turns of every second stream come twice, turn 3 of every fifth leaves a gap, and turn 1 is stored already.
@query("receipts_upsert", f"""with {_BATCHES}, g as (select *, max(cast(gap as integer)) over (partition by stream order by n) as lost from b)
select stream, epoch, greatest(1, max(n) filter (where lost = 0)) as last_end, cast(1 + coalesce(sum(case when role = 'assistant' then 1 else 0 end) filter (where lost = 0 and n > 1), 0) as bigint) as accepted,
cast(coalesce(sum(case when role = 'assistant' then 0 else 1 end) filter (where lost = 0 and n > 1), 0) as bigint) as duplicates from g group by stream, epoch""")
def _(read):
    from pyspark.sql import Window

    c = read("conversations").withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long"))
    a = F.when(F.col("role") == "assistant", 1).otherwise(0)
    gap = F.when((F.col("n") == 3) & (F.col("conv_id") % 5 == 0), 1).otherwise(0)
    one = c.select(F.col("conv_id").alias("stream"), F.lit(1).alias("epoch"), F.lit(1).cast("long").alias("last_end"), F.lit(1).alias("accepted"), F.lit(0).alias("duplicates")).distinct()
    b = c.select(F.col("conv_id").alias("stream"), F.lit(1).alias("epoch"), (F.col("n") + gap).alias("start_sequence"), (F.col("n") + gap).alias("end_sequence"), F.sha1(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), a.alias("accepted"), (1 - a).alias("duplicates"))
    return state.upsert_receipts(one, b.unionByName(b.where("stream % 2 = 0")))


@query("receipt_faults", "select conv_id, count(*) as delivered from conversations group by conv_id having count(*) % 5 = 0")
def _(read):
    g = read("conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("delivered"))
    r = g.select("conv_id", "delivered", F.col("delivered").alias("accepted"), F.when(F.col("delivered") % 5 == 0, 1).otherwise(0).alias("duplicates"))
    return state.receipt_faults(r).select("conv_id", "delivered")


@query("oracle_merge", """select user_id as info_hash, case max(case event_type when 'view' then 4 when 'click' then 3 when 'purchase' then 2 else 1 end) when 4 then 'F' when 3 then 'S' when 2 then 'H' else 'R' end as kind
from events where event_id % 3 <> 2 group by user_id""")
def _(read):
    kind = F.when(F.col("event_type") == "view", "F").when(F.col("event_type") == "click", "S").when(F.col("event_type") == "purchase", "H").otherwise("R")
    e = read("events").select("event_id", F.col("user_id").alias("info_hash"), kind.alias("kind"))
    return state.merge_overlays(e.where("event_id % 3 = 0"), e.where("event_id % 3 = 1"))


@query("import_staged_new", f"with {HASHED}, {_CAT} select info_hash, min(ordinal) as ordinal from hashed where info_hash not in (select info_hash from cat) group by info_hash")
def _(read):
    h = hashed(read("documents"))
    cat = h.where("ordinal % 3 = 0").select("info_hash").distinct()
    return state.import_staged(h.select("info_hash", "ordinal"), cat, decisions(read("labels"), read("documents")))[0]


@query("import_staged_decisions", f"with {DECISIONS} select info_hash, ordinal, code from decisions where info_hash not in (select info_hash from hashed where ordinal % 2 = 0)")
def _(read):
    h = hashed(read("documents"))
    staged = h.where("ordinal % 2 = 0").select("info_hash", "ordinal")
    return state.import_staged(staged, h.where("ordinal < 0").select("info_hash"), decisions(read("labels"), read("documents")))[1]


@query("requests_mark_done", f"with {HASHED}, {_CAT} select ordinal as id, info_hash, case when info_hash in (select info_hash from cat) then 'done' else 'pending' end as status from hashed")
def _(read):
    h = hashed(read("documents"))
    return state.mark_done(h.select(F.col("ordinal").alias("id"), "info_hash", F.lit("pending").alias("status")), h.where("ordinal % 3 = 0"))


@query("outbox_rebuild", f"with {ITEMS} select id, cast(1 as bigint) as generation, cast(1700000000 as bigint) as enqueued_at, cast(1700000000 as bigint) as available_at, cast(null as varchar) as owner, cast(null as bigint) as lease_until, 0 as attempts from items")
def _(read):
    return state.rebuild_outbox(items(read("orders")), 1_700_000_000)


@query("map_observed", f"""with {OBS}, n as (select sha1(cast(k as varchar)) as info_hash, count(distinct actor) as n from obs group by k), {ITEMS}
select n.info_hash, i.id, n.n, case when i.id is null then 'unmapped' else 'mapped' end as state from n left join (select * from items where id % 2 = 0) i on n.info_hash = i.info_hash""")
def _(read):
    o = observations(read("events")).select(F.sha1(F.col("k").cast("string").cast("binary")).alias("info_hash"), "actor").distinct()
    return state.map_observed(o.groupBy("info_hash").agg(F.count(F.lit(1)).alias("n")), items(read("orders")).where("id % 2 = 0"))


@query("range_containment", "select o_orderkey from orders where exists (select 1 from nation where o_orderkey * 37 between n_nationkey * 70000 and n_nationkey * 70000 + 9000)")
def _(read):
    ranges = read("nation").select((F.col("n_nationkey") * 70000).cast("long").alias("low"), (F.col("n_nationkey") * 70000 + 9000).cast("long").alias("high"))
    return state.within_ranges(read("orders").withColumn("v", F.col("o_orderkey") * 37), "v", ranges).select("o_orderkey")


@query("denied_attempts", f"""with {OBS}, a as (select actor as endpoint, seconds as t from obs where source <> 'error'), d as (select actor as endpoint, seconds as t from obs where source = 'error')
select a.endpoint, a.t from a where not exists (select 1 from d where d.endpoint = a.endpoint and d.t <= a.t and a.t - d.t <= 900 * 60)""")
def _(read):
    o = observations(read("events")).select(F.col("actor").alias("endpoint"), F.col("seconds").alias("t"), "source")
    return state.denied(o.where("source <> 'error'"), o.where("source = 'error'"), 900 * 60)


@query("summary_validity", """select l_orderkey as id, count(*) <= 128 and count(distinct l_returnflag || l_linestatus || l_linenumber) = count(*) and sum(l_quantity) <= 150 as valid from lineitem group by l_orderkey""")
def _(read):
    e = F.struct(F.concat("l_returnflag", "l_linestatus", "l_linenumber").alias("extension"), F.col("l_quantity").cast("long").alias("files"), F.lit(0).cast("long").alias("bytes"))
    g = read("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(e).alias("x"))
    return g.select("id", state.summary_valid(F.array(F.lit("a")), F.col("x"), F.lit(150), F.lit(0)).alias("valid"))


_PART = lambda a, n: f"xor(cast('0x' || substr(info_hash, {a}, {n}) as bigint), {int(('0f' * 20)[a - 1 : a - 1 + n], 16)})"


@query("xor_nearest_hash", f"with {ITEMS} select id, info_hash from items order by {_PART(1, 14)}, {_PART(15, 14)}, {_PART(29, 12)}, info_hash limit 8")
def _(read):
    return state.xor_nearest_hash(items(read("orders")), "info_hash", "0f" * 20, 8).select("id", "info_hash")


@query("synthetic_long_tail")
def _(read):
    from ..sources.synthetic import long_tail_pairs

    return long_tail_pairs(read("region").sparkSession, 20_000, 500, 300).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("synthetic_zipf")
def _(read):
    from ..sources.synthetic import zipf_keys

    return zipf_keys(read("region").sparkSession, 20_000, 500).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("durable_win", "select o_orderpriority as cohort, count(*) >= 6 and count(*) filter (where o_totalprice > 100000) >= 5 and count(*) filter (where o_orderstatus = 'O') >= 3 and median(o_totalprice) > 0 as wins from orders group by 1")
def _(read):
    g = read("orders").groupBy(F.col("o_orderpriority").alias("cohort")).agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("o_totalprice") > 100000).alias("positive"), F.count_if(F.col("o_orderstatus") == "O").alias("controls"), F.median("o_totalprice").alias("median")
    )
    return state.durable_win(g)
