"""Queries of the analysis operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis
from .adapters import OBS, observations
from .registry import query

_KINDS = """ov as (select event_type as src, user_id as info_hash, case event_type when 'view' then 'F' when 'click' then 'S' when 'purchase' then 'H' else 'R' end as kind from events)"""


def _overlay(read):
    kind = F.when(F.col("event_type") == "view", "F").when(F.col("event_type") == "click", "S").when(F.col("event_type") == "purchase", "H").otherwise("R")
    return read("events").select(F.col("event_type").alias("src"), F.col("user_id").alias("info_hash"), kind.alias("kind"), "event_id", "value")


@query("overlay_best_kind", f"with {_KINDS} select info_hash, case max(case kind when 'F' then 4 when 'S' then 3 when 'H' then 2 else 1 end) when 4 then 'F' when 3 then 'S' when 2 then 'H' else 'R' end as kind from ov group by info_hash")
def _(read):
    return analysis.best_kind(_overlay(read))


_SETS = "a as (select distinct user_id as h from events where event_type = 'view' and value > 60), b as (select distinct user_id as h from events where event_type = 'click' and value > 60)"


@query("overlay_compare", f"""with {_SETS}, j as (select a.h as x, b.h as y from a full join b on a.h = b.h),
m as (select count(x) as a_size, count(y) as b_size, count(*) filter (where x is not null and y is not null) as shared, count(*) as either, count(*) filter (where y is null) as only_a, count(*) filter (where x is null) as only_b from j)
select *, case when either <> 0 then shared / either end as jaccard, case when least(a_size, b_size) <> 0 then shared / least(a_size, b_size) end as overlap from m""")
def _(read):
    e = read("events").where("value > 60").withColumnRenamed("user_id", "info_hash")
    return analysis.compare_overlays(e.where("event_type = 'view'"), e.where("event_type = 'click'"))


@query("overlay_counts", f"with {_KINDS} select src, count(distinct info_hash) as hashes, count(*) filter (where kind in ('F', 'S')) as searchable from ov group by src")
def _(read):
    return _overlay(read).groupBy("src").agg(F.count_distinct("info_hash").alias("hashes"), F.count_if(F.col("kind").isin("F", "S")).alias("searchable"))


#: Unique keys of events make the order within a series total.
_SERIES = "s as (select event_type as series, event_id as t, cast(floor(value * 100) as bigint) as v from events)"


def _series(read):
    return read("events").select(F.col("event_type").alias("series"), F.col("event_id").alias("t"), F.floor(F.col("value") * 100).cast("long").alias("v"))


@query("counter_delta_rates", f"with {_SERIES}, d as (select series, t, v - lag(v) over w as delta, t - lag(t) over w as dt from s window w as (partition by series order by t)) select series, t, delta, case when dt > 0 then delta * 3600 / dt end as per_hour from d")
def _(read):
    return analysis.counter_steps(_series(read))


@query("counter_summary", f"with {_SERIES} select series, cast(sum(v) as bigint) as total, max_by(v, t) - min_by(v, t) as signed_delta, greatest(0, max_by(v, t) - min_by(v, t)) as delta, max_by(v, t) as last from s group by series")
def _(read):
    return analysis.counter_summary(_series(read))


_MONO = f"{_SERIES}, z as (select * from s where v <> 0), m as (select *, max(v) over (partition by series order by t rows between unbounded preceding and 1 preceding) as m from z), k as (select series, t, v from m where m is null or v >= m)"


@query("monotone_clean", f"with {_MONO} select * from k")
def _(read):
    return analysis.monotone(_series(read))


@query("rate_halves", f"""with {_MONO}, p as (select series, (t + lag(t) over w) / 2 as mid, (v - lag(v) over w) / (t - lag(t) over w) as rate from k window w as (partition by series order by t))
select series, round(avg(case when mid < 500 then rate end), 6) as first, round(avg(case when mid >= 500 then rate end), 6) as second from p where rate is not null group by series""")
def _(read):
    return analysis.split_rates(analysis.monotone(_series(read)), 500).select("series", F.round("first", 6).alias("first"), F.round("second", 6).alias("second"))


@query("ols_slope", f"with {_SERIES} select series, round(regr_slope(v, t), 6) as slope from s group by series having count(*) >= 3")
def _(read):
    return analysis.slope(_series(read), "series", "t", "v").select("series", F.round("slope", 6).alias("slope"))


@query("percentile_summary", """select event_type, count(value) as n, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95,
round(min(value), 6) as least, round(max(value), 6) as most from events group by event_type""")
def _(read):
    s = analysis.summary(read("events"), "event_type", "value")
    return s.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "least", "most")])


@query("histogram_p95", """with b as (select event_type, case when value < 1 then 0 when value < 10 then 1 when value < 100 then 2 when value < 500 then 3 when value < 1000 then 4 when value < 2000 then 5 when value < 5000 then 6 when value < 10000 then 7 else 8 end as b, count(*) as c from events group by all),
r as (select event_type, b, sum(c) over (partition by event_type order by b) as run, sum(c) over (partition by event_type) as total from b)
select event_type, [1, 10, 100, 500, 1000, 2000, 5000, 10000, 10001][cast(min(b) + 1 as integer)] as p95 from r where run >= (total * 95 + 99) // 100 group by event_type""")
def _(read):
    return analysis.histogram_p95(read("events"), "event_type", "value")


@query("funnel_ratio", """select l_returnflag as source, round(sum(l_quantity), 4) as dials, round(sum(l_quantity * l_discount), 4) as ok, round(sum(l_quantity * l_discount) / nullif(sum(l_quantity), 0), 8) as ratio from lineitem group by l_returnflag""")
def _(read):
    t = read("lineitem").groupBy(F.col("l_returnflag").alias("source")).agg(F.sum("l_quantity").alias("d"), F.sum(F.col("l_quantity") * F.col("l_discount")).alias("o"))
    return t.select("source", F.round("d", 4).alias("dials"), F.round("o", 4).alias("ok"), F.round(analysis.ratio(F.col("o"), F.col("d")), 8).alias("ratio"))


@query("efficiency_ratio", "select l_shipdate_y as y, a, b, case when b > 0 then a / b end as ratio from (select year(l_shipdate) as l_shipdate_y, cast(sum(l_quantity) as bigint) as a, count(*) filter (where l_returnflag = 'R') as b from lineitem group by 1)")
def _(read):
    y = read("lineitem").select(F.year("l_shipdate").cast("long").alias("y"), F.col("l_quantity").cast("long").alias("q"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("r"))
    return analysis.efficiency(y, "y", "q", "r")


_RUNS = """runs as (select o_orderpriority as cohort, o_orderkey as seq, case when o_orderstatus = 'O' then 'A' else 'B' end as arm, o_totalprice as rate from orders)"""


def _runs(read):
    arm = F.when(F.col("o_orderstatus") == "O", "A").otherwise("B")
    return read("orders").select(F.col("o_orderpriority").alias("cohort"), F.col("o_orderkey").alias("seq"), arm.alias("arm"), F.col("o_totalprice").alias("rate"))


_PAIRS = f"""{_RUNS}, n as (select *, row_number() over (partition by cohort order by seq) - 1 as n from runs),
j as (select a.cohort, a.n // 2 as block, a.arm = b.arm as control, case when a.arm > b.arm then b.rate else a.rate end as base, case when a.arm > b.arm then a.rate else b.rate end as other
from n a join n b on a.cohort = b.cohort and a.n + 1 = b.n where a.n % 2 = 0), p as (select cohort, block, control, other - base as delta, (other - base) * 100 / base as percent, ln(other / base) as log_ratio from j)"""

_DELTAS = "select cohort, block, control, round(delta, 6) as delta, round(percent, 6) as percent, round(log_ratio, 6) as log_ratio from p"


def _deltas(runs):
    p = analysis.pair_runs(runs)
    return p.select("cohort", "block", "control", *[F.round(c, 6).alias(c) for c in ("delta", "percent", "log_ratio")])


@query("pair_deltas", f"with {_PAIRS} {_DELTAS}")
def _(read):
    return _deltas(_runs(read))


@query("effect_summary")
def _(read):
    return analysis.effect(analysis.pair_runs(_runs(read)))


_SIGNS = "select cohort, count(*) as pairs, count(*) filter (where delta > 0) as positive, count(*) filter (where delta < 0) as negative, round(median(delta), 6) as median from p where not control group by cohort"


def _signs(runs):
    p = analysis.pair_runs(runs).where("not control")
    return p.groupBy("cohort").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("delta") > 0).alias("positive"), F.count_if(F.col("delta") < 0).alias("negative"), F.round(F.median("delta"), 6).alias("median"))


@query("sign_counts", f"with {_PAIRS} {_SIGNS}")
def _(read):
    return _signs(_runs(read))


_JUDGED = """hits as (select lang as query, doc_id as doc, row_number() over (partition by lang order by n_chars desc, doc_id) as rank from documents),
judged as (select lang as query, d.doc_id as doc, 1 + l.quality * 2 as grade from documents d join labels l on d.doc_id = l.doc_id)"""


_QUALITY = """i as (select query, count(*) as relevant, sum(case when r <= 10 then (power(2, grade) - 1) / log2(r + 1) else 0 end) as ideal
from (select *, row_number() over (partition by query order by grade desc, doc) as r from judged) group by query),
g as (select j.query, count(*) filter (where rank <= 20) as in20, sum(case when rank <= 10 then (power(2, grade) - 1) / log2(rank + 1) else 0 end) as dcg, min(rank) as first from judged j join hits h on j.query = h.query and j.doc = h.doc group by j.query)
select i.query, round(coalesce(in20 / relevant, 0), 8) as recall20, round(coalesce(dcg / ideal, 0), 8) as ndcg10, round(coalesce(1.0 / first, 0), 8) as mrr from i left join g on i.query = g.query"""


@query("retrieval_metrics", f"with {_JUDGED}, {_QUALITY}")
def _(read):
    d = read("documents").select(F.col("lang").alias("query"), F.col("doc_id").alias("doc"), "n_chars")
    l = read("labels").select(F.col("doc_id").alias("doc"), (1 + F.col("quality") * 2).alias("grade"))
    q = analysis.retrieval_quality(analysis.ranked(d, "query", "n_chars", "doc").select("query", "doc", "rank"), d.select("query", "doc").join(l, "doc"))
    return q.select("query", *[F.round(c, 8).alias(c) for c in ("recall20", "ndcg10", "mrr")])


_RETRY = f"""with {OBS}, a as (select event_id, seconds // 60 - lag(seconds // 60) over (partition by k, actor order by seconds // 60, event_id) as age from obs),
c as (select event_id, case when age is null then 'first' when age < 120 then 'under_2m' when age < 480 then '2m_8m' when age < 960 then '8m_16m' when age < 1860 then '16m_31m' else 'first' end as class from a)"""


def _retry(read):
    o = observations(read("events"))
    return analysis.retry_ages(o.select(F.struct("k", "actor").alias("key"), F.floor(F.col("seconds") / 60).alias("t"), F.col("event_id").alias("id"), "source"))


@query("retry_age_class", f"{_RETRY} select event_id, class from c")
def _(read):
    return _retry(read).select(F.col("id").alias("event_id"), "class")


@query("retry_cohort_counts", f"{_RETRY} select class, source as outcome, count(*) as n from c join obs using (event_id) group by class, source")
def _(read):
    return _retry(read).groupBy("class", F.col("source").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("previous_counterpart", f"with {OBS} select event_id, lag(source) over (partition by actor order by seconds, event_id) as previous from obs")
def _(read):
    from pyspark.sql import Window

    o = observations(read("events"))
    return o.select("event_id", F.lag("source").over(Window.partitionBy("actor").orderBy("seconds", "event_id")).alias("previous"))


@query("window_coverage", f"with {OBS} select source, least(1.0, count(distinct seconds // 3600) / 720) as coverage from obs group by source")
def _(read):
    o = observations(read("events")).select("source", F.col("seconds").alias("t"))
    return analysis.window_coverage(o, "source", 720 * 3600, 3600)


@query("run_gates", "select o_orderkey as id, unnest(list_filter([case when not o_totalprice < 200000 then 'price' end, case when not o_orderstatus <> 'F' then 'status' end, case when not o_orderkey % 9 <> 0 then 'ninth' end], lambda x: x is not null)) as gate from orders")
def _(read):
    gates = [("price", F.col("o_totalprice") < 200000), ("status", F.col("o_orderstatus") != "F"), ("ninth", F.col("o_orderkey") % 9 != 0)]
    return analysis.failed_gates(read("orders").withColumn("id", F.col("o_orderkey")), gates, "id")


@query("treatment_signatures", "select o_orderstatus as arm, count(distinct (o_orderpriority, year(o_orderdate))) as signatures, count(distinct (o_orderpriority, year(o_orderdate))) <= 1 as consistent from orders group by 1")
def _(read):
    return analysis.signatures(read("orders").select(F.col("o_orderstatus").alias("arm"), "o_orderpriority", F.year("o_orderdate").alias("y")), "arm", "o_orderpriority", "y")


@query("xor_topk", "select o_orderkey as id, xor(o_orderkey, 1234) as distance from orders order by distance, id limit 8")
def _(read):
    return analysis.xor_nearest(read("orders").select(F.col("o_orderkey").alias("id")), "id", 1234, 8)


@query("ttl_dedupe", f"""with recursive {OBS}, admitted as (select k, min(seconds) as seconds from obs group by k
union all select a.k, n.seconds from admitted a, lateral (select min(o.seconds) as seconds from obs o where o.k = a.k and o.seconds >= a.seconds + 86400) n where n.seconds is not null)
select k, seconds from admitted""")
def _(read):
    return analysis.ttl_first(observations(read("events")), "k", "seconds", 86400)


@query("locale_counters", r"""select source, count(*) as classified, count(*) filter (where regexp_matches(text, '[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]')) as han from documents group by source""")
def _(read):
    from ..functions import text

    signals = text.script_signals(F.col("text"))
    return read("documents").groupBy("source").agg(F.count(F.lit(1)).alias("classified"), F.count_if(signals["han"]).alias("han"))


@query("key_counts", f"with {OBS} select k, count(*) as n from obs group by k")
def _(read):
    return observations(read("events")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("pending_capacity", "select source, cast(sum(n_chars) as bigint) as bytes, sum(n_chars) > 1000000 as over from documents group by source")
def _(read):
    return read("documents").groupBy("source").agg(F.sum("n_chars").alias("bytes")).withColumn("over", F.col("bytes") > 1_000_000)


_PLAN = "select o_orderkey as id, case when (row_number() over (order by o_orderkey) - 1) // 2 % 2 = (row_number() over (order by o_orderkey) - 1) % 2 then 'A' else 'B' end as arm from orders"


@query("arm_plan", _PLAN)
def _(read):
    return analysis.arm_plan(read("orders").select(F.col("o_orderkey").alias("id")))
