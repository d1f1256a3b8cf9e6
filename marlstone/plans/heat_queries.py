"""Queries on heat."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import heat
from .adapters import COVER, DAILY, DAY, HOUR, OBS, observations
from .registry import query

_W = {w: f"sum(case when day between {DAY} - {w - 1} and {DAY} then n else 0 end)" for w in heat.WINDOWS}
_B = {w: f"sum(case when day between {DAY - 1} - {w - 1} and {DAY - 1} then n else 0 end)" for w in heat.WINDOWS}
_FULL = ", ".join(f"cast({s} as bigint) as heat{w}d" for w, s in _W.items())


def _obs(read):
    return observations(read("events"))


def _cover(read):
    obs = _obs(read)
    return heat.day_coverage(obs, obs.select("source").distinct())


@query("heat_daily_distinct", f"with {OBS}, {DAILY} select day, k, n from daily")
def _(read):
    return heat.daily_distinct(_obs(read))


@query("heat_24h_distinct", f"with {OBS} select k, count(distinct actor) as heat24h from obs where hour between {HOUR - 23} and {HOUR} group by k")
def _(read):
    return heat.rolling_distinct(_obs(read), HOUR)


@query(
    "heat_windows_full",
    f"""with {OBS}, {DAILY}, w as (select k, {_FULL} from daily where day between {DAY - 14} and {DAY} group by k),
    h as (select k, count(distinct actor) as heat24h from obs where hour between {HOUR - 23} and {HOUR} group by k)
    select coalesce(w.k, h.k) as k, coalesce(heat3d, 0) as heat3d, coalesce(heat7d, 0) as heat7d, coalesce(heat15d, 0) as heat15d,
    coalesce(heat24h, 0) as heat24h from w full join h on w.k = h.k""",
)
def _(read):
    obs = _obs(read)
    return heat.project(heat.window_heat(heat.daily_distinct(obs), DAY), heat.rolling_distinct(obs, HOUR))


@query(
    "heat_windows_incremental",
    f"with {OBS}, {DAILY} select k, {_FULL} from daily where day between {DAY - 15} and {DAY} group by k having "
    + " or ".join(f"{_W[w]} <> {_B[w]}" for w in heat.WINDOWS),
)
def _(read):
    return heat.incremental_heat(heat.daily_distinct(_obs(read)), DAY)


@query(
    "heat_window_trailing",
    f"with {OBS}, {DAILY} select day, k, "
    + ", ".join(f"cast(sum(n) over (partition by k order by day range between {w - 1} preceding and current row) as bigint) as heat{w}d" for w in heat.WINDOWS)
    + " from daily",
)
def _(read):
    return heat.trailing_heat(heat.daily_distinct(_obs(read)))


@query(
    "heat_top_two_hours",
    f"""with {OBS}, d as (select distinct k, actor, hour from obs), r as (select *, row_number() over (partition by k, actor order by hour desc) as r from d)
    select k, actor, max(case when r = 1 then hour end) as last_hour, max(case when r = 2 then hour end) as previous_hour from r group by k, actor""",
)
def _(read):
    return heat.top_two_hours(_obs(read))


@query("heat_actor_hours", f"with {OBS} select hour, k, count(distinct actor) as n from obs group by hour, k")
def _(read):
    return heat.actor_hour_counts(_obs(read))


@query("heat_day_coverage", f"with {OBS}, {COVER} select day, status from cover")
def _(read):
    return _cover(read)


@query(
    "heat_coverage_mask",
    f"with {OBS}, {COVER}, m as (select coalesce(bit_or(1 << cast({DAY} - day as integer)), 0) as mask from cover where status = 1 and day between {DAY - 14} and {DAY}) select mask, "
    + ", ".join(f"cast(bit_count(mask & {(1 << w) - 1}) as bigint) * 24 as hours{w}d" for w in heat.WINDOWS)
    + " from m",
)
def _(read):
    return heat.coverage_mask(_cover(read), DAY)


@query("heat_complete_days", f"with {OBS}, {DAILY}, {COVER} select day, k, n from daily where day in (select day from cover where status = 1)")
def _(read):
    return heat.complete_only(heat.daily_distinct(_obs(read)), _cover(read))


@query(
    "heat_missing_days",
    f"with {OBS}, {COVER} select g.day from (select unnest(generate_series({DAY - 40}, {DAY + 5})) as day) g where g.day not in (select day from cover)",
)
def _(read):
    return heat.missing_days(_cover(read), DAY - 40, DAY + 5)


@query(
    "heat_acceptance",
    f"with {OBS} select event_id, case when hour > {HOUR} then 'retry' when hour < {HOUR - 24} then 'late' else 'accepted' end as verdict from obs",
)
def _(read):
    return heat.accept_observations(_obs(read), HOUR).select("event_id", "verdict")


@query(
    "heat_fanout_filter",
    f"""with {OBS}, p as (select distinct k, actor from obs), wide as (select actor from p group by actor having count(*) > 48)
    select k, count(*) as n from p where actor not in (select actor from wide) group by k""",
)
def _(read):
    return heat.drop_fanout(_obs(read), 48)


@query(
    "heat_changed_keys",
    f"""with {OBS}, n as (select k, count(distinct actor) as n from obs where hour between {HOUR - 23} and {HOUR} group by k),
    p as (select k, count(distinct actor) as n from obs where hour between {HOUR - 24} and {HOUR - 1} group by k)
    select coalesce(n.k, p.k) as k, coalesce(n.n, 0) as n, case when p.k is null then 'new' when n.k is null then 'gone'
    when n.n <> p.n then 'changed' else 'unchanged' end as state from n full join p on n.k = p.k""",
)
def _(read):
    obs = _obs(read)
    at = lambda h: heat.rolling_distinct(obs, h).withColumnRenamed("heat24h", "n")
    return heat.changed_keys(at(HOUR), at(HOUR - 1))


@query(
    "heat_receipt_contiguity",
    """with r as (select conv_id as stream, turn + 1 as s, turn + 1 as e from conversations),
    f as (select *, s = lag(e, 1, 0) over (partition by stream order by s, e) + 1 as fits from r)
    select stream, bool_and(fits) as contiguous, max(e) as head, count(*) as receipts from f group by stream""",
)
def _(read):
    turn = F.col("turn") + 1
    return heat.receipt_gaps(read("conversations").select(F.col("conv_id").alias("stream"), turn.alias("start_sequence"), turn.alias("end_sequence")))


@query("heat_latest_complete_day", f"with {OBS}, {COVER} select max(day) as day, count(*) as days from cover where status = 1")
def _(read):
    return _cover(read).where("status = 1").agg(F.max("day").alias("day"), F.count(F.lit(1)).alias("days"))


@query(
    "heat_frames",
    f"with {OBS}, {DAILY} select day, k & 63 as shard, count(*) as entries, cast(sum(n) as bigint) as total, max(k >> 6) as top_quotient from daily group by day, k & 63",
)
def _(read):
    daily = heat.daily_distinct(_obs(read)).select("day", (F.col("k").bitwiseAND(F.lit(63))).alias("shard"), F.shiftright("k", 6).alias("q"), "n")
    return daily.groupBy("day", "shard").agg(F.count(F.lit(1)).alias("entries"), F.sum("n").alias("total"), F.max("q").alias("top_quotient"))


@query(
    "heat_delta_gaps",
    f"with {OBS}, {DAILY} select day, k, (k >> 6) - lag(k >> 6, 1, 0) over (partition by day, k & 63 order by k) as gap from daily",
)
def _(read):
    daily = heat.daily_distinct(_obs(read)).withColumn("q", F.shiftright("k", 6))
    before = F.lag("q", 1, 0).over(Window.partitionBy("day", F.col("k").bitwiseAND(F.lit(63))).orderBy("k"))
    return daily.select("day", "k", (F.col("q") - before).alias("gap"))


@query("heat_sketch_audit")
def _(read):
    obs = _obs(read)
    exact = obs.select("k", "actor").distinct().groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return heat.audit_sketch(exact, heat.sketch_distinct(obs))


@query("heat_batch_dedup", f"with {OBS} select distinct day, hour, k, actor from obs")
def _(read):
    return _obs(read).select("day", "hour", "k", "actor").distinct()
