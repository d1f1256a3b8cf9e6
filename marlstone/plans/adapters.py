"""The engine's entities as views of the supplied tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def observations(events: DataFrame) -> DataFrame:
    """events as heat observations."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return events.select(
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.col("user_id").alias("actor"),
        F.floor(seconds / 3600).cast("long").alias("hour"),
        F.floor(seconds / 86400).cast("long").alias("day"),
        F.col("event_type").alias("source"),
        "event_id",
        seconds.alias("seconds"),
        "value",
    )


OBS = """obs as (select cast(json_extract_string(props, '$.k') as integer) as k, user_id as actor,
  cast(floor(epoch(ts) / 3600) as bigint) as hour, cast(floor(epoch(ts) / 86400) as bigint) as day,
  event_type as source, event_id, cast(floor(epoch(ts)) as bigint) as seconds, value from events)"""
DAILY = "daily as (select day, k, count(distinct actor) as n from obs group by day, k)"
COVER = """cover as (select day, case when count(distinct source) = (select count(distinct source) from obs) then 1 else 2 end as status
  from obs group by day)"""

#: 2024-01-28, the last day of the windows, and the last closed hour before 2024-01-29 00:00 UTC.
DAY, HOUR = 19750, 19751 * 24 - 1


def items(orders: DataFrame) -> DataFrame:
    """orders as catalogue items."""
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.sha1(F.col("o_orderkey").cast("string").cast("binary")).alias("info_hash"),
        F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("name"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("total_length"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("created"),
    )


ITEMS = """items as (select o_orderkey as id, sha1(cast(o_orderkey as varchar)) as info_hash,
  o_orderstatus || ' ' || o_orderpriority as name, cast(round(o_totalprice * 100) as bigint) as total_length,
  cast(floor(epoch(o_orderdate)) as bigint) as created from orders)"""


def files(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """lineitem as the files of an item."""
    ext = F.lower(F.translate("p_brand", "#", ""))
    joined = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").join(part.select("p_partkey", ext.alias("ext")), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        F.col("l_orderkey").alias("id"),
        F.concat(F.col("l_linenumber"), F.lit("_"), F.col("l_partkey"), F.lit("."), F.col("ext")).alias("path"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("length"),
    )


FILES = """files as (select l_orderkey as id,
  cast(l_linenumber as varchar) || '_' || cast(l_partkey as varchar) || '.' || lower(replace(p_brand, '#', '')) as path,
  cast(round(l_extendedprice * 100) as bigint) as length from lineitem join part on l_partkey = p_partkey)"""


def hashed(documents: DataFrame) -> DataFrame:
    """documents as content-addressed records with an input ordinal."""
    return documents.select(F.sha1(F.col("text").cast("binary")).alias("info_hash"), F.col("doc_id").alias("ordinal"), "n_chars", "source", "lang")


HASHED = "hashed as (select sha1(text) as info_hash, doc_id as ordinal, n_chars, source, lang from documents)"


def decisions(labels: DataFrame, documents: DataFrame) -> DataFrame:
    """labels as stored decisions: 2 reject, 1 hash only."""
    code = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1)
    l = labels.select(F.col("doc_id").alias("lid"), code.alias("code")).where("code is not null")
    return hashed(documents).join(l, F.col("ordinal") == F.col("lid")).select("info_hash", "ordinal", "code")


DECISIONS = f"""{HASHED}, decisions as (select info_hash, ordinal, case when toxic = 1 then 2 else 1 end as code
  from hashed join labels on ordinal = labels.doc_id where toxic = 1 or quality = 0)"""
