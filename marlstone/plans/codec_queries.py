"""Queries that write a binary form and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import heat
from ..sources import codecs, readers
from .adapters import DAILY, OBS, observations
from .registry import query


#: Records in a batch at most.
BATCH = 4096


def _encoded(df, keys: list[str], columns: list[str], encode):
    def run(k, table):
        import pyarrow as pa

        rows = list(zip(*(table.column(c).to_pylist() for c in columns)))
        return pa.table({"path": [str(k[0].as_py())], "content": pa.array([encode(k[0].as_py(), rows)], pa.binary())})

    return df.groupBy(*keys).applyInArrow(run, "path string, content binary")


def _grouped(df, key: str, columns: list[str], encode):
    """(path, content) of each group's rows, encoded: for groups that are small by nature, as an order's lines."""
    return _encoded(df, [key], columns, encode)


def _batches(df, key: str, columns: list[str], encode):
    """(path, content) of each group's rows, encoded in batches of about BATCH rows at most: a large group makes many."""
    sizes = df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / BATCH).alias("batches")).withColumnRenamed(key, "of")
    dealt = df.join(sizes, F.col(key).eqNullSafe(F.col("of"))).withColumn("batch", F.expr(f"pmod(xxhash64({', '.join(columns)}, monotonically_increasing_id()), batches)"))
    return _encoded(dealt.select(key, "batch", *columns), [key, "batch"], columns, encode)


def _hash(k: int) -> bytes:
    return k.to_bytes(20, "big")


@query("codec_heat_batches", f"with {OBS} select distinct hour as unix_hour, k, actor from obs")
def _(read):
    files = _batches(observations(read("events")).select("hour", "k", "actor").distinct(), "hour", ["k", "actor"], lambda h, rows: codecs.encode_batch(h // 24, h % 24, [(_hash(k), a) for k, a in rows]))
    back = readers.decoded(files, readers._batch, "path string, unix_hour long, info_hash binary, actor long")
    return back.select("unix_hour", F.conv(F.hex(F.expr("substring(info_hash, 13, 8)")), 16, 10).cast("int").alias("k"), "actor")


@query("codec_heat_frames", f"with {OBS}, {DAILY} select day, k as id, n from daily")
def _(read):
    def decode(raw: bytes):
        c = codecs.Cursor(raw)
        for shard in range(codecs.SHARDS):
            n, size = c.uvarint(), c.uvarint()
            yield from codecs.decode_frame(shard, n, c.take(size))

    def encode(_, rows):
        return b"".join(codecs.put_uvarint(n) + codecs.put_uvarint(len(p)) + p for _, n, p in codecs.encode_frames(sorted(rows)))

    files = _batches(heat.daily_distinct(observations(read("events"))), "day", ["k", "n"], encode)
    return readers.decoded(files, decode, "path string, id int, n long").select(F.col("path").cast("long").alias("day"), "id", "n")


@query("codec_actor_hours", f"with {OBS} select hour, k, count(distinct actor) as n from obs group by hour, k")
def _(read):
    def encode(hour, rows):
        return codecs.encode_actor_hour(hour, 2, 2, 0, 1000, 1 << 20, 0, 0, [(_hash(k), n) for k, n in rows])

    files = _batches(heat.actor_hour_counts(observations(read("events"))), "hour", ["k", "n"], encode)
    back = readers.decoded(files, lambda raw: ((int.from_bytes(h, "big"), n) for h, n in codecs.decode_actor_hour(raw)[1]), "path string, k int, n long")
    return back.select(F.col("path").cast("long").alias("hour"), "k", "n")


@query("codec_details", "select l_orderkey as id, l_linenumber || '_' || l_partkey || '.bin' as path, cast(round(l_extendedprice * 100) as bigint) as length from lineitem")
def _(read):
    li = read("lineitem").select("l_orderkey", F.concat("l_linenumber", F.lit("_"), "l_partkey", F.lit(".bin")).alias("path"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("length"))
    files = _grouped(li, "l_orderkey", ["path", "length"], lambda _, rows: codecs.encode_detail(rows, [("bin", len(rows), sum(n for _, n in rows))]))
    back = readers.decoded(files, lambda raw: codecs.decode_detail(raw)[0], "path string, file string, length long")
    return back.select(F.col("path").cast("long").alias("id"), F.col("file").alias("path"), "length")


@query("codec_overlays", "select event_type as src, user_id, count(*) as n from events group by all")
def _(read):
    kinds = {"view": b"F", "click": b"S", "purchase": b"H", "error": b"R", "signup": b"M"}
    files = _batches(read("events").select("event_type", "user_id"), "event_type", ["user_id"], lambda t, rows: b"".join(kinds[t] + _hash(u) for (u,) in rows))
    back = readers.decoded(files, lambda raw: ((k, int.from_bytes(h, "big")) for k, h in codecs.decode_overlay(raw)), "path string, kind string, user_id long")
    return back.groupBy(F.col("path").alias("src"), "user_id").agg(F.count(F.lit(1)).alias("n"))


@query("codec_spool", "select conv_id, turn as ordinal, octet_length(encode(text)) as size from conversations")
def _(read):
    files = _grouped(read("conversations").select("conv_id", "turn", "text"), "conv_id", ["turn", "text"], lambda _, rows: codecs.encode_spool([t.encode() for _, t in sorted(rows)]))
    back = readers.decoded(files, lambda raw: ((i, len(p)) for i, p in enumerate(codecs.decode_spool(raw)[0])), "path string, ordinal long, size long")
    return back.select(F.col("path").cast("long").alias("conv_id"), "ordinal", "size")
