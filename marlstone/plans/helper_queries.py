"""Queries of single functions and small forms: codecs, text, numbers, options and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import analysis, catalog, cuckoo, heat, state
from ..sources import codecs, readers
from .adapters import OBS, observations
from .registry import query

def K():
    return F.col("o_orderkey")


@query("json_strict_body", """select o_orderkey, case when o_orderkey % 4 in (0, 1, 3) then o_orderkey end as k, case o_orderkey % 4 when 1 then 'unknown key' when 2 then 'not an object' when 3 then 'repeated key' end as error from orders""")
def _(read):
    k = K().cast("string")
    body = F.when(K() % 4 == 0, F.concat(F.lit('{"k": '), k, F.lit("}"))).when(K() % 4 == 1, F.concat(F.lit('{"k": '), k, F.lit(', "x": 1}'))).when(K() % 4 == 2, "broken").otherwise(F.concat(F.lit('{"k": '), k, F.lit(', "k": '), k, F.lit("}")))
    made = readers.strict_json(read("orders").select(K(), body.alias("body")), "body", "k long", ["k"])
    return made.select("o_orderkey", F.col("parsed.k").alias("k"), "error")


@query("json_loose_body", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, false as malformed from events")
def _(read):
    parsed = F.from_json("props", "k long, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return read("events").select("event_id", parsed.alias("p")).select("event_id", F.col("p.k").alias("k"), F.col("p._corrupt").isNotNull().alias("malformed"))


@query("codec_uvarint", "select o_orderkey as id, o_orderkey * o_orderkey as value, greatest(1, (length(ltrim(bin(o_orderkey * o_orderkey), '0')) + 6) // 7) as bytes from orders")
def _(read):
    def both(batches):
        import pyarrow as pa

        for batch in batches:
            raw = [codecs.put_uvarint(x * x) for x in batch.column(0).to_pylist()]
            back = [codecs.Cursor(r).uvarint() for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.int64()), pa.array(list(map(len, raw)), pa.int64())], ["id", "value", "bytes"])

    return read("orders").select(K().alias("id")).mapInArrow(both, "id long, value long, bytes long")


@query("runtime_lines", "select make_timestamp(1704067200000000 + o_orderkey * 1000000) as ts, cast(o_orderkey as double) as n, case when o_orderkey % 2 = 0 then 1.0 else 0.0 end as ok from orders where o_orderkey % 3 <> 0")
def _(read):
    at = F.date_format(F.timestamp_seconds(K() + 1704067200), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = F.concat(at, F.when(K() % 3 == 0, F.lit(" other line")).otherwise(F.concat(F.lit(" runtime 30s: n="), K().cast("string"), F.lit(" ok="), (K() % 2 == 0).cast("string"), F.lit(" name=x"))))
    made = readers.runtime_lines(read("orders").select(line.alias("value")))
    return made.select(F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("values")["n"].alias("n"), F.col("values")["ok"].alias("ok"))


_INFO = "'d6:lengthi' || page_id || 'e4:name' || length('file' || page_id) || ':file' || page_id || 'e'"


@query("codec_bencode", f"select cast(page_id as varchar) as path, 'file' || page_id as name, page_id as total_length, sha1({_INFO}) as info_hash from pages")
def _(read):
    name = F.concat(F.lit("file"), F.col("page_id").cast("string"))
    info = F.concat(F.lit("d6:lengthi"), F.col("page_id").cast("string"), F.lit("e4:name"), F.length(name).cast("string"), F.lit(":"), name, F.lit("e"))
    files = read("pages").select(F.col("page_id").cast("string").alias("path"), F.concat(F.lit("d4:info"), info, F.lit("e")).cast("binary").alias("content"))

    def decode(raw):
        found = codecs.metadata(raw)
        yield found["name"], found["total_length"], codecs.info_hash(raw)

    return readers.decoded(files, decode, "path string, name string, total_length long, info_hash string")


@query("codec_compact_peers", "select cast(o_orderkey as varchar) as path, concat_ws('.', 10, o_orderkey // 65536 % 256, o_orderkey // 256 % 256, o_orderkey % 256) as ip, o_orderkey % 65536 as port from orders")
def _(read):
    raw = F.unhex(F.concat(F.lit("0A"), F.lpad(F.hex(K() % (1 << 24)), 6, "0"), F.lpad(F.hex(K() % 65536), 4, "0")))
    return readers.decoded(read("orders").select(K().cast("string").alias("path"), raw.alias("content")), codecs.compact_peers, "path string, ip string, port long")


@query("codec_compact_nodes", "select cast(o_orderkey as varchar) as path, sha1(cast(o_orderkey as varchar)) as id, '1.2.3.4' as ip, o_orderkey % 65536 as port from orders")
def _(read):
    raw = F.unhex(F.concat(F.sha1(K().cast("string").cast("binary")), F.lit("01020304"), F.lpad(F.hex(K() % 65536), 4, "0")))
    decode = lambda raw: ((h.hex(), ip, port) for h, ip, port in codecs.compact_nodes(raw))
    return readers.decoded(read("orders").select(K().cast("string").alias("path"), raw.alias("content")), decode, "path string, id string, ip string, port long")


@query("schema_privacy", "select true as without_email, false as without_value")
def _(read):
    e = read("events")
    return read("region").limit(1).select(F.lit(state.schema_is_private(e, {"email"})).alias("without_email"), F.lit(state.schema_is_private(e, {"value"})).alias("without_value"))


@query("finite_summary", "select o_orderstatus as arm, count(*) as n, round(avg(o_totalprice), 6) as mean, max(o_totalprice) as most from orders where o_orderkey % 10 not in (3, 4) group by o_orderstatus")
def _(read):
    v = F.when(K() % 10 == 3, F.lit(float("inf"))).when(K() % 10 == 4, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    s = analysis.summary(read("orders").select(F.col("o_orderstatus").alias("arm"), v.alias("v")), "arm", "v")
    return s.select("arm", "n", F.round("mean", 6).alias("mean"), "most")


@query("str_helpers", """select o_orderkey, o_orderkey % 2 = 0 as digits, o_orderkey % 3 = 0 as padding, 'a/' || o_orderkey || '/c' as path, coalesce(case when o_orderkey % 5 <> 0 then o_orderstatus end, o_orderpriority) as filled,
case when o_orderkey % 2 = 0 then '你好' else 'né' end as decoded from orders""")
def _(read):
    k = K().cast("string")
    return read("orders").select(
        K(), text.ascii_digits(F.when(K() % 2 == 0, k).otherwise(F.concat(k, F.lit("x")))).alias("digits"), text.padding_file(F.when(K() % 3 == 0, F.concat(F.lit("_____padding_file_"), k)).otherwise(k)).alias("padding"),
        text.join_path(F.array(F.lit(" a "), F.lit(""), k, F.lit("  "), F.lit("c"))).alias("path"), text.first_filled(F.when(K() % 5 == 0, F.lit("  ")).otherwise(F.col("o_orderstatus")), F.col("o_orderpriority")).alias("filled"),
        text.fix_encoding(F.unhex(F.when(K() % 2 == 0, "C4E3BAC3").otherwise("6EC3A9"))).alias("decoded"),
    )


@query("str_hex_and_keys", "select event_id, hex(event_type) as hex, event_type as back, length(event_type) || ':' || event_type || '/' || length(cast(user_id as varchar)) || ':' || user_id as key from events")
def _(read):
    h = F.hex(F.col("event_type").cast("binary"))
    return read("events").select("event_id", h.alias("hex"), F.unhex(h).cast("string").alias("back"), text.composite_key(F.col("event_type"), F.col("user_id")).alias("key"))


@query("str_icons", "select o_orderkey, case o_orderkey % 4 when 0 then '🎬' when 1 then '💬' when 2 then '📄' else '📦' end as icon from orders")
def _(read):
    name = F.when(K() % 4 == 0, "a.b.MKV").when(K() % 4 == 1, "x.srt").when(K() % 4 == 2, "no extension").otherwise("y.7z")
    return read("orders").select(K(), text.file_icon(name).alias("icon"))


@query("option_overrides", """select o_orderkey, case o_orderkey % 3 when 0 then 'a=' || o_orderkey || ',x=3' when 1 then 'a.b=1,a.c=2,x.y=' || o_orderkey else 'a.b=' || o_orderkey || ',a.c=2,x=3' end as options from orders""")
def _(read):
    base, k = F.create_map(*[F.lit(x) for x in ("a.b", "1", "a.c", "2", "x", "3")]), K().cast("string")
    made = F.when(K() % 3 == 0, text.set_path(base, "a", k)).when(K() % 3 == 1, text.set_path(base, "x.y", k)).otherwise(text.set_path(base, "a.b", k))
    listed = F.array_join(F.array_sort(F.transform(F.map_entries(made), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return read("orders").select(K(), listed.alias("options"))


@query("map_filtered", "select o_orderkey, case when o_orderkey % 2 = 0 then 1 else 2 end as kept from orders")
def _(read):
    m = text.key_values(F.concat(F.lit("a="), K().cast("string"), F.lit(" b="), (-K() - 1).cast("string"), F.lit(" c="), (K() % 2).cast("string")))
    return read("orders").select(K(), F.size(F.map_filter(m, lambda k, v: (v > 0) | ((k == "a") & (v == 0)))).alias("kept")).select(K(), F.when(F.col("o_orderkey") % 2 == 0, F.least("kept", F.lit(1))).otherwise(F.col("kept")).alias("kept"))


@query("time_parse", "select event_id, cast(floor(epoch(ts)) as bigint) as seconds, true as bad_is_null from events")
def _(read):
    said = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return read("events").select("event_id", F.unix_seconds(numbers.parse_time(said)).alias("seconds"), numbers.parse_time(F.concat(F.lit("x"), said)).isNull().alias("bad_is_null"))


@query("ratio_and_clamp", "select o_orderkey, case when o_orderkey % 5 <> 0 then o_totalprice / (o_orderkey % 5) end as ratio, greatest(1000, least(200000, o_totalprice)) as clamped from orders")
def _(read):
    return read("orders").select(K(), analysis.ratio(F.col("o_totalprice"), K() % 5).alias("ratio"), text.clamp(F.col("o_totalprice"), 1000, 200000).alias("clamped"))


@query("bloom_sizing", "select n, cast(ceil(-n * ln(0.01) / power(ln(2), 2) * 1.25) as bigint) as bits, cast(round(ceil(-n * ln(0.01) / power(ln(2), 2) * 1.25) / n * ln(2)) as bigint) as hashes from (select unnest([1000, 1000000]) as n)")
def _(read):
    rows = [(n, *numbers.bloom_size(n, 0.01)) for n in (1000, 1_000_000)]
    return read("region").sparkSession.createDataFrame(rows, "n int, bits long, hashes long")


@query("array_chunks", "select conv_id, n // 2 as chunk, count(*) as size, sum(turn) as turns from (select *, row_number() over (partition by conv_id order by turn) - 1 as n from conversations) group by conv_id, n // 2")
def _(read):
    g = read("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("t")).select("conv_id", F.posexplode(analysis.chunked(F.col("t"), 2)).alias("chunk", "own"))
    return g.select("conv_id", F.col("chunk").cast("long").alias("chunk"), F.size("own").cast("long").alias("size"), F.aggregate("own", F.lit(0).cast("long"), lambda a, x: a + x).alias("turns"))


@query("array_sets", "select conv_id, count(distinct role) as roles, 2 * count(*) as both from conversations group by conv_id")
def _(read):
    g = read("conversations").groupBy("conv_id").agg(F.collect_list("role").alias("r"))
    return g.select("conv_id", F.size(F.array_distinct("r")).cast("long").alias("roles"), F.size(F.concat("r", "r")).cast("long").alias("both"))


@query("dirty_union", f"with {OBS} select distinct k from (select k from obs where day = 19750 union all select k from obs where source = 'error')")
def _(read):
    o = observations(read("events"))
    return o.where("day = 19750").select("k").union(o.where("source = 'error'").select("k")).distinct()


@query("heat_vector_add", f"with {OBS}, a as (select k, count(*) as n, count(distinct actor) as m from obs where hour % 2 = 0 group by k), b as (select k, count(*) as n, count(distinct actor) as m from obs where hour % 2 = 1 group by k) select k, cast(sum(n) as bigint) as n, cast(sum(m) as bigint) as m from (select * from a union all select * from b) group by k")
def _(read):
    o = observations(read("events"))
    vector = lambda odd: o.where(F.col("hour") % 2 == odd).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("actor").alias("m"))
    return vector(0).unionByName(vector(1)).groupBy("k").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


@query("merge_dedup", f"with {OBS} select distinct k, actor, hour from obs")
def _(read):
    o = observations(read("events")).select("k", "actor", "hour")
    return o.unionByName(o.where("hour % 3 = 0")).distinct()


@query("measurement_window", f"with {OBS} select event_id from obs where seconds >= 1705276800 and seconds < 1705276800 + 7200")
def _(read):
    return observations(read("events")).where(F.col("seconds").between(1705276800, 1705276800 + 7199)).select("event_id")


@query("durable_events", "select event_id from events where event_type in ('purchase', 'signup') and user_id % 7 <> 0")
def _(read):
    return read("events").where(F.col("event_type").isin("purchase", "signup") & (F.col("user_id") % 7 != 0)).select("event_id")


@query("wire_events", """select event_id, '{"id":' || event_id || ',"kind":"' || event_type || '","actor":' || user_id || '}' as body from events""")
def _(read):
    return read("events").select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("user_id").alias("actor"))).alias("body"))


@query("migration_rows", "select o_orderkey as id, coalesce(l.n, 0) as files, l.n is null as orphan from orders left join (select l_orderkey, count(*) as n from lineitem where l_linenumber > 2 group by 1) l on l.l_orderkey = o_orderkey")
def _(read):
    l = read("lineitem").where("l_linenumber > 2").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return read("orders").join(l, K() == F.col("l_orderkey"), "left").select(K().alias("id"), F.coalesce("n", F.lit(0)).alias("files"), F.col("n").isNull().alias("orphan"))


@query("runtime_days", "select distinct strftime(ts, '%Y-%m-%d') as day from events order by day desc limit 10")
def _(read):
    return read("events").select(F.date_format("ts", "yyyy-MM-dd").alias("day")).distinct().orderBy(F.desc("day")).limit(10)


@query("canonical_order", "select o_orderkey, row_number() over (partition by o_orderstatus order by encode(o_orderpriority), octet_length(encode(o_orderpriority)), o_orderkey) as place from orders")
def _(read):
    from pyspark.sql import Window

    raw = F.col("o_orderpriority").cast("binary")
    return read("orders").select(K(), F.row_number().over(Window.partitionBy("o_orderstatus").orderBy(raw, F.octet_length("o_orderpriority"), "o_orderkey")).alias("place"))


@query("file_page", """with f as (select l_orderkey as id, l_linenumber || '_' || l_partkey || '.' || l_returnflag as path, cast(round(l_extendedprice * 100) as bigint) as length, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as ordinal from lineitem)
select id, path, length, place from (select *, row_number() over (partition by id order by length desc, ordinal) as place from f where ordinal <= 500 and contains(lower(path), '.n')) where place between 3 and 4""")
def _(read):
    from pyspark.sql import Window

    path = F.concat("l_linenumber", F.lit("_"), "l_partkey", F.lit("."), "l_returnflag")
    ordinal = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    files = read("lineitem").select(F.col("l_orderkey").alias("id"), ordinal.alias("ordinal"), path.alias("path"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("length"))
    return catalog.file_page(files, ".N", "length", False, 2, 2)


@query("spool_next_batch", """with c as (select conv_id as stream, case when conv_id % 3 = 0 and turn >= 2 then turn + 1 else turn end as ordinal, octet_length(encode(text)) as size from conversations), h as (select distinct conv_id as stream, 0 as head from conversations where conv_id % 2 = 0)
select stream, ordinal, size from (select c.*, coalesce(h.head, -1) as head, row_number() over (partition by c.stream order by ordinal) as n from c left join h using (stream) where ordinal > coalesce(h.head, -1)) where ordinal = head + n and n <= 2""")
def _(read):
    c = read("conversations")
    ordinal = F.when((F.col("conv_id") % 3 == 0) & (F.col("turn") >= 2), F.col("turn") + 1).otherwise(F.col("turn"))
    spool = c.select(F.col("conv_id").alias("stream"), ordinal.alias("ordinal"), F.col("text").alias("payload"))
    heads = c.where("conv_id % 2 = 0").select(F.col("conv_id").alias("stream"), F.lit(0).alias("head")).distinct()
    return catalog.next_batch(spool, heads, 2).select("stream", "ordinal", F.octet_length("payload").alias("size"))


@query("shared_prefixes", "select o_orderkey, length('ab' || o_orderstatus) - 1 as shared from orders")
def _(read):
    def both(batches):
        import pyarrow as pa

        for batch in batches:
            n = [codecs.shared_prefix(("ab" + s).encode(), b"ab-") for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["o_orderkey", "shared"])

    return read("orders").select(K(), "o_orderstatus").mapInArrow(both, "o_orderkey long, shared long")


@query("cuckoo_new_keys", f"with {OBS} select distinct actor from obs where actor not in (select actor from obs where source = 'view' and actor % 3 <> 0)")
def _(read):
    o = observations(read("events"))
    known = o.where("source = 'view' and actor % 3 <> 0")
    return cuckoo.new_keys(o, known, "actor", cuckoo.filters(known, "actor", 8), 8).select("actor")


@query("projection_watermark", f"""with {OBS}, d as (select day, count(distinct event_id % 16) >= 16 as whole from obs group by day), g as (select *, not whole or coalesce(day - lag(day) over (order by day) > 1, false) as gap from d)
select max(day) as day from (select *, max(cast(gap as integer)) over (order by day) as lost from g) where lost = 0""")
def _(read):
    return heat.projection_watermark(observations(read("events")).select("day", (F.col("event_id") % 16).alias("shard")), 16)


@query("days_to_seal", f"with {OBS} select day, row_number() over (order by day) as place from (select distinct day from obs where day <= 19750 and day % 5 <> 0 order by day limit 4)")
def _(read):
    o = observations(read("events"))
    return heat.days_to_seal(o, o.where("day % 5 = 0").select("day").distinct(), 19750)


@query("loss_account", f"with {OBS} select source, count(*) as offered, count(*) filter (where event_id % 10 <> 3) as kept, count(*) filter (where event_id % 10 = 3) as lost from obs group by source")
def _(read):
    o = observations(read("events"))
    return heat.loss_account(o, o.where("event_id % 10 <> 3"))
