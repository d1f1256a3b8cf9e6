"""Receipts, ranges, addresses and deliveries against brute force."""

import ipaddress
import random
from datetime import datetime

from pyspark.sql import functions as F

from marlstone.functions import numbers
from marlstone.operators import analysis, state
from marlstone.streaming import heat_stream


def test_a_replayed_batch_is_added_once(spark):
    stored = spark.createDataFrame([("a", 1, 10, 7, 3), ("b", 1, 5, 5, 0)], "stream string, epoch int, last_end long, accepted long, duplicates long")
    batches = [("a", 1, 1, 10, "x", 7, 3), ("a", 1, 11, 12, "y", 2, 0), ("a", 1, 11, 12, "y", 2, 0), ("a", 1, 14, 15, "z", 2, 0), ("b", 1, 6, 7, "p", 1, 1), ("b", 1, 6, 8, "q", 2, 1), ("b", 1, 8, 9, "r", 2, 0), ("c", 2, 1, 4, "n", 4, 0)]
    df = spark.createDataFrame(batches, "stream string, epoch int, start_sequence long, end_sequence long, digest string, accepted long, duplicates long")
    got = sorted(map(tuple, state.upsert_receipts(stored, df).collect()))
    assert got == [("a", 1, 12, 9, 3), ("b", 1, 5, 5, 0), ("c", 2, 4, 4, 0)]
    again = state.upsert_receipts(state.upsert_receipts(stored, df), df)
    assert sorted(map(tuple, again.collect())) == got


def test_values_within_narrow_and_wide_ranges(spark):
    draw = random.Random(5)
    ranges = [(0, 0), (5, 5), (250, 260), (65_000, 70_000), (10**6, 10**12), (1 << 40, (1 << 40) + 3), ((1 << 62) - 5, 1 << 62), (300, 200)]
    values = [*range(0, 300), *[e + d for a, b in ranges for e in (a, b) for d in (-1, 0, 1) if e + d >= 0], *[draw.randrange(1 << 62) for _ in range(300)]]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    r = spark.createDataFrame(ranges, "low long, high long")
    want = sorted(v for v in values if any(a <= v <= b for a, b in ranges))
    assert sorted(x.v for x in state.within_ranges(df, "v", r).collect()) == want


def test_addresses_of_both_kinds(spark):
    draw = random.Random(6)
    made = ["1.2.3.4", "10.0.0.1", "256.1.1.1", "1.2.3", "", "x", "::", "::1", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "1::2::3", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "2001:db8::1", "2001:10::1", "fe80::1", "ff02::1", "fc00::", "2a00::12345", "::1.2.3.4", "100::1", "240.0.0.1", "239.1.1.1"]
    made += [str(ipaddress.ip_address(draw.getrandbits(32))) for _ in range(80)] + [str(ipaddress.IPv6Address(draw.getrandbits(128) >> draw.randrange(90))) for _ in range(80)]
    nets = list(map(ipaddress.ip_network, numbers.RESERVED))

    def want(ip):
        try:
            a = ipaddress.ip_address(ip)
        except ValueError:
            return None, False
        a = getattr(a, "ipv4_mapped", None) or a
        return (b"\x04" + a.packed if a.version == 4 else b"\x06" + a.packed[:8]), not any(a in n for n in nets if n.version == a.version)

    df = spark.createDataFrame([(x,) for x in made], "ip string")
    got = df.select("ip", numbers.actor_bytes(F.col("ip")).alias("b"), numbers.public_address(F.col("ip")).alias("p")).collect()
    assert {r.ip: (None if r.b is None else bytes(r.b), r.p) for r in got} == {x: want(x) for x in made}


def test_ttl_chains(spark):
    draw = random.Random(7)
    rows = [(k, draw.randrange(400)) for k in (1, 2, None) for _ in range(120)] + [(4, None)]
    want = set()
    for k in {k for k, _ in rows}:
        last = None
        for t in sorted({t for kk, t in rows if kk == k and t is not None}):
            if last is None or t - last >= 25:
                want.add((k, t))
                last = t
    got = analysis.ttl_first(spark.createDataFrame(rows, "k int, t long"), "k", "t", 25).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_deliveries_are_committed_once_and_conflicts_refused(spark, tmp_path):
    schema = "crawler string, epoch long, sequence long, end_sequence long, digest string, ts timestamp"
    at = datetime(2024, 1, 1)
    write = heat_stream.commit_deliveries(str(tmp_path / "out"))
    batches = [[("c", 1, 1, 3, "a", at), ("c", 1, 4, 6, "b", at), ("c", 1, 4, 6, "b", at)], [("c", 1, 4, 6, "b", at), ("c", 1, 1, 3, "other", at), ("c", 1, 7, 8, "c", at), ("d", 1, 5, 5, "e", at)], [("c", 1, 10, 11, "gap", at), ("d", 1, 6, 6, "f", at)]]
    for _ in range(2):  # a batch that is run again changes nothing
        for k, rows in enumerate(batches):
            write(spark.createDataFrame(rows, schema), k)
    read = lambda p: sorted((r.crawler, r.sequence, r.digest) for r in spark.read.parquet(str(tmp_path / "out" / p)).collect())
    assert read("accepted") == [("c", 1, "a"), ("c", 4, "b"), ("c", 7, "c"), ("d", 5, "e"), ("d", 6, "f")]
    assert read("refused") == [("c", 1, "other"), ("c", 10, "gap")]


def test_chunks_of_arrays(spark):
    df = spark.createDataFrame([([],), ([1],), ([1, 2, 3, 4, 5],), (None,)], "a array<int>")
    assert [r.c for r in df.select(analysis.chunked(F.col("a"), 2).alias("c")).collect()] == [[], [[1]], [[1, 2], [3, 4], [5]], []]
