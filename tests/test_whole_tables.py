"""Queries over whole tables, without a subset of ids, against brute force."""

import math
import random
import statistics

import duckdb
import pytest
from pyspark.sql import functions as F

from marlstone.functions import text
from marlstone.operators import analysis
from marlstone.plans import registry

SF = "/root/testdata/sf0.001"


def pairs_by_cohort():
    sql = f"select o_orderpriority, case when o_orderstatus = 'O' then 'A' else 'B' end, o_totalprice from '{SF}/orders.parquet' order by o_orderkey"
    by = {}
    for cohort, arm, rate in duckdb.sql(sql).fetchall():
        by.setdefault(cohort, []).append((arm, float(rate)))
    out = {}
    for cohort, runs in by.items():
        deltas = []
        for (arm, rate), (other_arm, other) in zip(runs[::2], runs[1::2]):
            if arm != other_arm:
                deltas.append(other - rate if arm < other_arm else rate - other)
        out[cohort] = deltas
    return out


def test_effects_take_all_orders(spark):
    want = pairs_by_cohort()
    got = {r.cohort: r for r in registry.QUERIES["effect_summary"](spark, SF).collect()}
    assert set(got) == set(want)
    for cohort, deltas in want.items():
        r, up = got[cohort], sum(x > 0 for x in deltas)
        n = up + sum(x < 0 for x in deltas)
        assert (r.pairs, r.positive, r.negative) == (len(deltas), up, n - up) and r.median == pytest.approx(statistics.median(deltas))
        tail = sum(math.comb(n, i) for i in range(min(up, n - up) + 1)) / 2**n
        assert r.two_sided_p == pytest.approx(min(1.0, 2 * tail)) and r.improvement_p == pytest.approx(sum(math.comb(n, i) for i in range(up, n + 1)) / 2**n)


def test_bootstrap_follows_the_generator():
    for n in (1, 2, 7, 60):
        draw = random.Random(4)
        values = [draw.choice([1.5, -2.0, draw.random()]) for _ in range(n)]
        own = random.Random(0xC0FFEE)
        medians = sorted(statistics.median(own.choices(values, k=n)) for _ in range(5000))
        at = lambda p: (len(medians) - 1) * p
        want = [medians[math.floor(x)] + (medians[math.ceil(x)] - medians[math.floor(x)]) * (x - math.floor(x)) for x in (at(0.025), at(0.975))]
        assert analysis.bootstrap_ci(values) == pytest.approx(want)


@pytest.mark.parametrize("name", ["pair_deltas", "sign_counts", "arm_plan"])
def test_all_orders_are_used(spark, name):
    got, orders = registry.QUERIES[name](spark, SF), spark.read.parquet(f"{SF}/orders.parquet")
    if name == "arm_plan":
        assert got.count() == orders.count()
    elif name == "pair_deltas":
        assert got.count() == sum(r["count"] // 2 for r in orders.groupBy("o_orderpriority").count().collect())
    else:
        assert {r.cohort: r.pairs for r in got.collect()} == {c: len(d) for c, d in pairs_by_cohort().items()}


def test_numbers_go_on_over_ranges(spark):
    rows = [(c, x) for c in ("a", "b", None) for x in [*range(0, 300, 3), 10**12, 10**12 + 1]]
    df = spark.createDataFrame(rows, "cohort string, seq long").orderBy(F.rand(3))
    got = {(r.cohort, r.seq): r.n for r in analysis.numbered(df, ["cohort"], "seq").collect()}
    assert got == {(c, x): k for c in ("a", "b", None) for k, x in enumerate([*range(0, 300, 3), 10**12, 10**12 + 1])}


def test_bounded_cuts_bytes_between_characters(spark):
    texts = ["", "a" * 20, "a" * 21, "é" * 11, "a" + "é" * 11, "a" * 19 + "é", "a" * 18 + "𝒳x", "  padded text of many bytes  ", "漢" * 7, "a" * 17 + "\ufffd" + "tail", "a" * 19 + " b", "x\0" * 20]

    def want(t):
        raw = t.replace("\0", "").strip(" ").encode()
        return raw.decode() if len(raw) <= 20 else raw[:20].decode(errors="ignore")

    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    assert {r.k: r.b for r in df.select("k", text.bounded(F.col("t"), 20).alias("b")).collect()} == {k: want(t) for k, t in enumerate(texts)}


def test_bounded_takes_all_items(spark):
    rows = registry.QUERIES["str_bounded"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/benchmark.parquet").count() and all(len(r.first.encode()) <= 20 for r in rows)


def test_all_labels_are_judgements(spark):
    got = {r.query: r.recall20 for r in registry.QUERIES["retrieval_metrics"](spark, SF).collect()}
    sql = f"""with h as (select lang, doc_id, row_number() over (partition by lang order by n_chars desc, doc_id) as rank from '{SF}/documents.parquet')
    select lang, count(*) filter (where rank <= 20) / count(*) from h join '{SF}/labels.parquet' using (doc_id) group by lang"""
    assert got == pytest.approx(dict(duckdb.sql(sql).fetchall()), abs=1e-7)


def test_sizes_beyond_a_terabyte(spark, tmp_path):
    """Keys of larger tables: the query ends at GB as its SQL does, the function goes on to TB."""
    keys = [0, 1, 12, 13, 12_239, 396_324, 396_325, 899_999, 8_999_999]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"create view orders as from '{tmp_path}/orders.parquet/*.parquet'")
    want = dict(con.execute(registry.ORACLES["str_human_size"]).fetchall())
    got = {r.o_orderkey: r["size"] for r in registry.QUERIES["str_human_size"](spark, str(tmp_path)).collect()}
    assert got == want and got[396_325] == "1024.0 GB"
    sizes = spark.createDataFrame([(1024**4 - 1,), (1024**4,), (1024**5,)], "n long").select(text.human_size(F.col("n")).alias("size"))
    assert [r["size"] for r in sizes.collect()] == ["1024.0 GB", "1.0 TB", "1024.0 TB"]
