from pyspark.sql import Row

from marlstone.operators import analysis, catalog, heat


def obs(spark, rows):
    return spark.createDataFrame([Row(k=k, actor=a, hour=h, day=h // 24) for k, a, h in rows])


def test_window_heat_sums_daily_actors(spark):
    o = obs(spark, [(1, 7, 24), (1, 7, 25), (1, 7, 48), (1, 8, 48)])
    assert heat.window_heat(heat.daily_distinct(o), 2).first().asDict() == {"k": 1, "heat3d": 3, "heat7d": 3, "heat15d": 3}


def test_rolling_heat_leaves_out_the_open_hour(spark):
    o = obs(spark, [(1, 7, 100), (1, 8, 101), (1, 9, 77), (1, 10, 76)])
    assert heat.rolling_distinct(o, 100).first().heat24h == 2


def test_incremental_heat_is_the_changed_part_of_the_full_one(spark):
    o = obs(spark, [(k, a, 24 * d) for k in range(5) for a in range(3) for d in range(20) if (k * a + d) % (k + 2) == 0])
    daily = heat.daily_distinct(o)
    vec = lambda d: {r.k: (r.heat3d, r.heat7d, r.heat15d) for r in heat.window_heat(daily, d).collect()}
    now, was = vec(18), vec(17)
    zero = (0, 0, 0)
    want = {k: now.get(k, zero) for k in {*now, *was} if now.get(k, zero) != was.get(k, zero)}
    assert {r.k: (r.heat3d, r.heat7d, r.heat15d) for r in heat.incremental_heat(daily, 18).collect()} == want


def test_ttl_counts_from_the_admitted_row(spark):
    d = spark.createDataFrame([("a", t) for t in (0, 5, 9, 10, 12, 21)], "k string, t long")
    assert [r.t for r in analysis.ttl_first(d, "k", "t", 10).orderBy("t").collect()] == [0, 10, 21]


def test_completed_rows_marked_anew_stay(spark):
    cols = "id long, generation long, enqueued_at long, available_at long, owner string, lease_until long, attempts int"
    o = spark.createDataFrame([(1, 2, 0, 0, "w", 9, 1), (2, 1, 0, 0, "w", 9, 1)], cols)
    done = spark.createDataFrame([(1, 1, "w"), (2, 1, "w")], "id long, generation long, owner string")
    assert [r.id for r in catalog.complete(o, done).collect()] == [1]


def test_empty_observations(spark):
    o = spark.createDataFrame([], "k int, actor long, hour long, day long")
    assert heat.daily_distinct(o).count() == 0 and heat.window_heat(heat.daily_distinct(o), 1).count() == 0
