import numpy as np
import pytest

from marlstone.operators import cuckoo


def test_no_key_is_denied_and_few_strangers_pass():
    rng = np.random.default_rng(1)
    keys = [int(x) for x in rng.integers(0, 1 << 62, 5000)]
    held = cuckoo.build_filter(keys)
    assert all(map(held.may_hold, keys))
    strangers = [int(x) for x in rng.integers(0, 1 << 62, 5000)]
    assert sum(map(held.may_hold, strangers)) < 25
    again = cuckoo.CuckooFilter.restore(held.snapshot())
    assert (again.table == held.table).all()


def test_broken_snapshots_are_refused():
    raw = cuckoo.build_filter([1, 2, 3]).snapshot()
    for bad in (raw[:20], raw[:-4], b"X" + raw[1:], raw[:20] + b"\0" + raw[21:]):
        with pytest.raises(ValueError):
            cuckoo.CuckooFilter.restore(bad)


def test_a_full_filter_is_rebuilt_larger():
    assert all(map(cuckoo.build_filter(list(range(0, 4000, 4))).may_hold, range(0, 4000, 4)))


def test_new_keys_with_a_lost_and_a_broken_shard(spark):
    known = spark.range(0, 3000, 3).withColumnRenamed("id", "k")
    candidates = spark.range(0, 2000).withColumnRenamed("id", "k")
    made = cuckoo.filters(known, "k", 4).collect()
    shards = [(made[0].shard, bytes(made[0].snapshot)[:30]), *[(r.shard, bytes(r.snapshot)) for r in made[2:]]]
    snapshots = spark.createDataFrame(shards, "shard int, snapshot binary")
    got = cuckoo.new_keys(candidates, known, "k", snapshots, 4).collect()
    assert sorted(r.k for r in got) == [x for x in range(2000) if x % 3]
    assert {r.how for r in got} == {"denied", "confirmed"}
    assert cuckoo.new_keys(candidates.limit(0), known, "k", snapshots, 4).count() == 0
