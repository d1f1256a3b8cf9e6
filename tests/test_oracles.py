import pytest

from marlstone.plans import registry

from .compare import oracle, rows

SF = "/root/testdata/sf0.001"
#: Empty at this scale: a filter of theirs holds only for larger tables.
MAY_BE_EMPTY = {"heat_fanout_filter", "recent_top", "text_search", "outbox_complete"}


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_oracle(spark, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), oracle(registry.ORACLES[name], SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(got) or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_oracle_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() >= 0


def test_comparison_catches_a_wrong_row(spark):
    name = "key_counts"
    got, want = registry.QUERIES[name](spark, SF).toPandas(), oracle(registry.ORACLES[name], SF)
    want.loc[0, "n"] += 1
    assert rows(got) != rows(want)
