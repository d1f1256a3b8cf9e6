import pytest

pytest.importorskip("marlstone.llm")

from marlstone.llm import queries  # noqa: E402

from ..compare import oracle, rows  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_oracle(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    assert rows(got) == rows(oracle(queries.ORACLES[name], SF))
