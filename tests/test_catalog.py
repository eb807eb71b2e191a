import pytest

from tessella.catalog import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_oracle(same, name):
    same(QUERIES[name], SQL[name])


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)


def test_sample_is_repeatable(spark, sf_dir):
    a, b = (sorted(QUERIES["line_sample"](spark, sf_dir).repartition(n).collect()) for n in (1, 5))
    assert a == b and a
