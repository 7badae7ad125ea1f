import pytest
from oracle import assert_same, connect

from siftwork.plans import registry


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_its_sql(name, spark, sf_dir, duck):
    df = registry.QUERIES[name](spark, sf_dir)
    if name in registry.ORACLES:
        assert_same(df, registry.ORACLES[name], duck)
    else:
        df.collect()


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["lang", "risk_level", "posts", "mean_score", "max_score"]
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
