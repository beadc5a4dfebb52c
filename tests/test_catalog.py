import pytest

from oracle import same
from quarrydf.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    if name in SQL:
        same(df, SQL[name], sf)
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_optional_parts(spark, monkeypatch):
    import __spark_entry__

    real = __spark_entry__.find_spec
    monkeypatch.setattr(__spark_entry__, "find_spec", lambda n: None if n.startswith(("quarrydf.llm", "corpus_pipeline")) else real(n))
    assert set(__spark_entry__.queries()) == set(QUERIES)
