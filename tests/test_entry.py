"""Driver contract: entry runs; every oracle belongs to a registered query."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["query_id", "rank", "embedding_id", "kind", "file_path", "chunk_no", "dist"]


def test_oracles_have_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 50


def test_every_query_plans(planned):
    assert set(planned) == set(E.queries())
    for name, df in planned.items():
        assert df.columns, name
