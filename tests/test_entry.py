"""Driver contract smoke test on sf0.001."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["ano", "n_registros", "inde_medio", "delta_inde_medio", "taxa_queda"]


def test_queries_and_sql_are_registered():
    q, o = E.queries(), E.oracle_sql()
    assert len(q) >= 60 and len(o) >= 50
    assert all(callable(f) for f in q.values())
