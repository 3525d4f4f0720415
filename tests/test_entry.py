import __spark_entry__ as e


def test_entry_runs(spark):
    assert e.entry(spark).count() > 0


def test_every_twin_has_its_query():
    assert set(e.oracle_sql()) <= set(e.queries())
