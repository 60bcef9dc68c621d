import __spark_entry__ as entry
from tillbook.plans import catalog


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["kind", "category", "year", "month", "amount"]


def test_every_query_has_an_oracle():
    assert set(catalog.ORACLES) == set(catalog.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_all_queries_run_on_smallest_data(spark):
    for name, fn in catalog.QUERIES.items():
        df = fn(spark, "/root/testdata/sf0.001")
        assert df.count() >= 0, name
