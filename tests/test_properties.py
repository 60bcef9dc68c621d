"""Property tests: partitioning independence and scalar semantics."""

import string

from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from tillbook.domains import CASING_EXCEPTIONS
from tillbook.functions import scalars as X
from tests.conftest import rows_of

SF = "/root/testdata/sf0.001"
QUERIES = ["summary_all_long", "summary_by_ledger_long", "cashflow_statement", "networth_table",
           "edit_expenses", "rename_assets", "apply_recurring", "category_totals_all_years"]


def test_results_do_not_depend_on_partitioning(spark):
    base = {n: rows_of(entry.queries()[n](spark, SF)) for n in QUERIES}
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for n in QUERIES:
            assert rows_of(entry.queries()[n](spark, SF)) == base[n], n
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def py_normalize(v: str) -> str:
    low = v.lower()
    if low in CASING_EXCEPTIONS:
        return CASING_EXCEPTIONS[low]
    return low[:1].upper() + low[1:]


TEXT = st.text(alphabet=string.ascii_letters + string.digits + " -_#/\t\n", max_size=12)


@settings(max_examples=25, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=20))
def test_normalize_and_key_match_python_semantics(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = df.select("v", X.normalize_category("v").alias("n"), X.mapping_key("v").alias("k")).collect()
    for r in got:
        assert r.n == py_normalize(r.v)
        assert r.k == r.v.strip().lower()
