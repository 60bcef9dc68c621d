from pyspark.sql import functions as F

from tillbook.operators import reports as R
from tillbook.operators import summaries as S
from tests.conftest import rows_of


def wide(df, cat):
    out = {}
    for r in df.collect():
        out.setdefault(r[cat], {})[r.month] = r.amount
    return out


def test_primary_summary_golden(micro_ledger):
    got = wide(S.summary_long(micro_ledger, "primary"), "primary_category")
    assert got == {"Housing": {1: 800.0, 2: 0.0}, "Groceries": {1: 50.5, 2: 49.5},
                   "Total": {1: 850.5, 2: 59.5}, "Custom": {1: 0.0, 2: 10.0}}


def test_secondary_summary_golden(micro_ledger):
    got = wide(S.summary_long(micro_ledger, "secondary"), "secondary_category")
    assert got == {"": {1: 0.0, 2: 10.0}, "Rent": {1: 800.0, 2: 0.0},
                   "Supermarket": {1: 50.5, 2: 49.5}, "Total": {1: 850.5, 2: 59.5}}


def test_display_order(micro_ledger):
    w = S.summary_wide(micro_ledger, "primary")
    ordered = [r.primary_category for r in S.order_for_display(w, "primary_category").collect()]
    assert ordered == ["Housing", "Groceries", "Total", "Custom"]
    row = {r.primary_category: r for r in w.collect()}["Custom"]
    assert (row["01"], row["02"], row["03"]) == (0.0, 10.0, None)


def test_month_spend_keeps_null_and_total_groups(micro_ledger):
    feb = S.month_spend(micro_ledger, "primary").where("month = 2")
    got = {r.primary_category: r.total_expense_in_ref_currency for r in feb.collect()}
    assert got == {"Groceries": 49.5, "Custom": 10.0, None: 5.0, "Total": 7.0}


def test_total_is_sum_of_rows(micro_ledger):
    s = S.summaries_long(micro_ledger)
    rows = s.where("category <> 'Total'").groupBy("kind", "month").agg(F.sum("amount").alias("s"))
    tot = s.where("category = 'Total'").select("kind", "month", F.col("amount").alias("t"))
    for r in rows.join(tot, ["kind", "month"]).collect():
        assert abs(r.s - r.t) < 1e-9


def test_extra_recorded_month(spark, micro_ledger):
    months = spark.createDataFrame([(2026, 3)], "year int, month int")
    got = wide(S.summary_long(micro_ledger, "primary", months=months), "primary_category")
    assert got["Total"][3] == 0.0 and got["Housing"][3] == 0.0


def test_partition_count_independent(micro_ledger):
    a = rows_of(S.summaries_long(micro_ledger))
    b = rows_of(S.summaries_long(micro_ledger.repartition(5)))
    assert a == b


def test_by_ledger_equals_single(spark, micro_ledger):
    two = micro_ledger.withColumn("ledger_id", F.lit(1)).unionByName(
        micro_ledger.withColumn("ledger_id", F.lit(2)))
    multi = S.summary_long(two, "primary", by=["ledger_id"]).where("ledger_id = 2").drop("ledger_id")
    assert rows_of(multi) == rows_of(S.summary_long(micro_ledger, "primary"))


def test_wide_long_round_trip(micro_ledger):
    long_df = S.summary_long(micro_ledger, "primary")
    back = S.to_long(S.to_wide(long_df, ["year", "primary_category"]), ["year", "primary_category"],
                     value="amount").where("amount is not null")
    assert rows_of(back, "primary_category", "year", "month", "amount") == \
        rows_of(long_df, "primary_category", "year", "month", "amount")


def test_category_totals_all_years(micro_ledger):
    t = {(r.kind, r.category): r.total for r in S.category_totals(S.summaries_long(micro_ledger)).collect()}
    assert t[("primary", "Housing")] == 800.0 and t[("primary", "Custom")] == 10.0
    assert ("secondary", "") not in t and ("primary", "Total") not in t


def test_year_and_month_share(micro_ledger):
    ys = R.year_share(S.summary_long(micro_ledger, "primary"))
    assert {r.category: r.value for r in ys.collect()} == {"Housing": 800, "Groceries": 100, "Custom": 10}
    yw = R.year_share_wide(S.summary_wide(micro_ledger, "primary"))
    assert rows_of(yw) == rows_of(ys)
    ys2 = R.year_share(S.summary_long(micro_ledger, "secondary"), "secondary")
    assert {r.category: r.value for r in ys2.collect()} == {"Rent": 800, "Supermarket": 100}
    ms = R.month_share(micro_ledger).where("month = 2")
    assert {r.category: r.value for r in ms.collect()} == {"Groceries": 50, "Custom": 10, "Total": 7}


def test_months_compared_and_over_months(micro_ledger):
    s = S.summary_long(micro_ledger, "primary")
    mc = R.months_compared(s, [2, 1, 7, 9])
    assert {(r.series, r.category, r.value) for r in mc.collect()} == {
        ("Jan", "Housing", 800), ("Jan", "Groceries", 50), ("Jan", "Custom", 0),
        ("Feb", "Housing", 0), ("Feb", "Groceries", 50), ("Feb", "Custom", 10)}
    co = R.categories_over_months(s, ["Custom", "Nope", "Housing", "Groceries"])
    assert {(r.series, r.month, r.value) for r in co.collect()} == {
        ("Custom", 1, 0), ("Custom", 2, 10), ("Nope", 1, 0), ("Nope", 2, 0), ("Groceries", 1, 50), ("Groceries", 2, 50),
        ("Housing", 1, 800), ("Housing", 2, 0)}


def test_dense_month_grid(spark):
    f = spark.createDataFrame([("a", 2026, 3, 5.0)], "name string, year int, month int, value double")
    g = S.dense_month_grid(f, ["name"])
    vals = {r.month: r.value for r in g.collect()}
    assert len(vals) == 12 and vals[3] == 5.0 and vals[1] == 0.0


def test_merge_month_matches_recompute(spark, micro_ledger):
    stored = S.summary_wide(micro_ledger.where("month = 1"), "primary")
    months = spark.createDataFrame([(2026, 2)], "year int, month int")
    merged = S.merge_months_into_wide(stored, micro_ledger, months, "primary")
    assert rows_of(merged) == rows_of(S.summary_wide(micro_ledger, "primary"))


def test_prune_zero_in_core(spark):
    led = spark.createDataFrame(
        [(1, "a", None, 0.0, "E", 0.0, "Zero", "x", 2026, 1), (2, "b", None, 5.0, "E", 5.0, "Some", "y", 2026, 2)],
        "expense_id long, expense_name string, expense_date date, expense_amount double, currency string, "
        "expense_in_ref_currency double, primary_category string, secondary_category string, year int, month int")
    got = {r.primary_category for r in S.summary_long(led, "primary", prune_zero=True).collect()}
    assert got == {"Some", "Total"}


def test_kept_categories_get_zero_rows(spark, micro_ledger):
    cats = spark.createDataFrame([("primary", "Fees", 2026), ("primary", "Housing", 2026)],
                                 "kind string, category string, year int")
    s = S.summaries_long(micro_ledger, ["primary"], categories=cats)
    got = wide(s.withColumnRenamed("category", "c"), "c")
    assert got["Fees"] == {1: 0.0, 2: 0.0} and got["Housing"] == {1: 800.0, 2: 0.0}
    assert got["Total"] == {1: 850.5, 2: 59.5}
