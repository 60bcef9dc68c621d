"""Cases behind the registered queries: small inputs that reach each rule."""

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from tillbook.operators import changes as M
from tillbook.operators import maintenance as MT
from tillbook.operators import networth as N
from tillbook.operators import reports as R
from tillbook.operators import summaries as S
from tillbook.session import ensure_checkpoint_dir
from tillbook.sources import io as IO


def test_all_selections_are_kept(micro_ledger):
    s = S.summary_long(micro_ledger, "primary")
    many = ["Housing", "Groceries", "Custom", "Nosuch", "Fees"]
    assert {r.series for r in R.categories_over_months(s, many).collect()} == set(many)
    assert R.categories_over_months(s, []).count() == 0
    assert {r.month for r in R.months_compared(s, range(1, 13)).collect()} == {1, 2}


def test_amounts_below_a_cent_add_up(spark):
    led = spark.range(1000).select(F.lit("A").alias("primary_category"), F.lit("").alias("secondary_category"),
                                   F.lit(0.004).alias("expense_in_ref_currency"), F.lit(2026).alias("year"), F.lit(1).alias("month"))
    assert S.month_spend(led).first()[3] == 4.0
    assert {r.amount for r in S.summary_long(led).collect()} == {4.0}


def test_emptied_month_shows_zero(spark, micro_ledger, tmp_path):
    ledger_root, cells_root = str(tmp_path / "ledger"), str(tmp_path / "cells")
    IO.write_partitioned(micro_ledger, ledger_root)
    IO.write_partitioned(MT.summary_cells(IO.read_ledger(spark, ledger_root)), cells_root)
    IO.replace_months(micro_ledger.where(F.lit(False)), ledger_root, [(2026, 2)])
    MT.rebuild_months(spark, ledger_root, cells_root, [(2026, 2)])
    got = {(r.category, r.month): r.amount for r in MT.read_summary(spark, cells_root).where("kind = 'primary'").collect()}
    assert got[("Total", 2)] == 0.0 and got[("Housing", 2)] == 0.0 and got[("Total", 1)] == 850.5


def test_month_filter_prunes_partitions(spark, micro_ledger, tmp_path):
    IO.write_partitioned(micro_ledger, str(tmp_path / "ledger"))
    plan = IO.read_ledger(spark, str(tmp_path / "ledger"), months=[(2026, 2)])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "year" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_mixed_generations_in_one_root(spark, tmp_path):
    months = {f"{m:02d}": [float(m)] for m in range(1, 13)}
    for year, extra in ((2024, {}), (2025, {"link": ["http://x"]})):
        (tmp_path / str(year)).mkdir()
        pq.write_table(pa.table({"asset_name": ["A"], "category": ["Bonds"], **extra, **months}), tmp_path / str(year) / "investments.parquet")
    got = IO.read_year_table(spark, str(tmp_path), "investments.parquet", ["asset_name", "category", "link"], "quantity")
    assert {(r.year, r.link) for r in got.collect()} == {(2024, ""), (2025, "http://x")}


@pytest.mark.parametrize("first", [pa.int64(), pa.date32()])
def test_mixed_date_types(spark, tmp_path, first):
    for year, kind in ((2024, first), (2025, pa.date32() if first == pa.int64() else pa.int64())):
        (tmp_path / str(year)).mkdir()
        day = [19800] if kind == pa.int64() else [dt.date(1970, 1, 1) + dt.timedelta(days=19800)]
        pq.write_table(pa.table({"expense_name": ["x"], "expense_date": pa.array(day, kind), "expense_amount": [1.0]}),
                       tmp_path / str(year) / "01_detailed_expenses.parquet")
    ok, _ = IO.scan_legacy_ledger(spark, str(tmp_path))
    assert [str(r.expense_date) for r in ok.collect()] == ["2024-03-18"] * 2


def test_mixed_generations_in_one_folder(spark, tmp_path):
    folder = tmp_path / "2024" / "01_detailed_expenses.parquet"
    folder.mkdir(parents=True)
    for name, kind, extra in (("part-0", pa.int64(), {}), ("part-1", pa.date32(), {"primary_category": ["Fees"]})):
        day = [19800] if kind == pa.int64() else [dt.date(2024, 3, 18)]
        pq.write_table(pa.table({"expense_name": [name], "expense_date": pa.array(day, kind), "expense_amount": [1.0], **extra}), folder / f"{name}.parquet")
    ok, rejects = IO.scan_legacy_ledger(spark, str(tmp_path))
    got = sorted((r.expense_name, str(r.expense_date), r.primary_category) for r in ok.collect())
    assert got == [("part-0", "2024-03-18", None), ("part-1", "2024-03-18", "Fees")]
    assert len({r.expense_id for r in ok.collect()}) == 2 and rejects.count() == 0


def test_null_only_columns_are_written_and_read(spark, micro_ledger, tmp_path):
    led = micro_ledger.drop("expense_id").withColumn("secondary_category", F.lit(None).cast("string"))
    IO.write_legacy_layout(led, str(tmp_path))
    ok, _ = IO.scan_legacy_ledger(spark, str(tmp_path))
    assert ok.count() == 6 and {r.secondary_category for r in ok.collect()} == {None}
    with pytest.raises(ValueError):
        IO.write_legacy_layout(led.withColumn("month", F.lit(None).cast("int")), str(tmp_path))


def test_other_year_files(spark, tmp_path):
    for year in (2024, 2025):
        (tmp_path / str(year)).mkdir()
        pq.write_table(pa.table({"primary_category": ["Fees", "Total"], f"{year}-01": [1.0, 1.0], f"{year}-03": [2.0, 2.0]}), tmp_path / str(year) / "summary.parquet")
        pq.write_table(pa.table({"template_id": [1], "expense_name": ["Rent"], "expense_day": [3], "expense_amount": [9.0]}), tmp_path / str(year) / "recurring_expenses.parquet")
    pq.write_table(pa.table({"category": ["Salary"], **{f"{m:02d}": [5.0] for m in range(1, 13)}}), tmp_path / "2024" / "cashflow.parquet")
    s = IO.read_summary_table(spark, str(tmp_path), "summary.parquet", "primary")
    assert rows_of(s.where("primary_category = 'Fees'"), "year", "month", "amount") == [(2024, 1, 1.0), (2024, 3, 2.0), (2025, 1, 1.0), (2025, 3, 2.0)]
    assert rows_of(IO.read_recurring(spark, str(tmp_path)), "year", "template_id", "expense_name") == [(2024, 1, "Rent"), (2025, 1, "Rent")]
    c = IO.read_cashflow(spark, str(tmp_path), [2024, 2025])
    assert c.where("year = 2025").count() == 48 and {r.value for r in c.where("year = 2025").collect()} == {0.0}
    assert c.where("year = 2024").count() == 12


def test_edits_leave_other_rows_alone(spark, micro_ledger):
    odd = micro_ledger.where("expense_id = 1").withColumns({"expense_id": F.lit(9).cast("long"), "expense_date": F.lit(None).cast("date")})
    filed = micro_ledger.where("expense_id = 1").withColumns({"expense_id": F.lit(10).cast("long"), "month": F.lit(2)})
    led = micro_ledger.unionByName(odd).unionByName(filed)
    edits = spark.createDataFrame([(2, 1, "28"), (77, 1, "3"), (None, 1, "3"), (3, 1, "31")], "expense_id long, seq int, expense_date string").withColumns(
        {"expense_name": F.lit("New"), "expense_amount": F.lit(None).cast("double"), "currency": F.lit(None).cast("string"),
         "primary_category": F.lit(None).cast("string"), "secondary_category": F.lit(None).cast("string")})
    out, bad = M.edit_expenses(led, edits)
    assert rows_of(out.where("expense_id != 2"), *led.columns[4:]) == rows_of(led.where("expense_id != 2"), *led.columns[4:])
    assert rows_of(bad, "reason") == [("expense not found",), ("invalid date",), ("missing expense_id",)]


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_batches_do_not_shuffle_the_table(spark, micro_ledger):
    big = spark.range(200_000).select(
        F.col("id").alias("expense_id"), F.lit("n").alias("expense_name"), F.lit("2026-01-05").cast("date").alias("expense_date"),
        F.lit(1.0).alias("expense_amount"), F.lit("E").alias("currency"), F.lit(1.0).alias("expense_in_ref_currency"),
        F.lit("Fees").alias("primary_category"), F.lit("").alias("secondary_category"), F.lit(2026).alias("year"), F.lit(1).alias("month"))
    edit = spark.createDataFrame([(5, 1, "New", "7", 2.0, None, "fees", None)],
                                 "expense_id long, seq int, expense_name string, expense_date string, expense_amount double, currency string, "
                                 "primary_category string, secondary_category string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out, _ = M.edit_expenses(big, edit)
        plan = final_plan(out.agg(F.sum("expense_amount")))
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        cells = big.select(F.concat(F.lit("a"), F.col("expense_id").cast("string")).alias("asset_name"), F.lit("Cash").alias("category"), "year", "month",
                           F.lit(1.0).alias("value"))
        change = spark.createDataFrame([(1, 2026, 1, "a7", 9.0), (2, 2026, 5, "a7", 4.0)], "seq int, year int, month int, asset_name string, value double")
        out, _ = M.set_values(cells, change, "asset_name", "value")
        assert rows_of(out.where("asset_name = 'a7'"), "month", "value", "category") == [(1, 9.0, "Cash"), (5, 4.0, "Cash")]
        assert "SortMergeJoin" not in final_plan(out.agg(F.sum("value"), F.count("*")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_null_keys_and_ties_are_rejects(spark):
    t = spark.createDataFrame([("A", "Bonds", 2026, 1, 1.0)], "asset_name string, category string, year int, month int, quantity double")
    ch = spark.createDataFrame([(1, 2026, None, "Bonds"), (2, 2026, "A", "Bonds")], "seq int, year int, asset_name string, category string")
    out, bad = M.set_attribute(t, ch, "asset_name", "category")
    assert rows_of(bad, "seq", "reason") == [(1, "missing asset_name")] and out.count() == 1
    same = spark.createDataFrame([(1, 2026, "A", "x"), (1, 2026, "A", "y"), (1, 2026, "A", "y")], "seq int, year int, asset_name string, category string")
    out, bad = M.set_attribute(t, same, "asset_name", "category")
    assert {r.category for r in out.collect()} == {"y"} and rows_of(bad, "category") == [("x",), ("y",)]


def test_merge_keeps_emptied_month_and_stored_categories(spark, micro_ledger):
    stored = S.summary_wide(micro_ledger.where("month = 1"), "primary")
    months = spark.createDataFrame([(2026, 1)], "year int, month int")
    merged = S.merge_months_into_wide(stored, micro_ledger.where(F.lit(False)), months, "primary")
    cells = {r.primary_category: r["01"] for r in merged.collect()}
    assert cells == {"Housing": 0.0, "Groceries": 0.0, "Total": 0.0}


def test_stray_years_do_not_stretch_the_spine(spark):
    liq = spark.createDataFrame([("a", "Cash", 2026, 1, 5.0), ("b", "Cash", 9999, 1, 7.0), ("c", "Cash", None, 1, 7.0)],
                                "asset_name string, category string, year int, month int, value double")
    none_h = spark.createDataFrame([], "asset_name string, category string, year int, month int, quantity double")
    none_p = spark.createDataFrame([], "asset_name string, year int, month int, price double")
    none_c = spark.createDataFrame([], "name string, year int, month int, value double")
    assert N.networth_grid(none_h, none_p, liq, none_c).count() == 12
    assert N.stray_months(liq).count() == 2


def test_checkpoint_folder_is_required(spark, monkeypatch):
    class Bare:
        class sparkContext:  # noqa: N801
            @staticmethod
            def getCheckpointDir():  # noqa: N802
                return None

            @staticmethod
            def getConf():  # noqa: N802
                return {}
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Bare)
