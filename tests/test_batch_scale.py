"""Batches about as large as the table they change: what tasks hold and sort."""
from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tillbook.operators import changes as M
from tillbook.operators import maintenance as MT


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_wide_templates_are_dealt_anew_before_they_are_sorted(spark):
    pairs = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (1, 10)], "lid long, p long").distinct()
    wide = spark.createDataFrame([(10, "Rent", 5, 9.0, "E", "A", "B"), (11, "Rent", 5, 8.0, "E", "A", "B")],
                                 "template_id long, expense_name string, expense_day long, expense_amount double, currency string, primary_category string, secondary_category string")
    templates = pairs.join(F.broadcast(wide), F.col("p") == F.col("template_id")).drop("p")
    ledger = spark.createDataFrame([(1, 2024, 2, "Rent", "2024-02-04"), (2, 2024, 3, "Rent", "2024-03-05"), (2, 2024, 1, "Rent", "2024-01-05")],
                                   "lid long, year int, month int, expense_name string, d string").withColumn("expense_date", F.to_date("d"))
    out = M.apply_recurring(ledger, templates, ledger.select("lid", "year", "month"), by=["lid"])
    assert [(r.lid, r.template_id, str(r.expense_date)) for r in out.collect()] == [(1, 10, "2024-02-05")]
    plan = _plan(M._first_templates(templates.repartition("lid", "expense_name", "expense_day", "template_id"), ["lid"]))
    assert "REPARTITION_BY_COL" in plan
    assert "REPARTITION_BY_COL" in out._jdf.queryExecution().toString()


@pytest.mark.parametrize("rows", [0, M.BROADCAST_ROWS])
def test_renames_are_worked_out_once_and_names_are_cut_only_by_a_small_batch(spark, monkeypatch, rows):
    monkeypatch.setattr(M, "BROADCAST_ROWS", rows)
    seen = spark.sparkContext.accumulator(0)

    def counted(name):
        seen.add(1)
        return name
    table = spark.createDataFrame([(2024, "A", 1, 1.0), (2024, "A", 2, 2.0), (2024, "B", 1, 3.0), (2023, "C", 1, 4.0), (None, None, 1, 5.0)],
                                  "year int, asset_name string, month int, quantity double")
    renames = spark.createDataFrame([(1, 2024, "A", "Z"), (2, 2024, "A", "Y"), (3, 2024, "B", "A"), (4, 2024, "Q", "R"), (5, 2023, "C", "C"), (6, 2024, None, "W"), (7, 2024, "B", "Z")],
                                    "seq long, year int, old_name string, new_name string")
    renames = renames.withColumn("new_name", F.udf(counted)("new_name"))
    ok, bad = M.rename_entities(table, renames, "asset_name")
    assert sorted((r.year, r.old_name, r.new_name) for r in ok.collect()) == [(2023, "C", "C"), (2024, "A", "Z")]
    assert sorted((r.seq, r.reason) for r in bad.collect()) == [
        (2, "superseded in batch"), (3, "already exists"), (4, "not found"), (6, "missing name"), (7, "superseded in batch")]
    out = M.apply_renames(table, ok, "asset_name")
    assert sorted((str(r.asset_name), r.month) for r in out.collect()) == [("B", 1), ("C", 1), ("None", 1), ("Z", 1), ("Z", 2)]
    assert seen.value == 7


def test_months_of_set_entities_fold_as_numbers(spark, monkeypatch):
    plans, real = {}, M._resolved
    monkeypatch.setattr(M, "_resolved", lambda df, name: plans.setdefault(name, _plan(df)) and real(df, name))
    table = spark.createDataFrame([(2024, "A", "x", 1, 1.0), (2024, "A", "w", 12, 2.0), (2024, "A", None, None, 3.0), (2024, "B", None, 99, 4.0)],
                                  "year int, asset_name string, category string, month int, quantity double")
    ch = spark.createDataFrame([(1, 2024, "A", 1, 10.0), (2, 2024, "A", 7, 20.0), (3, 2024, "A", 12, None), (4, 2024, "B", 3, 30.0), (5, 2024, "C", 1, 40.0), (6, 2024, "A", 7, 21.0)],
                               "seq long, year int, asset_name string, month int, quantity double")
    out, bad = M.set_values(table, ch, "asset_name", "quantity")
    got = {(r.asset_name, r.category, r.month, r.quantity) for r in out.collect()}
    assert got == {("A", "x", 1, 10.0), ("A", "w", 12, None), ("A", None, None, 3.0), ("A", "w", 7, 21.0), ("B", None, 99, 4.0), ("B", None, 3, 30.0)}
    assert sorted((r.seq, r.reason) for r in bad.collect()) == [(2, "superseded in batch"), (5, "not found")]
    assert "collect_set" not in plans["checked-values"]


def test_cells_of_many_ledgers_take_one_shuffle(spark, micro_ledger):
    led = micro_ledger.withColumn("lid", F.lit(1))
    cells = MT.summary_cells(led, by=["lid"])
    assert _plan(cells).count("Exchange hashpartitioning") == 1
    got = {(r.kind, str(r.category), r.month): r.amt for r in cells.collect()}
    assert got[("primary", "Groceries", 1)] == 50_500_000 and ("primary", "None", 2) in got and len(got) == 12
