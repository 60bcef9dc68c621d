"""Inputs that earlier versions got wrong: fractions of a unit, many ledgers in one append, mixed JSON files, blanks, unknown requests, ties."""

from pyspark.sql import functions as F

from tillbook.operators import categories as C
from tillbook.operators import changes as M
from tillbook.operators import filters as V
from tillbook.operators import networth as N
from tillbook.sources import io as IO
from tests.conftest import rows_of

BATCH = ("ledger_id long, seq long, expense_name string, year int, month int, expense_day int, expense_amount double, currency string, "
         "primary_category string, secondary_category string")


def test_small_and_large_positions(spark):
    h = spark.createDataFrame([("gold", "Commodities", 2026, 1, 0.00001), ("fund", "Bonds", 2026, 1, 1e-12), ("big", "Bonds", 2026, 2, 3e12), ("none", "Bonds", 2026, 2, 1.0)],
                              "asset_name string, category string, year int, month int, quantity double")
    p = spark.createDataFrame([("gold", 2026, 1, 60000.0), ("fund", 2026, 1, 5.0), ("big", 2026, 2, 4.5)], "asset_name string, year int, month int, price double")
    assert rows_of(N.position_value(h, p).where("price IS NOT NULL"), "asset_name", "value") == [("big", 1.35e13), ("fund", 5e-12), ("gold", 0.6)]
    balances = spark.createDataFrame([], "year int, month int, value double")
    grid = N.networth_grid(h, p, balances, balances).where("year = 2026 AND month <= 2").select("month", F.col("`Net Worth`").cast("double").alias("nw"))
    assert rows_of(grid) == [(1, 0.600000000005), (2, 1.35e13)]


def test_appends_of_many_ledgers(spark):
    led = spark.createDataFrame([(1, 5), (2, 9)], "ledger_id long, expense_id long")
    rows = [(1, 0, "a"), (2, 0, "b"), (2, 0, "c"), (2, 1, "d"), (None, 0, "e")]
    batch = spark.createDataFrame([(i, s, n, 2026, 1, 1, 1.0, None, "x", None) for i, s, n in rows], BATCH)
    mappings = spark.createDataFrame([], "ledger_id long, name_key string, primary_category string, secondary_category string")
    new, rejects = M.new_expenses(led, batch, mappings, ["ledger_id"])
    assert rows_of(new, "ledger_id", "expense_id", "expense_name") == [(1, 10, "a"), (2, 10, "b"), (2, 11, "d")]
    assert sorted((r.expense_name, r.reason) for r in rejects.collect()) == [("c", "superseded in batch"), ("e", "missing ledger_id")]
    templates = spark.createDataFrame([], "ledger_id long, template_id long, expense_name string, expense_day long, expense_amount double, currency string, "
                                          "primary_category string, secondary_category string")
    adds = spark.createDataFrame([(i, 0, "rent", 5, 1.0, None, "x", None) for i in (1, 2)],
                                 "ledger_id long, seq long, expense_name string, expense_day int, expense_amount double, currency string, primary_category string, secondary_category string")
    out, bad = M.add_recurring(templates, adds, ["ledger_id"])
    assert rows_of(out, "ledger_id", "template_id") == [(1, 0), (2, 0)] and bad.count() == 0


def test_mapping_files_of_both_forms_in_one_folder(spark, tmp_path):
    one = '{"%s": {"primary_category": "p", "secondary_category": "s"}}'
    (tmp_path / "lines one.json").write_text((one % "a") + "\n" + (one % "b") + "\n")
    (tmp_path / "pretty%20.json").write_text((one % "c").replace("{", "{\n ").replace("}", "\n}") + "\n")
    (tmp_path / "single.json").write_text(one % "d")
    assert sorted(r.name_key for r in IO.read_mappings_json(spark, str(tmp_path)).collect()) == ["a", "b", "c", "d"]


def test_mapping_categories_are_stripped(spark):
    none = spark.createDataFrame([], "name_key string, primary_category string, secondary_category string")
    add = spark.createDataFrame([(0, "add", "Pam", "\tFood\n", None, False)], "seq long, op string, expense_name string, primary_category string, secondary_category string, overwrite boolean")
    assert rows_of(M.change_mappings(none, add)[0]) == [("pam", "food", "")]


def test_requests_to_retire_nothing_are_refused(spark):
    known = spark.createDataFrame([("primary", "Old"), ("primary", "Used")], "kind string, category string")
    summary = spark.createDataFrame([("primary", "Used", 2026, 1, 5.0), ("primary", "Zero", 2026, 1, 0.0)], "kind string, category string, year int, month int, amount double")
    totals = spark.createDataFrame([("primary", "Used", 5.0), ("primary", "Zero", 0.0)], "kind string, category string, total double")
    asked = spark.createDataFrame([("primary", c) for c in ("Old", "Used", "Zero", "Ghost", None)] + [(None, "Old")], "kind string, category string")
    left, shown, bad = M.retire_categories(known, summary, totals, asked)
    assert rows_of(left) == [("primary", "Used")] and {r.category for r in shown.collect()} == {"Used"}
    assert {(r.kind, r.category, r.reason) for r in bad.collect()} == {
        ("primary", "Used", "category still has expenses"), ("primary", "Ghost", "category not found"), ("primary", None, "missing category"), (None, "Old", "missing kind")}


def test_totals_round_ties_to_even(spark):
    known = spark.createDataFrame([], "kind string, category string")
    totals = spark.createDataFrame([("primary", "a", 0.125), ("primary", "b", 0.375), ("primary", "c", 1.0)], "kind string, category string, total double")
    assert rows_of(C.categories_with_totals(known, totals), "name", "total") == [("a", 0.12), ("b", 0.38), ("c", 1.0)]


def test_ids_count_over_all_files(spark, micro_ledger, tmp_path):
    root = str(tmp_path / "files")
    many = micro_ledger.crossJoin(spark.range(40).select(F.col("id").alias("_copy"))).drop("expense_id", "_copy").repartition(4)
    IO.write_legacy_layout(many, root)
    led, _ = IO.scan_legacy_ledger(spark, root)
    assert sorted(r.expense_id for r in led.collect()) == list(range(240))
    assert led.where("month = 1").agg(F.max("expense_id")).first()[0] == 79
    assert dict(led.dtypes)["expense_id"] == "bigint"
    left = M.delete_expenses(led, spark.createDataFrame([(0,), (239,), (500,)], "expense_id long"))
    assert left.count() == 238
    sizes = spark.read.parquet(f"{root}/2026/01_detailed_expenses.parquet").groupBy(F.col("_metadata.file_path")).count()
    assert "ReadSchema: struct<>" in sizes._jdf.queryExecution().toString()  # footers only


def test_pages_of_an_index(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 3 > 0, F.col("id") % 7).cast("double").alias("expense_amount"))
    for descending in (False, True):
        index = V.PageIndex.build(rows, str(tmp_path / f"pages{descending}"), "expense_amount", descending, part_rows=150)
        assert spark.read.parquet(f"{index.root}/parts").count() >= 6
        for n in (0, 3, 9, 19, 20, 500):
            assert [r.id for r in index.page(n, 50).collect()] == [r.id for r in V.page(rows, "expense_amount", descending, n, 50).collect()]
    empty = V.PageIndex.build(rows.limit(0), str(tmp_path / "none"), "expense_amount")
    assert empty.page(0).collect() == []


def test_small_batches_do_not_shuffle_the_table(spark, tmp_path):
    table = spark.range(2000).select(F.concat(F.lit("a"), F.col("id") % 200).alias("asset_name"), F.lit("Bonds").alias("category"), F.lit("").alias("link"),
                                     F.lit(2026).alias("year"), (F.col("id") % 12 + 1).cast("int").alias("month"), F.lit(1.0).alias("quantity")).distinct()
    path = str(tmp_path / "holdings")
    table.write.parquet(path)
    stored = spark.read.parquet(path)
    adds = spark.createDataFrame([(0, 2026, "a1", "Bonds", ""), (1, 2026, "new", "Bonds", "")], "seq long, year int, asset_name string, category string, link string")
    out, added, bad = M.add_entities(stored, adds, "asset_name", "quantity")
    assert added.count() == 12 and rows_of(bad, "asset_name", "reason") == [("a1", "already exists")] and out.count() == stored.count() + 12
    renames = spark.createDataFrame([(0, 2026, "a2", "fresh"), (1, 2026, "a3", "a4"), (2, 2026, "ghost", "x")], "seq long, year int, old_name string, new_name string")
    ok, refused = M.rename_entities(stored, renames, "asset_name")
    assert rows_of(ok, "old_name") == [("a2",)] and refused.count() == 2
    values = spark.createDataFrame([(0, 2026, 1, "a5", 9.0), (1, 2026, 99, "a5", 9.0), (2, 2026, 2, "ghost", 9.0)], "seq long, year int, month int, asset_name string, quantity double")
    new, no = M.set_values(stored, values, "asset_name", "quantity")
    assert rows_of(no, "asset_name", "reason") == [("a5", "month out of range"), ("ghost", "not found")]
    assert new.where("asset_name = 'a5' AND quantity = 9.0 AND category = 'Bonds'").count() == 1
    for frame in (added, ok, new):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert path not in plan or "SortMergeJoin" not in plan


def test_a_batch_of_few_but_large_rows_is_not_broadcast(spark, monkeypatch):
    rows = spark.range(10).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    hinted = lambda: "ResolvedHint" in M._resolved(rows, "sized")._jdf.queryExecution().analyzed().toString()
    assert hinted()
    monkeypatch.setattr(M, "BROADCAST_BYTES", 100)
    assert not hinted()
