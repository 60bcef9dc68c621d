import datetime as dt
import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tillbook.sources import io as IO
from tests.conftest import rows_of


def _ledger_table(dates):
    n = len(dates)
    return pa.table({
        "expense_name": ["x"] * n, "expense_date": dates, "expense_amount": [1.5] * n,
        "currency": ["E"] * n, "expense_in_ref_currency": [1.5] * n,
        "primary_category": ["Fees"] * n, "secondary_category": [""] * n})


def test_legacy_layout_with_bad_names(spark, tmp_path):
    root = tmp_path / "dbs"
    good = _ledger_table([dt.date(2026, 1, 3), dt.date(2026, 1, 4)])
    for rel in ["2026/01_detailed_expenses.parquet", "2026/13_detailed_expenses.parquet",
                "2026/x_detailed_expenses.parquet", "abc/02_detailed_expenses.parquet"]:
        os.makedirs(os.path.dirname(root / rel), exist_ok=True)
        pq.write_table(good, root / rel)
    ok, rejects = IO.scan_legacy_ledger(spark, str(root))
    assert rows_of(ok, "year", "month") == [(2026, 1), (2026, 1)]
    assert len({r.expense_id for r in ok.collect()}) == 2
    assert sorted(r.reason for r in rejects.collect()) == [
        "month out of range 1..12", "month prefix is not a number", "year directory is not a number"]


def test_legacy_int_dates_upgrade(spark, tmp_path):
    root = tmp_path / "old"
    t = _ledger_table([0, 0]).set_column(1, "expense_date", pa.array([20454, 20455], pa.int64()))
    os.makedirs(root / "2026")
    pq.write_table(t, root / "2026" / "01_detailed_expenses.parquet")
    ok, _ = IO.scan_legacy_ledger(spark, str(root))
    assert sorted(str(r.expense_date) for r in ok.collect()) == ["2026-01-01", "2026-01-02"]


def test_missing_paths_are_empty(spark, tmp_path):
    assert IO.read_ledger(spark, str(tmp_path / "none")).count() == 0
    ok, rej = IO.scan_legacy_ledger(spark, str(tmp_path / "none"))
    assert ok.count() == 0 and rej.count() == 0
    assert IO.read_mappings_json(spark, str(tmp_path / "none.json")).count() == 0


def test_dynamic_partition_overwrite(spark, micro_ledger, tmp_path):
    root = str(tmp_path / "ledger")
    IO.write_partitioned(micro_ledger, root, files_per_partition=3)
    jan_only = micro_ledger.where("month = 1").withColumn("expense_amount", F.lit(1.0))
    IO.write_partitioned(jan_only, root)
    back = IO.read_ledger(spark, root)
    assert back.where("month = 2").count() == 4
    assert {r.expense_amount for r in back.where("month = 1").collect()} == {1.0}
    assert IO.read_ledger(spark, root, year=2026, month=2).count() == 4


def test_write_legacy_layout_round_trip(spark, micro_ledger, tmp_path):
    root = str(tmp_path / "legacy")
    written = IO.write_legacy_layout(micro_ledger.drop("expense_id"), root)
    assert [w.rsplit("/", 2)[1:] for w in written] == [["2026", "01_detailed_expenses.parquet"], ["2026", "02_detailed_expenses.parquet"]]
    ok, rej = IO.scan_legacy_ledger(spark, root)
    assert ok.count() == 6 and rej.count() == 0


def test_year_tables_upgrade(spark, tmp_path):
    root = tmp_path / "years"
    os.makedirs(root / "2026")
    cols = {f"{m:02d}": [float(m)] for m in range(1, 13)}
    pq.write_table(pa.table({"name": ["Loan"], "type": ["debt"], **cols}), root / "2026" / "credits.parquet")
    long_df = IO.read_year_table(spark, str(root), "credits.parquet", ["name", "currency"], "value")
    rows = long_df.collect()
    assert len(rows) == 12 and {r.currency for r in rows} == {"E"} and {r.year for r in rows} == {2026}
    assert "type" not in long_df.columns


def test_json_sources(spark, tmp_path):
    mp = tmp_path / "maps"
    os.makedirs(mp)
    (mp / "a.json").write_text(json.dumps({"pam": {"primary_category": "groceries",
                                                    "secondary_category": "supermarket"}}))
    got = IO.read_mappings_json(spark, str(mp)).collect()
    assert [(r.name_key, r.primary_category, r.secondary_category) for r in got] == \
        [("pam", "groceries", "supermarket")]
    kc = tmp_path / "known"
    os.makedirs(kc)
    (kc / "k.json").write_text(json.dumps({"primary": ["Fees", "Gifts"]}))
    got = rows_of(IO.read_known_categories_json(spark, str(kc)), "kind", "category")
    assert got == [("primary", "Fees"), ("primary", "Gifts")]


def test_discover_years(spark, micro_ledger):
    years = [r.year for r in IO.discover_years(micro_ledger).collect()]
    assert 2026 in years and dt.date.today().year in years and years == sorted(years)


def test_layout_writer_rerun_replaces_files(spark, micro_ledger, tmp_path):
    root = str(tmp_path / "legacy-rerun")
    df = micro_ledger.drop("expense_id").coalesce(2)
    IO.write_legacy_layout(df, root)
    IO.write_legacy_layout(df, root)
    ok, _ = IO.scan_legacy_ledger(spark, root)
    assert ok.count() == 6
    IO.write_legacy_layout(df.where("month = 2").limit(1), root)  # fewer rows replace more
    ok, _ = IO.scan_legacy_ledger(spark, root)
    assert ok.where("month = 2").count() == 1 and ok.where("month = 1").count() == 2
