"""Footers read in tasks and remembered: what is listed, opened again, grouped and returned."""

import datetime as dt
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tillbook.sources import footers as FT
from tillbook.sources import io as IO


def _month(root, year, month, kind, rows=2, folder=None):
    days = [19800 + i for i in range(rows)]
    values = days if kind == pa.int64() else [dt.date(1970, 1, 1) + dt.timedelta(days=d) for d in days]
    path = root / str(year) / f"{month:02d}_detailed_expenses.parquet"
    (path if folder else path.parent).mkdir(parents=True, exist_ok=True)
    target = path / folder if folder else path
    pq.write_table(pa.table({"expense_name": ["x"] * rows, "expense_date": pa.array(values, kind), "expense_amount": [1.0] * rows}), target)
    return target


def _pattern(root):
    return os.path.join(str(root), "*", "*" + IO.LEDGER_FILE_SUFFIX)


def test_files_and_folders_are_listed_and_hidden_ones_are_not(spark, tmp_path):
    _month(tmp_path, 2024, 1, pa.int64())
    for name in ("part 0%41.parquet", "part-1.parquet", "_part-2.parquet", ".part-3.parquet", "part-4.parquet.crc"):
        _month(tmp_path, 2024, 2, pa.date32(), rows=3, folder=name)
    got = {(os.path.basename(r.file), r.rows) for r in FT.footers(spark, _pattern(tmp_path)).collect()}
    assert got == {("01_detailed_expenses.parquet", 2), ("part 0%41.parquet", 3), ("part-1.parquet", 3)}
    ok, rejects = IO.scan_legacy_ledger(spark, str(tmp_path))
    assert sorted(r.expense_id for r in ok.collect()) == list(range(8)) and rejects.count() == 0


def test_nothing_stored_yet(spark, tmp_path):
    index = FT.FooterIndex(spark, str(tmp_path / "index"))
    assert FT.footers(spark, _pattern(tmp_path / "none"), index).count() == 0
    assert FT.footers(spark, _pattern(tmp_path / "none")).count() == 0
    assert not (tmp_path / "index").exists()


def test_only_new_and_changed_files_are_opened(spark, tmp_path, monkeypatch):
    index, opened = FT.FooterIndex(spark, str(tmp_path / "index")), []
    real = FT.read_footers

    def counted(files):
        opened.append(sorted(os.path.basename(r.file)[:2] for r in files.collect()))
        return real(files)
    monkeypatch.setattr(FT, "read_footers", counted)
    root = tmp_path / "data"
    _month(root, 2024, 1, pa.int64())
    gone = _month(root, 2024, 2, pa.int64())
    assert index.footers(_pattern(root)).count() == 2
    assert index.footers(_pattern(root)).count() == 2
    assert opened == [["01", "02"]]
    changed = _month(root, 2024, 1, pa.date32(), rows=5)
    os.utime(changed, (2_000_000_000, 2_000_000_000))
    _month(root, 2024, 3, pa.int64(), rows=4)
    gone.unlink()
    assert sorted((os.path.basename(r.file)[:2], r.rows) for r in index.footers(_pattern(root)).collect()) == [("01", 5), ("03", 4)]
    assert opened == [["01", "02"], ["01", "03"]]


def test_rows_added_twice_by_refreshes_at_a_time_count_once(spark, tmp_path):
    index, root = FT.FooterIndex(spark, str(tmp_path / "index")), tmp_path / "data"
    _month(root, 2024, 1, pa.int64())
    once = index.footers(_pattern(root))
    FT.read_footers(once.select(*FT.FILE)).write.mode("append").parquet(index.path)
    assert index.footers(_pattern(root)).count() == 1


@pytest.mark.parametrize("remembered", [False, True])
def test_scan_with_index_equals_scan_without(spark, tmp_path, remembered):
    root, index = tmp_path / "data", FT.FooterIndex(spark, str(tmp_path / "index"))
    _month(root, 2024, 1, pa.int64())
    _month(root, 2024, 13, pa.date32())
    if remembered:
        index.footers(_pattern(root))
    _month(root, 2025, 1, pa.date32(), folder="part-0.parquet")
    _month(root, 2025, 1, pa.int64(), rows=3, folder="part-1.parquet")
    want, bad = IO.scan_legacy_ledger(spark, str(root))
    got, got_bad = IO.scan_legacy_ledger(spark, str(root), index)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 7
    assert [(r.reason, r.rows) for r in got_bad.collect()] == [(r.reason, r.rows) for r in bad.collect()] == [("month out of range 1..12", 2)]
    assert {str(r.d) for r in got.select(F.min("expense_date").alias("d")).collect()} == {"2024-03-18"}


def test_files_that_python_cannot_open_are_told_by_the_driver(spark, tmp_path, monkeypatch):
    _month(tmp_path, 2024, 1, pa.int64())
    _month(tmp_path, 2025, 1, pa.date32())
    closed = FT.footers(spark, _pattern(tmp_path)).withColumn("columns", F.lit(None).cast("array<string>"))
    monkeypatch.setattr(IO, "footers", lambda *a: closed)
    ok, _ = IO.scan_legacy_ledger(spark, str(tmp_path))
    assert len(IO._generations(spark, _pattern(tmp_path))) == 2 and ok.count() == 4


def test_driver_opens_no_file(spark, tmp_path, monkeypatch):
    _month(tmp_path, 2024, 1, pa.int64())
    _month(tmp_path, 2025, 1, pa.date32())
    monkeypatch.setattr(IO, "_driver_footer", lambda *a: pytest.fail("the driver opened a footer"))
    ok, _ = IO.scan_legacy_ledger(spark, str(tmp_path), FT.FooterIndex(spark, str(tmp_path / "index")))
    assert ok.count() == 4
