"""The layout's scan and writes do their work per file, not per row, and by as many tasks as a shuffle has."""
from __future__ import annotations

import os

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tillbook.plans import io_queries as Q
from tillbook.sources import io as IO


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _file(root, folder, month, rows, name=None):
    path = root / folder / f"{month}{IO.LEDGER_FILE_SUFFIX}"
    (path if name else path.parent).mkdir(parents=True, exist_ok=True)
    pq.write_table(pa.table({"expense_name": [f"{folder}-{month}-{i}" for i in range(rows)], "expense_amount": [1.0] * rows}), path / name if name else path)


def test_paths_are_parsed_per_file_and_rejects_are_counted_by_footers(spark, tmp_path):
    root = tmp_path / "a b%c"
    _file(root, "2024", "02", 3, "part-0.parquet")
    _file(root, "2024", "02", 2, "part 1%41.parquet")
    _file(root, "2024", "01", 2)
    _file(root, "2023", "12", 0)
    _file(root, "2024", "13", 4)
    _file(root, "2024", "14", 0)
    _file(root, "old", "05", 1)
    ok, bad = IO.scan_legacy_ledger(spark, str(root))
    got = sorted((r.expense_id, r.expense_name, r.year, r.month) for r in ok.collect())
    assert [g[0] for g in got] == list(range(7)) and [g[2:] for g in got] == [(2024, 1)] * 2 + [(2024, 2)] * 5
    assert all(name.startswith(f"{y}-{m:02d}-") for _, name, y, m in got)
    rejected = sorted((os.path.basename(r.file_path)[:2], r.reason, r.rows) for r in bad.collect())
    assert rejected == [("05", "year directory is not a number", 1), ("13", "month out of range 1..12", 4)]
    assert all("a%20b%25c" in r.file_path for r in bad.collect())
    for frame in (ok, bad):
        assert "regexp" not in _plan(frame).lower() and " RLIKE " not in _plan(frame)


def test_files_of_a_store_that_only_spark_reads_count_their_rows(spark, tmp_path):
    _file(tmp_path, "2024", "01", 3)
    file = spark.read.parquet(str(tmp_path / "*" / "*")).select("_metadata.file_path").first()[0]
    columns, rows = IO._driver_footer(spark, file)
    assert rows == 3 and "expense_name" in columns[0]


def test_a_ledger_in_parts_is_dealt_over_a_shuffles_tasks(spark, tmp_path):
    led = spark.range(4000).select(F.concat(F.lit("n"), F.col("id") % 97).alias("expense_name"), F.lit(2024).alias("year"), (F.col("id") % 12 + 1).cast("int").alias("month"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert Q.in_parts(led).rdd.getNumPartitions() == tasks > 5
    IO.write_legacy_layout(Q.in_parts(led), str(tmp_path))
    files = [f for f in tmp_path.glob("2024/*/*.parquet")]
    per_month = [sum(f.parent.name == f"{m:02d}{IO.LEDGER_FILE_SUFFIX}" for f in files) for m in range(1, 13)]
    assert 2 <= min(per_month) and max(per_month) <= 5


def test_year_tables_take_the_year_of_their_file(spark, tmp_path):
    for year in ("2023", "2024", "old"):
        (tmp_path / year).mkdir()
        pq.write_table(pa.table({"asset_name": [f"A{year}"], "category": ["Bonds"], "link": [""], "year": [1], **{c: [1.0] for c in IO.MONTH_COLUMNS}}), tmp_path / year / "investments.parquet")
    got = IO.read_year_table(spark, str(tmp_path), "investments.parquet", ["asset_name", "category", "link"], "quantity")
    assert {(r.asset_name, r.year) for r in got.collect()} == {("A2023", 2023), ("A2024", 2024), ("Aold", None)}
    assert "regexp" not in _plan(got).lower()
