"""Skipping: the trigram index, and years, months and categories without a scan of the ledger."""

import os

from pyspark.sql import functions as F

from tillbook.operators import categories as K
from tillbook.operators import deltas as D
from tillbook.operators import filters as V
from tillbook.sources import io as IO
from tillbook.sources.ngram_index import NgramIndex
from tests.conftest import LEDGER_DDL, rows_of


def _ledger(spark, names):
    return spark.createDataFrame([(i, n, None, float(i), "E", float(i), p, None, 2024 + i % 2, 1 + i % 3) for i, (n, p) in enumerate(names)], LEDGER_DDL)


NAMES = [("Bäckerei Süd", "Food"), ("bakery+north", "food"), ("50% off", "Fun"), (None, "Bakery"), ("ab", None), ("", ""), ("BAKERY", "x"), ("a.b", "Food & co")]


def _index(spark, tmp_path, df):
    root = str(tmp_path / "data")
    return NgramIndex(spark, root, str(tmp_path / "index"), df.schema), root


def test_search_equals_a_whole_scan(spark, tmp_path):
    led = _ledger(spark, NAMES)
    index, root = _index(spark, tmp_path, led)
    assert index.refresh() == 0 and index.search("bakery").count() == 0  # nothing is stored yet
    # one file per row, and folder names that are escaped in paths
    led.where("expense_id < 5").repartitionByRange(5, "expense_id").write.partitionBy("year").parquet(root)
    assert index.refresh() >= 4
    led.where("expense_id >= 5").repartitionByRange(3, "expense_id").write.mode("append").partitionBy("year").parquet(root)
    for again in (False, True):
        for name in (None, "", "bakery", "BÄCK", "ab", "b", "% o", "+no", "a.b", "nothing here"):
            for category in (None, "food", "FOO", "x", "bakery"):
                want = V.search_ledger(led, name, category, 0.5, 6.5)
                assert rows_of(index.search(name, category, 0.5, 6.5), "expense_id") == rows_of(want, "expense_id"), (name, category, again)
        index.refresh()
    assert index.refresh() == 0


def test_files_without_the_trigrams_are_not_read(spark, tmp_path):
    led = _ledger(spark, [(f"name {chr(97 + i) * 3}", "c") for i in range(8)])
    index, root = _index(spark, tmp_path, led)
    led.repartitionByRange(8, "expense_name").write.parquet(root)
    every = index.files("ccc")
    assert len(every) == len(index.files()) >= 6  # not indexed: all are read
    index.refresh()
    assert len(index.files("ccc")) == 1 and index.files("zzz") == [] and len(index.files("cc")) == len(every)
    assert len(index.search("name ccc").inputFiles()) == 1
    led.limit(1).write.mode("append").parquet(root)
    assert len(index.files("zzz")) == 1  # a file that has come since


def test_files_that_go_are_forgotten(spark, tmp_path):
    led = _ledger(spark, NAMES)
    index, root = _index(spark, tmp_path, led)
    IO.write_partitioned(led, root)
    index.refresh()
    IO.replace_months(led.where("expense_id <> 6"), root, [(2024, 1)])
    assert rows_of(index.search("bakery"), "expense_id") == [(1,)]


def test_years_and_months_from_folders(spark, tmp_path, micro_ledger):
    root = str(tmp_path / "ledger")
    assert IO.listed_months(spark, root).count() == 0
    IO.write_partitioned(micro_ledger, root)
    listed = IO.listed_months(spark, root)
    assert rows_of(listed) == rows_of(micro_ledger.select("year", "month").distinct())
    assert listed.inputFiles() == []
    assert rows_of(IO.discover_years(listed)) == rows_of(IO.discover_years(micro_ledger))
    IO.replace_months(micro_ledger.limit(0), root, [(2026, 1)])
    assert rows_of(IO.listed_months(spark, root)) == [(2026, 2)]


def test_domain_and_months_of_stored_cells(spark, tmp_path, micro_ledger):
    known = spark.createDataFrame([("primary", "old one"), ("secondary", "Total")], "kind string, category string")
    table = D.counted_table(spark, str(tmp_path / "cells"))
    assert table.months().count() == 0
    ledger = micro_ledger.repartition(3)
    D.build_cells(table, ledger)
    assert rows_of(table.months()) == rows_of(ledger.select("year", "month").distinct())
    got = K.domain_of_cells(table.read(), known)
    assert rows_of(got) == rows_of(K.category_domain(ledger, known))
    assert all(os.fspath(tmp_path) in f for f in got.inputFiles() if f)  # the cells, not the ledger
    gone = micro_ledger.where("expense_id = 1").withColumn("sign", F.lit(-1))
    D.maintain(table, gone, "rent goes")
    left = K.domain_of_cells(table.read(), known)
    assert rows_of(left) == rows_of(K.category_domain(micro_ledger.where("expense_id <> 1"), known))
    one = table.read([(2026, 2)])
    assert all("_m=2" in f for f in one.inputFiles())
