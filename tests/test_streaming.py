import os

from pyspark.sql import functions as F

from tillbook.operators import summaries as S
from tillbook.streaming import summary_stream as ST
from tests.conftest import rows_of


def test_stream_equals_batch(spark, micro_ledger, tmp_path):
    src = str(tmp_path / "in")
    # Two arrivals; the second holds an earlier month (late data, no watermark).
    micro_ledger.where("month = 2").coalesce(1).write.parquet(os.path.join(src, "b1"))
    micro_ledger.where("month = 1").coalesce(1).write.parquet(os.path.join(src, "b2"))
    stream = (spark.readStream.schema(micro_ledger.schema).option("recursiveFileLookup", "true")
              .option("maxFilesPerTrigger", 1).parquet(src))
    table = ST.run_summary_stream(stream, str(tmp_path / "state"))
    assert spark.read.parquet(f"{table.root}/log").select("epoch").distinct().count() >= 2
    streamed = ST.summary_from_cells(table.read(spark))
    assert rows_of(streamed) == rows_of(S.summaries_long(micro_ledger))


def test_replayed_epoch_is_idempotent(spark, micro_ledger, tmp_path):
    table = ST.CellTable(str(tmp_path / "cells"))
    cells = ST.running_cells(micro_ledger)
    table.merge(cells, 0)
    table.merge(cells, 0)  # the same epoch again, as after a failure
    assert spark.read.parquet(f"{table.root}/log").count() == cells.count()
    assert rows_of(ST.summary_from_cells(table.read(spark))) == rows_of(S.summaries_long(micro_ledger))


def test_later_epoch_wins_and_compaction(spark, micro_ledger, tmp_path):
    table = ST.CellTable(str(tmp_path / "cells"))
    jan = ST.running_cells(micro_ledger.where("month = 1"))
    table.merge(jan, 0)
    table.merge(ST.running_cells(micro_ledger), 1)
    expect = rows_of(S.summaries_long(micro_ledger))
    assert rows_of(ST.summary_from_cells(table.read(spark))) == expect
    table.compact(spark, 1)
    assert rows_of(ST.summary_from_cells(table.read(spark))) == expect
    table.merge(ST.running_cells(micro_ledger.where("expense_id = 1")).withColumn("amt", F.lit(7).cast("long")), 2)
    got = {(r.kind, r.category, r.month): r.amt for r in table.read(spark).collect()}
    assert got[("primary", "Housing", 1)] == 7 and len(got) == len(ST.running_cells(micro_ledger).collect())
    table.merge(ST.running_cells(micro_ledger), 1)  # a replayed epoch from before the base changes nothing
    assert {(r.kind, r.category, r.month): r.amt for r in table.read(spark).collect()} == got
