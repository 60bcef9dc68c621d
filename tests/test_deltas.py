"""Signed changes, snapshots and the change stream."""

import os

import pytest
from pyspark.sql import functions as F

from tillbook.operators import changes as M
from tillbook.operators import deltas as D
from tillbook.operators import maintenance as MT
from tillbook.operators import summaries as S
from tillbook.sources.snapshots import ConcurrentCommit, SnapshotTable
from tillbook.streaming import change_stream as CS
from tillbook.streaming import summary_stream as ST
from tests.conftest import rows_of

MAPPINGS = "name_key string, primary_category string, secondary_category string"
BATCH = ("seq long, expense_name string, year int, month int, expense_day int, expense_amount double, currency string, "
         "primary_category string, secondary_category string")
EDITS = ("seq long, expense_id long, expense_name string, expense_date string, expense_amount double, currency string, "
         "primary_category string, secondary_category string")
RAW = ("expense_name string, year int, month int, expense_day int, expense_amount double, currency string, "
       "primary_category string, secondary_category string")


@pytest.fixture()
def mappings(spark):
    return spark.createDataFrame([("pam", "groceries", "supermarket"), ("bus", "transport", "local")], MAPPINGS)


@pytest.fixture()
def batch(spark, micro_ledger):
    """Appends, edits and deletes that meet in all ways."""
    appends = spark.createDataFrame([(0, "Pam", 2026, 3, 5, 12.5, None, None, None), (1, "Nobody", 2026, 3, 6, 1.0, None, None, None),
                                     (2, "Bus", 2026, 1, 7, 2.25, None, None, None)], BATCH)
    edits = spark.createDataFrame([(0, 1, None, "2026-02-20", None, None, None, None), (1, 3, None, None, 60.0, None, None, None),
                                   (2, 2, None, None, 1.0, None, None, None), (3, 77, None, None, 1.0, None, None, None),
                                   (4, 4, None, None, None, None, "housing", None)], EDITS)
    deletes = spark.createDataFrame([(2,), (5,), (99,), (5,)], "expense_id long")
    return {"appends": appends, "edits": edits, "deletes": deletes}


def by_hand(ledger, mappings, batch):
    out, _ = M.edit_expenses(ledger, batch["edits"], ())
    out = M.delete_expenses(out, batch["deletes"])
    new, _ = M.new_expenses(ledger, batch["appends"], mappings)
    return out.unionByName(new.select(*out.columns))


def test_feed_equals_the_batch_operators(spark, micro_ledger, mappings, batch):
    feed, rejects = D.change_feed(micro_ledger, mappings, **batch)
    want = by_hand(micro_ledger, mappings, batch)
    assert rows_of(D.apply_feed(micro_ledger, feed)) == rows_of(want)
    assert sorted((r.op, r.seq, r.expense_id, r.reason) for r in rejects.select("op", "seq", F.coalesce("expense_id", F.lit(-1)).alias("expense_id"), "reason").collect()) == [
        ("append", 1, -1, "no mapping and no primary_category"), ("delete", 0, 5, "superseded in batch"), ("delete", 0, 99, "expense not found"),
        ("edit", 2, 2, "superseded in batch"), ("edit", 3, 77, "expense not found")]
    cells = D.signed_cells(micro_ledger).unionByName(D.signed_cells(feed)).groupBy("kind", "category", "year", "month") \
        .agg(F.sum("amt").alias("amt"), F.sum("n").alias("n")).where("n != 0")
    assert rows_of(D.summary_of(cells)) == rows_of(S.summaries_long(want))


def test_maintain_touches_only_its_months_and_never_reads_the_ledger(spark, micro_ledger, mappings, batch, tmp_path):
    table = D.counted_table(spark, str(tmp_path / "cells"))
    assert D.build_cells(table, micro_ledger) == 1 and D.build_cells(table, micro_ledger) == 1
    ledger_path = str(tmp_path / "ledger")
    micro_ledger.write.parquet(ledger_path)
    feed, _ = D.change_feed(spark.read.parquet(ledger_path), mappings, **batch)
    feed_path = str(tmp_path / "feed")
    feed.write.parquet(feed_path)
    stored = spark.read.parquet(feed_path)
    added = D.signed_cells(stored)
    assert ledger_path not in added._jdf.queryExecution().toString()
    before = table.manifest()["months"]
    assert D.maintain(table, stored.where("month = 3"), "march") == 2
    assert {k: v for k, v in table.manifest()["months"].items() if k != "2026-3"} == before
    assert D.maintain(table, stored.where("month != 3"), "others") == 3
    assert D.maintain(table, stored, "others") == 3  # tried again: nothing happens
    assert rows_of(D.summary_of(table.read())) == rows_of(S.summaries_long(by_hand(micro_ledger, mappings, batch)))
    assert rows_of(D.summary_of(table.read(version=1))) == rows_of(S.summaries_long(micro_ledger))


def test_a_month_that_loses_all_rows_stays_recorded(spark, micro_ledger, mappings, tmp_path):
    table = D.counted_table(spark, str(tmp_path / "cells"))
    D.build_cells(table, micro_ledger)
    january = micro_ledger.where("month = 1").select("expense_id")
    feed, rejects = D.change_feed(micro_ledger, mappings, deletes=january)
    D.maintain(table, feed, "no january")
    assert rejects.count() == 0
    got = {(r.kind, r.category, r.month): r.amount for r in D.summary_of(table.read()).collect()}
    assert got[("primary", "Total", 1)] == 0.0 and got[("primary", "Groceries", 1)] == 0.0 and ("primary", "Housing", 1) not in got
    back, _ = D.change_feed(micro_ledger.where("month != 1"), mappings, deletes=january)
    assert back.count() == 0
    D.maintain(table, feed.withColumn("sign", -F.col("sign")), "january again")
    assert rows_of(D.summary_of(table.read())) == rows_of(S.summaries_long(micro_ledger))


def test_ledgers_are_maintained_apart(spark, micro_ledger, mappings, tmp_path):
    both = micro_ledger.withColumn("ledger_id", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))))
    table = D.counted_table(spark, str(tmp_path / "cells"), ["ledger_id"], both.schema)
    D.build_cells(table, both, by=["ledger_id"])
    deletes = spark.createDataFrame([(2, 2), (2, 3)], "ledger_id long, expense_id long")
    feed, _ = D.change_feed(both, mappings.withColumn("ledger_id", F.lit(1).cast("long")), deletes=deletes, by=["ledger_id"])
    D.maintain(table, feed, "b", by=["ledger_id"])
    left = both.join(deletes, ["ledger_id", "expense_id"], "left_anti")
    want = S.summaries_long(left, by=["ledger_id"]).where("amount != 0")
    assert rows_of(D.summary_of(table.read(), by=["ledger_id"]).where("amount != 0")) == rows_of(want)


def test_snapshots_appear_at_once_or_not_at_all(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "name string, year int, month int")
    table = SnapshotTable(spark, str(tmp_path / "t"), rows(("a", 1, 1)).schema)
    assert table.read().count() == 0 and table.versions() == []
    table.commit(rows(("a", 2026, 1), ("b", 2026, 2)), [(2026, 1), (2026, 2)])
    old = table.read()
    bad = rows(("x", 2026, 1)).withColumn("name", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        table.commit(bad, [(2026, 1)])
    with pytest.raises(ValueError):
        table.commit(rows(("x", 2026, 7)), [(2026, 1)])
    assert rows_of(table.read()) == [("a", 2026, 1), ("b", 2026, 2)]
    assert table.commit(rows(("c", 2026, 2)), [(2026, 1), (2026, 2)], "second") == 2
    assert rows_of(table.read()) == [("c", 2026, 2)] and rows_of(old) == [("a", 2026, 1), ("b", 2026, 2)]
    assert rows_of(table.read([(2026, 1)], version=1)) == [("a", 2026, 1)]
    with pytest.raises(ConcurrentCommit):
        table.commit(rows(("d", 2026, 2)), [(2026, 2)], base=1)
    assert table.commit(rows(("e", 2026, 2)), [(2026, 2)], "second") == 2
    table._fs.createNewFile(table._path("claims/3"))  # a writer that died before it published
    with pytest.raises(ConcurrentCommit):
        table.commit(rows(("f", 2026, 2)), [(2026, 2)])
    table.release()
    assert table.commit(rows(("f", 2026, 2)), [(2026, 2)]) == 3
    assert len(table.vacuum(keep=1)) >= 3 and rows_of(table.read()) == [("f", 2026, 2)]
    assert table.versions() == [3]


def arrive(spark, folder, batches):
    for i, rows in enumerate(batches):
        rows.coalesce(1).write.parquet(os.path.join(folder, f"b{i}"))
    return (spark.readStream.schema(batches[0].schema).option("recursiveFileLookup", "true")
            .option("maxFilesPerTrigger", 1).parquet(folder))


def test_stream_with_enrichment_and_retraction(spark, mappings, tmp_path):
    raw = lambda *r: spark.createDataFrame(r, RAW + ", sign int")
    first = raw(("PAM ", 2026, 1, 5, 10.0, None, None, None, 1), ("Bus", 2026, 1, 6, 2.5, None, None, "tram", None),
                ("Ghost", 2026, 1, 7, 9.0, None, None, None, 1), ("Bus", 2026, 2, 31, 9.0, None, None, None, 1),
                ("Rent", 2026, 2, 1, 800.0, None, "housing", None, 1))
    second = raw(("Rent", 2026, 2, 1, 800.0, None, "Housing", "", -1), ("Pam", 2026, 1, 5, 10.0, None, "Groceries", "Supermarket", -1),
                 ("Pam", 2026, 3, 5, 11.0, None, "Groceries", "Supermarket", 1))
    kept = CS.run_change_stream(arrive(spark, str(tmp_path / "in"), [first, second]), mappings, str(tmp_path / "state"), compact_every=2)
    left = spark.createDataFrame([(2.5, "Transport", "Tram", 2026, 1), (11.0, "Groceries", "Supermarket", 2026, 3)],
                                 "expense_in_ref_currency double, primary_category string, secondary_category string, year int, month int")
    assert rows_of(D.summary_of(kept.cells.read(spark))) == rows_of(S.summaries_long(left))
    assert sorted((r.expense_name, r.reason) for r in kept.rejects(spark).collect()) == [
        ("Bus", "invalid date"), ("Ghost", "no mapping and no primary_category")]
    again = first.where("expense_name = 'Bus' AND month = 1")
    kept.take(M.enrichment(again.withColumn("sign", F.lit(1)), mappings), 7)
    kept.take(M.enrichment(again.withColumn("sign", F.lit(1)), mappings), 7)  # the same epoch again, as after a failure
    got = {(r.kind, r.category, r.month): (r.amt, r.n) for r in kept.cells.read(spark).collect()}
    assert got[("primary", "Transport", 1)] == (5_000_000, 2)


def test_empty_streams(spark, mappings, micro_ledger, tmp_path):
    none = spark.createDataFrame([], RAW)
    kept = CS.run_change_stream(arrive(spark, str(tmp_path / "in"), [none]), mappings, str(tmp_path / "state"))
    assert kept.cells.read(spark).collect() == [] and kept.rejects(spark).collect() == []
    table = ST.run_summary_stream(arrive(spark, str(tmp_path / "in2"), [micro_ledger.limit(0)]), str(tmp_path / "state2"))
    assert rows_of(ST.summary_from_cells(table.read(spark))) == []


def test_cashflow_of_an_emptied_year_is_zero_and_cells_may_be_built_by_a_rebuild(spark, micro_ledger, tmp_path):
    from tillbook.sources import io as IO
    root, cells, flow = (str(tmp_path / n) for n in ("ledger", "cells", "flow"))
    IO.write_partitioned(micro_ledger.select(*[c for c in IO.LEDGER_PARTITIONED.fieldNames() if c in micro_ledger.columns]), root)
    MT.rebuild_months(spark, root, cells, [(2026, 1), (2026, 2)])
    assert rows_of(MT.read_summary(spark, cells)) == rows_of(S.summaries_long(micro_ledger))
    income = spark.createDataFrame([], "category string, year int, month int, value double")
    MT.rebuild_cashflow(spark, root, income, flow, [2026])
    assert spark.read.parquet(flow).where("category = 'Spending' AND month = 1").first().value == 850.5
    IO.replace_months(micro_ledger.limit(0), root, [(2026, 1), (2026, 2)])
    MT.rebuild_cashflow(spark, root, income, flow, [2026])
    left = spark.read.parquet(flow).collect()
    assert {r.value for r in left} == {0.0} and {r.month for r in left if r.category == "Spending"} == set(range(1, 13))
