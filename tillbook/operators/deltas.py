"""Signed changes: summaries kept current from the changes alone.

A change feed holds ledger rows with a ``sign``: 1 for a row that comes, -1 for one that goes; an edit is both.
Cells carry, beside their sum in whole units, the number of rows behind them, so a cell whose last row has gone is told from
one whose rows add up to zero.  Signed cells are added to stored ones: neither the ledger nor the other months are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.domains import KINDS, category_column
from tillbook.functions.scalars import units
from tillbook.operators.changes import _first_per_key, _resolved, new_expenses, resolved_edits, with_edits
from tillbook.operators.summaries import AMOUNT, summaries_from_stacked
from tillbook.session import stored
from tillbook.sources.snapshots import SnapshotTable


def _signed(rows: DataFrame, sign: int) -> DataFrame:
    return rows.withColumn("sign", F.lit(sign))


def change_feed(ledger: DataFrame, mappings: DataFrame, appends: DataFrame | None = None, edits: DataFrame | None = None,
                deletes: DataFrame | None = None, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The signed ledger rows of a batch of appends (M1), edits (M3) and deletes (M2, ids), and the refused changes ``(op, <by>, seq, expense_id, reason)``.

    All changes are checked against the ledger before the batch; an edit of a row that is also deleted is refused.  The ledger is
    scanned for the named ids (and, for edits, the spellings of their months) and not shuffled for a small batch.
    """
    keys = [*by, "expense_id"]
    columns = ledger.columns
    feed, rejects = [], []

    def refused(rows: DataFrame, op: str) -> None:
        pick = [(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in (("seq", "long"), ("expense_id", "long"))]
        rejects.append(rows.select(F.lit(op).alias("op"), *by, *pick, "reason"))

    gone = None
    if deletes is not None:
        asked = deletes if "seq" in deletes.columns else deletes.withColumn("seq", F.lit(0).cast("long"))
        once, repeated = _first_per_key(asked.select(*keys, "seq"), keys)
        once = _resolved(once, "deletes")
        out = stored(ledger.join(once.select(*keys), keys, "left_semi").select(*columns), "deleted-rows")
        gone = _resolved(out.select(*keys).distinct(), "deleted-ids")
        feed.append(_signed(out, -1))
        refused(repeated, "delete")
        refused(once.join(gone, keys, "left_anti").withColumn("reason", F.lit("expense not found")), "delete")
    if edits is not None:
        if gone is not None:
            refused(edits.join(gone, keys, "left_semi").withColumn("reason", F.lit("superseded in batch")), "edit")
            edits = edits.join(gone, keys, "left_anti")
        resolved, bad = resolved_edits(ledger, edits, by)
        old = stored(ledger.join(resolved.select(*keys), keys, "left_semi").select(*columns), "edited-before")
        feed += [_signed(old, -1), _signed(with_edits(old, resolved, by).select(*columns), 1)]
        refused(bad, "edit")
    if appends is not None:
        new, bad = new_expenses(ledger, appends, mappings, by)
        feed.append(_signed(new.select(*columns), 1))
        refused(bad, "append")
    if not feed:
        return _signed(ledger.limit(0), 1), ledger.limit(0).select(F.lit("").alias("op"), *by, F.lit(0).cast("long").alias("seq"), "expense_id", F.lit("").alias("reason"))
    all_rows, all_rejects = feed[0], rejects[0]
    for f in feed[1:]:
        all_rows = all_rows.unionByName(f)
    for r in rejects[1:]:
        all_rejects = all_rejects.unionByName(r)
    return all_rows, all_rejects


def apply_feed(ledger: DataFrame, feed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The ledger after a feed: rows whose id goes are left out, rows that come are added."""
    keys = [*by, "expense_id"]
    out = _resolved(feed.where("sign < 0").select(*keys).distinct(), "feed-ids")
    return ledger.join(out, keys, "left_anti").unionByName(feed.where("sign > 0").select(*ledger.columns))


def cells_schema(by: Sequence[str] = (), ledger: T.StructType | None = None) -> T.StructType:
    """Columns of counted cells; ``by`` columns have the ledger's types, else they are text."""
    own = [T.StructField(c, ledger[c].dataType if ledger is not None else T.StringType()) for c in by]
    return T.StructType([*own, *T.StructType.fromDDL("kind string, category string, year int, month int, amt long, n long").fields])


def signed_cells(feed: DataFrame, kinds: Sequence[str] = KINDS, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., kind, category, year, month, amt, n)``: what a feed adds to every cell; a ledger's own rows count as coming.
    Rows without a year or month have no cell.

    One aggregation over the feed's months and category combinations (map-side combined), then one over those by kind.
    """
    sign = F.col("sign").cast("long") if "sign" in feed.columns else F.lit(1).cast("long")
    columns = [category_column(k) for k in kinds]
    sums = feed.where("year IS NOT NULL AND month IS NOT NULL").groupBy(*by, "year", "month", *columns).agg(
        F.sum(sign * F.coalesce(units(AMOUNT), F.lit(0))).alias("amt"), F.sum(sign).alias("n"))
    entries = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("category")) for k, c in zip(kinds, columns, strict=True)])
    return (sums.select(*by, F.inline(entries), "year", "month", "amt", "n")
            .groupBy(*by, "kind", "category", "year", "month").agg(F.sum("amt").alias("amt"), F.sum("n").alias("n")))


def summary_of(cells: DataFrame, kinds: Sequence[str] = KINDS, by: Sequence[str] = ()) -> DataFrame:
    """The dense summary with Total rows (A4) of counted cells."""
    return summaries_from_stacked(cells.select(*by, "kind", "category", "year", "month", "amt"), kinds, by)


def counted_table(spark: SparkSession, root: str, by: Sequence[str] = (), ledger: T.StructType | None = None) -> SnapshotTable:
    """The stored counted cells under ``root``."""
    return SnapshotTable(spark, root, cells_schema(by, ledger))


def build_cells(table: SnapshotTable, ledger: DataFrame, kinds: Sequence[str] = KINDS, by: Sequence[str] = ()) -> int:
    """First build: the counted cells of a whole ledger."""
    cells = stored(signed_cells(ledger, kinds, by), "first-cells")
    return table.commit(cells, _months(cells), "first build")


def _months(cells: DataFrame) -> list[tuple[int, int]]:
    """The months of some cells (as many as months of history, whatever the rows)."""
    return [(r.year, r.month) for r in cells.select("year", "month").distinct().collect()]


def maintain(table: SnapshotTable, feed: DataFrame, batch: str, kinds: Sequence[str] = KINDS, by: Sequence[str] = ()) -> int:
    """M17 from a batch: add a feed's signed cells to the stored cells of its months and publish them as one version.

    Only the cells of the feed's months are read and written, the ledger is not.  A cell without rows goes; a month that
    has lost all its rows stays recorded by a zero cell without a category, so its summary shows 0.0.  The batch is applied once, also
    when it is tried again after a failure.
    """
    now = table.manifest()
    if batch in now["batches"]:
        return now["version"]
    added = stored(signed_cells(feed, kinds, by), "signed-cells")
    months = _months(added)
    keys = [*by, "kind", "category", "year", "month"]
    both = table.read(months, now["version"]).unionByName(added)
    summed = both.groupBy(*keys).agg(F.sum("amt").alias("amt"), F.sum("n").alias("n"))
    # of cells without rows only the mark of the month is left
    mark = F.when(F.col("n") != 0, F.col("category"))
    rows = summed.withColumn("category", mark).groupBy(*keys).agg(F.sum("amt").alias("amt"), F.sum("n").alias("n"))
    return table.commit(rows.select(*table.schema.fieldNames()), months, batch, now["version"])
