"""Expense summaries: A1-A5, P6-P8, O1-O2, R1-R3.

Long form is the stored form: ``(by..., [kind,] category, year, month, amount)``.
Wide form (one column per month) is produced only at the edge by ``pivot``
with an explicit value list, so no extra job discovers the months.

Scale notes
-----------
* One aggregation (partial + final hash aggregate) sums the ledger to its
  months and category combinations, in one scan.  Kinds, Total rows (GROUPING SETS) and the
  twelve month cells are made from those sums, never from raw rows.
* The dense grid (gaps are 0.0) expands each category row by the at most 12
  recorded months of its year: a bounded expansion, never a cross join.
* Hot keys (one ledger or category holding a third of the rows) are absorbed
  by the map-side partial aggregation before any shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.domains import KINDS, MONTHS, MONTH_COLUMNS, PRIMARY_DISPLAY_ORDER, TOTAL_LABEL, \
    category_column
from tillbook.functions.scalars import from_units, money, units, units_sum

AMOUNT = "expense_in_ref_currency"


def month_spend(ledger: DataFrame, kind: str = "primary", by: Sequence[str] = (),
                alias: str = "total_expense_in_ref_currency") -> DataFrame:
    """A1: spend per category for every (year, month); a null category is its own group."""
    cat = category_column(kind)
    return (ledger.groupBy(*by, "year", "month", cat)
            .agg(from_units(units_sum(AMOUNT)).alias(alias)))


def _stack(rows: DataFrame, kinds: Sequence[str], by: Sequence[str]) -> DataFrame:
    for k in kinds:
        category_column(k)
    entries = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(category_column(k)).alias("category"))
                        for k in kinds])
    return rows.select(*by, "year", "month", "amt", F.inline(entries))


def _stack_kinds(ledger: DataFrame, kinds: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One row per (ledger row, kind): the chosen category columns stacked."""
    return _stack(ledger.withColumn("amt", units(AMOUNT)), kinds, by)


def _cells(ledger: DataFrame, kinds: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The ledger summed once to its months and category combinations, then stacked by kind."""
    return _stack(ledger.groupBy(*by, "year", "month", *[category_column(k) for k in kinds])
                  .agg(units_sum(AMOUNT).alias("amt")), kinds, by)


def summaries_long(ledger: DataFrame, kinds: Sequence[str] = KINDS, by: Sequence[str] = (),
                   months: DataFrame | None = None, categories: DataFrame | None = None) -> DataFrame:
    """A2 + A3 + A4: dense category x month summary with a Total row per month.

    Rules: null categories and any category literally named ``Total`` are
    removed from the rows and from the Total; a category present in any month
    of a year gets 0.0 in that year's other recorded months; a recorded month
    (any ledger row, even if all its rows were removed) gets a Total row.

    ``months`` optionally adds months to record even without expenses
    (columns ``by..., year, month``).

    Returns ``(by..., kind, category, year, month, amount)`` with amount double.
    """
    return summaries_from_stacked(_cells(ledger, kinds, by), kinds, by, months,
                                  categories=categories)


def _summary_core(stacked: DataFrame, kinds: Sequence[str], by: Sequence[str],
                  months: DataFrame | None, categories: DataFrame | None = None) -> DataFrame:
    """The shared core: one row per (by, kind, year, category-or-Total) with
    twelve month cells in units -- 0 for recorded gaps, null for months the
    year did not record.

    Plan: the input is already summed to cells (or to a stream's running
    totals); GROUPING SETS of (year, category) and (year) with twelve
    month-masked sums fold the cells, and the Total rows are joined back to tell each
    year's recorded months.
    """
    keys = [*by, "kind", "year"]
    if months is not None:
        extra = (months.select(*by, "year", "month").distinct()
                 .withColumn("kind", F.explode(F.array(*[F.lit(k) for k in kinds])))
                 .withColumn("category", F.lit(None).cast("string"))
                 .withColumn("amt", F.lit(None).cast("long")))
        stacked = stacked.select(*by, "kind", "category", "year", "month", "amt").unionByName(extra)
    if categories is not None:
        # Q5: categories to keep (with 0.0) even without expenses; a row with
        # no month joins the year's categories but records no month.
        keep_rows = (categories.select(*by, "kind", "category", "year").distinct()
                     .withColumn("month", F.lit(None).cast("int"))
                     .withColumn("amt", F.lit(0).cast("long")))
        stacked = stacked.select(*by, "kind", "category", "year", "month", "amt").unionByName(keep_rows)
    cat = F.col("category")
    keep = cat.isNotNull() & (cat != TOTAL_LABEL)
    zero = F.lit(0).cast("long")
    # Kept amount, or 0 for removed rows: every row marks its month as recorded.
    contrib = F.when(keep, F.coalesce(F.col("amt"), zero)).otherwise(zero)
    month_sums = [F.sum(F.when(F.col("month") == m, contrib)).alias(f"_m{m}") for m in MONTHS]
    agg = (stacked.groupingSets([[*keys, "category"], keys], *keys, "category")
           .agg(*month_sums, F.grouping("category").alias("_total")))
    # Recorded months of the (ledger, kind, year): the Total row's non-null cells, joined back
    # (few rows; a ledger-year's categories are never gathered in one task).
    flags = F.array(*[F.col(f"_m{m}").isNotNull() for m in MONTHS])
    recorded = agg.where(F.col("_total") == 1).select(*[F.col(k).alias(f"_k_{k}") for k in keys], flags.alias("_rec"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    agg = agg.join(recorded, same)
    total = F.col("_total") == 1
    return (agg.where(total | keep)
            .select(*keys, F.when(total, F.lit(TOTAL_LABEL)).otherwise(cat).alias("category"),
                    *[F.when(F.col("_rec")[m - 1], F.coalesce(F.col(f"_m{m}"), zero)).alias(f"_m{m}")
                      for m in MONTHS]))


def summaries_from_stacked(stacked: DataFrame, kinds: Sequence[str] = KINDS, by: Sequence[str] = (),
                           months: DataFrame | None = None, prune_zero: bool = False,
                           categories: DataFrame | None = None) -> DataFrame:
    """The summary from ``(by..., kind, category, year, month, amt)`` rows,
    where ``amt`` is an amount in units (long): raw ledger rows or any
    pre-aggregated cells of them (sums compose), such as a stream's running
    totals.  Long output: the core's recorded months, one row each.

    ``prune_zero`` (P7 / C11) drops categories that are 0 in every month of
    the year, keeping Total: in the core that is a row predicate.
    ``categories`` (``by..., kind, category, year``) keeps listed categories
    with 0.0 in the year's recorded months even without expenses (Q5).
    """
    core = _summary_core(stacked, kinds, by, months, categories)
    if prune_zero:
        nonzero = F.lit(False)
        for m in MONTHS:
            nonzero = nonzero | F.coalesce(F.col(f"_m{m}") != 0, F.lit(False))
        core = core.where(nonzero | (F.col("category") == TOTAL_LABEL))
    cells = F.array(*[F.struct(F.lit(m).alias("month"), F.col(f"_m{m}").alias("amount")) for m in MONTHS])
    rows = core.select(*by, "kind", "category", "year",
                       F.inline(F.filter(cells, lambda e: e["amount"].isNotNull())))
    return rows.select(*by, "kind", "category", F.col("year").cast("int").alias("year"),
                       F.col("month").cast("int").alias("month"),
                       from_units("amount").alias("amount"))


def summaries_wide_from_stacked(stacked: DataFrame, kinds: Sequence[str] = KINDS,
                                by: Sequence[str] = (), months: DataFrame | None = None,
                                categories: DataFrame | None = None) -> DataFrame:
    """R1 straight from the core: ``(by..., kind, year, category, 01..12)``,
    unrecorded months null.  No explode and no second aggregation."""
    core = _summary_core(stacked, kinds, by, months, categories)
    return core.select(*by, "kind", F.col("year").cast("int").alias("year"), "category",
                       *[from_units(f"_m{m}").alias(c) for m, c in zip(MONTHS, MONTH_COLUMNS)])


def summary_long(ledger: DataFrame, kind: str = "primary", by: Sequence[str] = (),
                 months: DataFrame | None = None, prune_zero: bool = False) -> DataFrame:
    """A2 + A3 for one kind: ``(by..., <kind>_category, year, month, amount)``."""
    cat = category_column(kind)
    return (summaries_from_stacked(_cells(ledger, [kind], by), [kind], by, months, prune_zero)
            .select(*by, F.col("category").alias(cat), "year", "month", "amount"))


def display_rank(category: Column, order: Sequence[str] = PRIMARY_DISPLAY_ORDER) -> Column:
    """O1: position in the display list, then Total, unlisted categories null."""
    ranks = F.create_map(*[x for i, name in enumerate([*order, TOTAL_LABEL])
                           for x in (F.lit(name), F.lit(i))])
    return F.try_element_at(ranks, category)


def order_for_display(df: DataFrame, category: str, order: Sequence[str] = PRIMARY_DISPLAY_ORDER,
                      by: Sequence[str] = ()) -> DataFrame:
    """O1: listed categories, then Total, then unlisted (by name, nulls last)."""
    return df.orderBy(*by, F.asc_nulls_last(display_rank(F.col(category), order)),
                      F.asc_nulls_last(category))


def to_wide(long_df: DataFrame, keys: Sequence[str], value: str = "amount",
            month: str = "month") -> DataFrame:
    """Long -> wide with one column ``01``..``12`` per month.

    The month values are listed explicitly, so Spark plans a single
    aggregation and no job to discover them; unrecorded months are null.
    """
    wide = long_df.groupBy(*keys).pivot(month, MONTHS).agg(F.sum(money(value)).cast("double"))
    return wide.select(*keys, *[F.col(str(m)).alias(c) for m, c in zip(MONTHS, MONTH_COLUMNS)])


def to_long(wide_df: DataFrame, ids: Sequence[str], value: str = "value",
            month_columns: Sequence[str] = MONTH_COLUMNS) -> DataFrame:
    """R2: wide -> long, reading each ``01``..``12`` cell as (month, value)."""
    long_df = wide_df.unpivot(list(ids), list(month_columns), "month_label", value)
    return long_df.select(*ids, F.col("month_label").cast("int").alias("month"), value)


def summary_wide(ledger: DataFrame, kind: str = "primary", by: Sequence[str] = (),
                 order: Sequence[str] = PRIMARY_DISPLAY_ORDER) -> DataFrame:
    """R1 + O1 + O2: the yearly wide summary.

    Columns ``by..., year, <kind>_category, display_rank, 01..12``; for
    primary, ``display_rank`` orders rows as the application shows them
    (listed, Total, unlisted).  Secondary rows sort by name (rank null).
    Built from the summary core's month columns: one aggregation, no pivot.
    """
    cat = category_column(kind)
    wide = summaries_wide_from_stacked(_cells(ledger, [kind], by), [kind], by)
    return _with_rank(wide.withColumnRenamed("category", cat), kind, cat, by, order)


def _with_rank(wide: DataFrame, kind: str, cat: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    rank = display_rank(F.col(cat), order) if kind == "primary" else \
        F.when(F.col(cat) == TOTAL_LABEL, F.lit(0)).cast("int")
    return wide.select(*by, "year", cat, rank.alias("display_rank"), *MONTH_COLUMNS)


def category_totals(long_summary: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A5: all-time total per (kind, category) over every year and month.

    Null and blank categories and Total rows are skipped; zero totals stay.
    Input: ``summaries_long`` output.  Returns ``(by..., kind, category, total)``.
    """
    return (long_summary
            .where(F.col("category").isNotNull() & (F.col("category") != "")
                   & (F.col("category") != TOTAL_LABEL))
            .groupBy(*by, "kind", "category")
            .agg(from_units(F.coalesce(units_sum("amount"), F.lit(0).cast("long"))).alias("total")))


def dense_month_grid(facts: DataFrame, keys: Sequence[str], value: str = "value",
                     fill: float = 0.0) -> DataFrame:
    """Every (keys..., year) present gets all 12 months; missing cells ``fill``.

    Cells are first summed per (keys, year, month) (map-side combine, so a
    hot key holds at most 12 cells), folded to one row per (keys, year)
    holding a month map, then expanded by the fixed 12-month sequence: a
    bounded explode, not a join against a month table.
    """
    cells = facts.groupBy(*keys, "year", "month").agg(F.sum(money(value)).cast("double").alias(value))
    folded = (cells.groupBy(*keys, "year")
              .agg(F.map_from_entries(F.collect_list(F.struct("month", value))).alias("_cells")))
    return (folded
            .select(*keys, "year", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"), "_cells")
            .select(*keys, "year", "month",
                    F.coalesce(F.try_element_at("_cells", F.col("month")),
                               F.lit(fill).cast("double")).alias(value)))


def merge_months_into_wide(wide: DataFrame, ledger: DataFrame, months: DataFrame, kind: str = "primary",
                           by: Sequence[str] = (), order: Sequence[str] = PRIMARY_DISPLAY_ORDER) -> DataFrame:
    """Refresh some month columns of a stored wide summary from the ledger.

    The application's incremental update: the chosen (year, month) columns
    are recomputed from those months' ledger rows, every other recorded
    month is kept, categories new to the year get 0.0 in its other recorded
    months, null and ``Total`` categories drop out and the Total row is
    rebuilt.  Expressed with the batch operators: the stored table is
    unpivoted to cells (its Total row only marks recorded months), the
    chosen months' cells are replaced by fresh ones, and the same one-pass
    summary step and explicit-value pivot produce the new wide table.
    ``months``: ``(by..., year, month)``.
    """
    cat = category_column(kind)
    target = months.select(*by, "year", "month").distinct()
    cells = to_long(wide.select(*by, "year", cat, *MONTH_COLUMNS), [*by, "year", cat], value="amount") \
        .where(F.col("amount").isNotNull())
    stored = cells.join(target, [*by, "year", "month"], "left_anti")
    named = F.col(cat).isNotNull() & (F.col(cat) != TOTAL_LABEL)
    old_cells = stored.select(
        *by, F.lit(kind).alias("kind"), F.when(named, F.col(cat)).alias("category"), "year", "month",
        F.when(named, units("amount")).otherwise(F.lit(0).cast("long")).alias("amt"))
    kept = cells.where(named).select(*by, F.lit(kind).alias("kind"), F.col(cat).alias("category"), "year")
    fresh = _cells(ledger.join(target, [*by, "year", "month"], "left_semi"), [kind], by)
    merged = summaries_wide_from_stacked(old_cells.unionByName(fresh.select(*old_cells.columns)), [kind], by,
                                         months=target, categories=kept)
    return _with_rank(merged.withColumnRenamed("category", cat), kind, cat, by, order)
