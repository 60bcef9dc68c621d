"""Cashflow statement: A6, A7, J7 and the datasets C4, C5, C10.

Every (ledger, year) gets a fixed 12-month spine (a bounded explode of
``sequence(1, 12)``); income per fixed category and spending (the month
Total of the primary summary) come from one aggregation over both inputs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillbook.domains import DERIVED_CASHFLOW_ROWS, INCOME_CATEGORIES, TOTAL_LABEL
from tillbook.functions.scalars import guarded_pct, money_sum, round2, units, units_decimal


def cashflow_grid(income: DataFrame, ledger: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A6 + A7 + J7, one row per (by, year, month) with decimal columns:
    the 4 income categories, income, spending, saving, and saving_pct (double).

    Plan: income rows and ledger rows are stacked as columns and folded by
    ONE aggregation to (by, year, month) (each input scanned once, partial
    aggregation map-side), then each (by, year)'s at most 12 months are
    folded into a map and expanded over all 12 months.  Years are those with
    income or expenses.
    """
    keys = [*by, "year", "month"]
    none = F.lit(None).cast("long")
    cols = [*INCOME_CATEGORIES, "Spending"]
    keep = F.col("primary_category").isNotNull() & (F.col("primary_category") != TOTAL_LABEL)
    inc = income.where(F.col("category").isin(INCOME_CATEGORIES)).select(
        *keys, *[F.when(F.col("category") == c, units("value")).alias(c) for c in INCOME_CATEGORIES],
        none.alias("Spending"))
    spend = ledger.select(*keys, *[none.alias(c) for c in INCOME_CATEGORIES],
                          F.when(keep, units("expense_in_ref_currency")).alias("Spending"))
    month = inc.unionByName(spend).groupBy(*keys).agg(*[F.sum(F.col(f"`{c}`")).alias(c) for c in cols])
    folded = (month.groupBy(*by, "year")
              .agg(F.map_from_entries(F.collect_list(
                  F.struct("month", F.struct(*[F.col(f"`{c}`") for c in cols])))).alias("_cells")))
    g = folded.select(*by, "year", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"), "_cells")
    cell = F.try_element_at("_cells", F.col("month"))
    g = g.select(*keys, *[F.coalesce(cell[c], F.lit(0).cast("long")).alias(c) for c in cols])
    income_c = F.col(f"`{INCOME_CATEGORIES[0]}`")
    for c in INCOME_CATEGORIES[1:]:
        income_c = income_c + F.col(f"`{c}`")
    g = g.withColumn("Income", income_c).withColumn("Saving", F.col("Income") - F.col("Spending"))
    out = g.select(*keys, *[units_decimal(F.col(f"`{c}`")).alias(c)
                            for c in [*INCOME_CATEGORIES, "Income", "Spending", "Saving"]])
    return out.withColumn("Saving %", guarded_pct(F.col("Saving").cast("double"),
                                                  F.col("Income").cast("double")))


def cashflow_statement(income: DataFrame, ledger: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Long statement ``(by..., year, month, category, value)``, 8 rows per month."""
    grid = cashflow_grid(income, ledger, by)
    rows = [*INCOME_CATEGORIES, *DERIVED_CASHFLOW_ROWS]
    entries = F.array(*[F.struct(F.lit(r).alias("category"),
                                 F.col(f"`{r}`").cast("double").alias("value")) for r in rows])
    return grid.select(*by, "year", "month", F.inline(entries))


def cashflow_bars(income: DataFrame, ledger: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """C4: Income, Spending, Saving per month rounded to 2; a year whose rounded
    income and spending are all 0 yields no rows."""
    grid = cashflow_grid(income, ledger, by)
    series = ["Income", "Spending", "Saving"]
    entries = F.array(*[F.struct(F.lit(s).alias("series"), round2(F.col(s)).alias("value"))
                        for s in series])
    # Active years by a window over each year's 12 month rows (the grid is
    # already clustered by (by, year)), not by a self-join.
    active = F.max((round2("Income") != 0) | (round2("Spending") != 0)).over(Window.partitionBy(*by, "year"))
    return (grid.withColumn("_any", active).where("_any")
            .select(*by, "year", "month", F.inline(entries))
            .withColumn("value", F.col("value").cast("double")))


def income_share(income: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Income by source for each year, positive totals only, rounded to 2."""
    return (income.where(F.col("category").isin(INCOME_CATEGORIES))
            .groupBy(*by, "year", "category").agg(money_sum("value").alias("total"))
            .where(F.col("total") > 0)
            .select(*by, "year", "category", round2("total").cast("double").alias("value")))
