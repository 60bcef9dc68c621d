"""Chart datasets C1-C3 and C8 as tidy frames.

The application builds chart options; here only the numbers are produced.
An empty frame stands for "no chart".  Inputs are the long summary
(``summary_long``) or the ledger itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.domains import MONTH_COLUMNS, TOTAL_LABEL, category_column
from tillbook.functions.scalars import from_units, month_abbr, round_whole, units, units_sum
from tillbook.operators.summaries import month_spend


def _chosen(values: Sequence, ordered: bool) -> list:
    """The selections, each once (months in order, categories as given)."""
    return sorted(set(values)) if ordered else list(dict.fromkeys(values))


def months_compared(summary: DataFrame, months: Sequence[int], kind: str = "primary",
                    by: Sequence[str] = ()) -> DataFrame:
    """Each category's amount in the chosen months, whole numbers;
    Total dropped; months not recorded in a year give no rows."""
    cat = category_column(kind)
    chosen = _chosen([int(m) for m in months], True)
    return (summary.where((F.col(cat) != TOTAL_LABEL) & F.col("month").isin(chosen))
            .select(*by, "year", "month", month_abbr("month").alias("series"),
                    F.col(cat).alias("category"), round_whole("amount").alias("value")))


def categories_over_months(summary: DataFrame, categories: Sequence[str], kind: str = "primary",
                           by: Sequence[str] = ()) -> DataFrame:
    """The chosen categories over each year's recorded months, whole
    numbers; a category absent from the summary gives zeros.  Years whose
    summary has no category rows give nothing, and so does an empty choice."""
    cat = category_column(kind)
    chosen = _chosen(list(categories), False)
    rows = summary.where(F.col(cat) != TOTAL_LABEL)
    if not chosen:
        return rows.where(F.lit(False)).select(*by, "year", "month", F.lit("").alias("series"), F.lit(0).cast("long").alias("value"))
    # One conditional aggregation per recorded month (no self-join): the
    # chosen categories' amounts side by side, then one row for each.
    picked = (rows.groupBy(*by, "year", "month")
              .agg(*[F.sum(F.when(F.col(cat) == c, F.col("amount"))).alias(f"_c{i}")
                     for i, c in enumerate(chosen)]))
    entries = F.array(*[F.struct(F.lit(c).alias("series"),
                                 round_whole(F.coalesce(F.col(f"_c{i}"), F.lit(0.0))).alias("value"))
                        for i, c in enumerate(chosen)])
    return picked.select(*by, "year", "month", F.inline(entries))


def year_share(summary: DataFrame, kind: str = "primary", by: Sequence[str] = ()) -> DataFrame:
    """Yearly total per category; only non-blank categories with a
    positive total (tested before rounding), as whole numbers."""
    cat = category_column(kind)
    return (summary.where((F.col(cat) != TOTAL_LABEL) & (F.col(cat) != ""))
            .groupBy(*by, "year", cat).agg(from_units(units_sum("amount")).alias("_t"))
            .where(F.col("_t") > 0)
            .select(*by, "year", F.col(cat).alias("category"), round_whole("_t").alias("value")))


def year_share_wide(wide: DataFrame, kind: str = "primary", by: Sequence[str] = ()) -> DataFrame:
    """C3 from the wide summary (``summary_wide``): the year total is a row
    sum of the twelve month cells in exact units -- no aggregation."""
    cat = category_column(kind)
    total = F.lit(0).cast("long")
    for c in MONTH_COLUMNS:
        total = total + F.coalesce(units(c), F.lit(0).cast("long"))
    return (wide.where((F.col(cat) != TOTAL_LABEL) & (F.col(cat) != ""))
            .withColumn("_t", from_units(total)).where(F.col("_t") > 0)
            .select(*by, "year", F.col(cat).alias("category"), round_whole("_t").alias("value")))


def month_share(ledger: DataFrame, kind: str = "primary", by: Sequence[str] = ()) -> DataFrame:
    """Each month's spend per category straight from the ledger; only
    non-blank categories with a positive total, as whole numbers."""
    cat = category_column(kind)
    a = month_spend(ledger, kind, by, alias="_t")
    return (a.where(F.col(cat).isNotNull() & (F.col(cat) != "") & (F.col("_t") > 0))
            .select(*by, "year", "month", F.col(cat).alias("category"), round_whole("_t").alias("value")))
