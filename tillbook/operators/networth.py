"""Net worth: J4, A8-A12, W2, W3 and the datasets C6, C7, C9, C12.

Components are aggregated to (by, year, month) first; the month-on-month
change window runs only over those month-level rows, partitioned by ``by``.
Values stay exact decimals until the output boundary, so totals do not
depend on partitioning or summation order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillbook.domains import INVESTMENT_CATEGORIES, TOTAL_LABEL
from tillbook.functions.scalars import round2
from tillbook.schemas import POSITION_SCALE

VALUE_DEC = f"decimal(38,{2 * POSITION_SCALE})"


def _zero():
    return F.lit(0).cast(VALUE_DEC)


def position_value(holdings: DataFrame, prices: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Quantity x price per asset and month; a missing price gives null.

    Left join from holdings on (by, asset_name, year, month); prices are not
    carried forward.  ``value`` is double; ``value_dec`` the decimal: exact while both factors have at most
    ``POSITION_SCALE`` decimals, else that of their product as doubles.  Values of 1e20 or more fail loudly.
    """
    keys = [*by, "asset_name", "year", "month"]
    p = prices.select(*keys, "price")
    j = holdings.join(p, keys, "left")
    quantity, price = F.col("quantity").try_cast(f"decimal(19,{POSITION_SCALE})"), F.col("price").try_cast(f"decimal(18,{POSITION_SCALE})")
    whole = (quantity.cast("double") == F.col("quantity")) & (price.cast("double") == F.col("price"))
    exact = F.when(whole, (quantity * price).cast(VALUE_DEC)).otherwise((F.col("quantity") * F.col("price")).cast(VALUE_DEC))
    return (j.withColumn("value_dec", exact)
            .withColumn("value", F.col("value_dec").cast("double")))


COMPONENTS = [*INVESTMENT_CATEGORIES, "Liquidity", "Credits/Debts"]


def _c(name: str):
    return F.col(f"`{name}`")


#: Years that a month spine may span.
PLAUSIBLE_YEARS = (1900, 2200)


def stray_months(facts: DataFrame) -> DataFrame:
    """Rejects of the net-worth spine: rows whose year is null or outside ``PLAUSIBLE_YEARS``."""
    year = F.col("year")
    return facts.where(year.isNull() | ~year.between(*PLAUSIBLE_YEARS)).withColumn("reason", F.lit("year out of range"))


def networth_grid(holdings: DataFrame, prices: DataFrame, liquidity: DataFrame,
                  credits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A8-A11 and W2/W3 on a dense month spine.

    Plan: the three inputs are stacked as component columns and folded by
    ONE aggregation to (by, year, month) -- every input is scanned once and
    partially aggregated map-side.  Each ledger's month rows (bounded by
    its months of history, not by data volume) are then folded into one map
    and expanded over the spine from its first to last year, all 12 months,
    so December precedes every January and a month before the first counts
    0.0 (W3).  The change window reuses that partitioning: no extra shuffle.
    """
    keys = [*by, "year", "month"]
    none = F.lit(None).cast(VALUE_DEC)

    def rows(df: DataFrame, assign: dict) -> DataFrame:
        return df.select(*keys, *[assign.get(c, none).alias(c) for c in COMPONENTS])

    v = position_value(holdings, prices, by)
    stacked = (rows(v, {c: F.when(F.col("category") == c, F.col("value_dec")) for c in INVESTMENT_CATEGORIES})
               .unionByName(rows(liquidity, {"Liquidity": F.col("value").cast(VALUE_DEC)}))
               .unionByName(rows(credits, {"Credits/Debts": F.col("value").cast(VALUE_DEC)})))
    # a stray year (0001, 9999) would stretch the spine: such months are left out (see stray_months)
    stacked = stacked.where(F.col("year").between(*PLAUSIBLE_YEARS))
    month = stacked.groupBy(*keys).agg(*[F.sum(_c(c)).alias(c) for c in COMPONENTS])
    idx = F.col("year") * 12 + F.col("month") - 1
    folded = (month.groupBy(*by)
              .agg(F.min("year").alias("_y0"), F.max("year").alias("_y1"),
                   F.map_from_entries(F.collect_list(F.struct(idx, F.struct(*[_c(c) for c in COMPONENTS]))))
                   .alias("_cells")))
    g = folded.select(*by, F.explode(F.sequence(F.col("_y0") * 12, F.col("_y1") * 12 + 11)).alias("_i"),
                      "_cells")
    cell = F.try_element_at("_cells", F.col("_i"))
    g = g.select(*by, F.floor(F.col("_i") / 12).cast("int").alias("year"),
                 (F.pmod("_i", F.lit(12)) + 1).cast("int").alias("month"),
                 *[F.coalesce(cell[c], _zero()).alias(c) for c in COMPONENTS])
    nw = _c(COMPONENTS[0])
    for c in COMPONENTS[1:]:
        nw = nw + _c(c)
    g = g.withColumn("Net Worth", nw.cast(VALUE_DEC))
    w = Window.partitionBy(*by).orderBy("year", "month")
    g = g.withColumn("_prev", F.coalesce(F.lag("Net Worth", 1).over(w), _zero()))
    cur, p = _c("Net Worth"), F.col("_prev")
    change = F.when(cur != 0, (cur - p).cast(VALUE_DEC))
    pct = F.when((cur != 0) & (p != 0),
                 (cur - p).cast("double") / p.cast("double") * F.lit(100.0))
    return g.withColumn("NW Change", change).withColumn("% NW Change", pct).drop("_prev")


NETWORTH_TABLE_ROWS = [*INVESTMENT_CATEGORIES, "Liquidity", "Credits/Debts", "Net Worth",
                       "NW Change", "% NW Change"]


def networth_table(holdings, prices, liquidity, credits, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., year, month, row, value)``, unrounded, 8 rows per month."""
    g = networth_grid(holdings, prices, liquidity, credits, by)
    entries = F.array(*[F.struct(F.lit(r).alias("row"), F.col(f"`{r}`").cast("double").alias("value"))
                        for r in NETWORTH_TABLE_ROWS])
    return g.select(*by, "year", "month", F.inline(entries))


def networth_evolution(holdings, prices, liquidity, credits, by: Sequence[str] = ()) -> DataFrame:
    """The 5 components rounded to 2 each month and Net Worth as the sum of
    the rounded components; years whose Net Worth is 0 in every month yield
    no rows."""
    g = networth_grid(holdings, prices, liquidity, credits, by)
    comps = [*INVESTMENT_CATEGORIES, "Liquidity", "Credits/Debts"]
    r = g.select(*by, "year", "month", *[round2(F.col(f"`{c}`")).alias(c) for c in comps])
    total = F.col(f"`{comps[0]}`")
    for c in comps[1:]:
        total = total + F.col(f"`{c}`")
    r = r.withColumn("Net Worth", total)
    # A year is shown if any month nets to non-zero: a window over its 12
    # month rows (already clustered by ledger), not a self-join.
    active = F.max(F.col("`Net Worth`") != 0).over(Window.partitionBy(*by, "year"))
    entries = F.array(*[F.struct(F.lit(c).alias("series"), F.col(f"`{c}`").cast("double").alias("value"))
                        for c in [*comps, "Net Worth"]])
    return (r.withColumn("_any", active).where("_any")
            .select(*by, "year", "month", F.inline(entries)))


def allocation(holdings, prices, liquidity, credits, by: Sequence[str] = ()) -> DataFrame:
    """Allocation slices per month: each investment category > 0,
    Liquidity > 0, and Credits (> 0) or Debts (absolute value, < 0)."""
    g = networth_grid(holdings, prices, liquidity, credits, by)
    cd = F.col("`Credits/Debts`")
    slices = [F.struct(F.lit(c).alias("slice"), F.col(f"`{c}`").alias("v"))
              for c in [*INVESTMENT_CATEGORIES, "Liquidity"]]
    slices.append(F.struct(F.when(cd < 0, F.lit("Debts")).otherwise(F.lit("Credits")).alias("slice"),
                           F.abs(cd).alias("v")))
    return (g.select(*by, "year", "month", F.inline(F.array(*slices)))
            .where(F.col("v") > 0)
            .select(*by, "year", "month", "slice", round2("v").cast("double").alias("value")))


def value_table_totals(holdings, prices, by: Sequence[str] = ()) -> DataFrame:
    """Per-asset values with a Total row per month.

    The position join already has one row per asset and month; rows pass as they are and only the
    Total is aggregated.  A missing price counts 0 in the Total; the Total of no values is 0.
    """
    v = position_value(holdings, prices, by)
    keys = [*by, "year", "month"]
    rows = v.select(*keys, "asset_name", "category", F.col("value_dec").alias("_s"))
    totals = rows.groupBy(*keys).agg(F.coalesce(F.sum("_s"), _zero()).alias("_s")).select(
        *keys, F.lit(TOTAL_LABEL).alias("asset_name"), F.lit(None).cast("string").alias("category"), "_s")
    return rows.unionByName(totals).select(*keys, "asset_name", "category", F.col("_s").cast("double").alias("value"))


def table_with_totals(facts: DataFrame, name_col: str, value: str, attrs: Sequence[str] = (),
                      by: Sequence[str] = ()) -> DataFrame:
    """Any month table (holdings, prices, balances; one row per name and month) with a Total
    row per month.  Rows pass as they are; totals ignore nulls and are 0 when nothing is set."""
    keys = [*by, "year", "month"]
    amount = F.col(value).cast(VALUE_DEC)
    totals = facts.groupBy(*keys).agg(F.coalesce(F.sum(amount), _zero()).cast("double").alias(value)).select(
        *keys, F.lit(TOTAL_LABEL).alias(name_col), *[F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in attrs], value)
    return facts.select(*keys, name_col, *attrs, F.col(value).cast("double").alias(value)).unionByName(totals)
