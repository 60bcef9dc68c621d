"""Driver test tables -> ledger-domain tables.

The driver ships TPC-H-like tables.  These adapters re-express them as the
ledger domain (expense ledger, income, holdings, prices, liquidity,
credits/debts, recurring templates, category mappings, known categories),
so every query's work grows with the input tables.  All are lazy plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.domains import DEFAULT_CURRENCY, INCOME_CATEGORIES, INVESTMENT_CATEGORIES, \
    LIQUIDITY_CATEGORIES
from tillbook.functions.scalars import normalize_category, to_ref_currency


class Tables:
    """Lazy parquet readers for one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def _ym(ts) -> list:
    d = F.col(ts).cast("date")
    return [F.year(d).alias("year"), F.month(d).alias("month")]


def ledger(t: Tables, with_ledger_id: bool = False) -> DataFrame:
    """Expense ledger: one row per line item, named and categorised by its part.

    name = part name, date = ship date, amount = extended price,
    primary = F1(part type), secondary = F1(part brand).  With
    ``with_ledger_id`` the supplier key becomes ``ledger_id`` (one ledger per
    supplier), for multi-ledger jobs.
    """
    li = t.lineitem.select("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    # Normalise categories on the dimension side: once per part, not per line item.
    pt = t.part.select("p_partkey", "p_name", normalize_category("p_type").alias("p_type"),
                       normalize_category("p_brand").alias("p_brand"))
    j = li.join(pt, li.l_partkey == pt.p_partkey)
    cols = [F.col("l_suppkey").alias("ledger_id")] if with_ledger_id else []
    d = F.col("l_shipdate").cast("date")
    return j.select(
        *cols,
        F.col("p_name").alias("expense_name"),
        d.alias("expense_date"),
        F.col("l_extendedprice").alias("expense_amount"),
        F.lit(DEFAULT_CURRENCY).alias("currency"),
        to_ref_currency("l_extendedprice").alias("expense_in_ref_currency"),
        F.col("p_type").alias("primary_category"),
        F.col("p_brand").alias("secondary_category"),
        F.year(d).alias("year"),
        F.month(d).alias("month"),
    )


def ledger_with_ids(t: Tables) -> DataFrame:
    """Ledger with a stable ``expense_id`` (orders: the order key is unique)."""
    d = F.col("o_orderdate").cast("date")
    return t.orders.select(
        F.col("o_orderkey").alias("expense_id"),
        F.col("o_orderpriority").alias("expense_name"),
        d.alias("expense_date"),
        F.col("o_totalprice").alias("expense_amount"),
        F.lit(DEFAULT_CURRENCY).alias("currency"),
        to_ref_currency("o_totalprice").alias("expense_in_ref_currency"),
        normalize_category("o_orderpriority").alias("primary_category"),
        normalize_category("o_orderstatus").alias("secondary_category"),
        F.year(d).alias("year"),
        F.month(d).alias("month"),
    )


def income_category_of_priority(c) -> F.Column:
    return (F.when(c == "1-URGENT", INCOME_CATEGORIES[0])
            .when(c == "2-HIGH", INCOME_CATEGORIES[1])
            .when(c == "3-MEDIUM", INCOME_CATEGORIES[2])
            .otherwise(INCOME_CATEGORIES[3]))


def income(t: Tables) -> DataFrame:
    """Income facts (category, year, month, value): order totals by priority."""
    o = t.orders.select(income_category_of_priority(F.col("o_orderpriority")).alias("category"),
                        *_ym("o_orderdate"), "o_totalprice")
    return (o.groupBy("category", "year", "month")
            .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value")))


def _pick(key, labels) -> F.Column:
    m = F.pmod(key, F.lit(len(labels)))
    out = F.lit(labels[-1])
    for i in reversed(range(len(labels) - 1)):
        out = F.when(m == i, labels[i]).otherwise(out)
    return out


def asset_name_of_part(partkey) -> F.Column:
    return F.concat(F.lit("Part#"), F.col(partkey).cast("string"))


def _held(t: Tables) -> DataFrame:
    li = t.lineitem.select("l_partkey", "l_quantity", *_ym("l_shipdate"))
    return (li.groupBy("l_partkey", "year", "month")
            .agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity")))


def holdings(t: Tables) -> DataFrame:
    """Investment holdings: quantity per part asset and ship month."""
    return (_held(t)
            .select(asset_name_of_part("l_partkey").alias("asset_name"),
                    _pick(F.col("l_partkey"), INVESTMENT_CATEGORIES).alias("category"),
                    F.lit("").alias("link"), "year", "month", "quantity"))


def positions(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(holdings, prices) for queries that use both.

    The held months are aggregated once and stored in the shared folder, so the
    line items are scanned a single time for the two tables.
    """
    from tillbook.session import stored

    held = stored(_held(t), "held")
    pt = t.part.select("p_partkey", "p_retailprice").where(F.col("p_size") >= 5)
    asset = asset_name_of_part("l_partkey").alias("asset_name")
    h = held.select(asset, _pick(F.col("l_partkey"), INVESTMENT_CATEGORIES).alias("category"), F.lit("").alias("link"),
                    "year", "month", "quantity")
    p = held.join(pt, held.l_partkey == pt.p_partkey).select(asset, "year", "month", F.col("p_retailprice").alias("price"))
    return h, p


def prices(t: Tables) -> DataFrame:
    """Prices: the part's retail price for every month its asset is held.

    Small parts (size below 5) have no quoted price, so positions with a
    missing price (valued null) occur in the data.
    """
    # The months an asset is held: distinct keys, combined map-side.
    months = t.lineitem.select("l_partkey", *_ym("l_shipdate")).distinct()
    pt = t.part.select("p_partkey", "p_retailprice").where(F.col("p_size") >= 5)
    return (months.join(pt, months.l_partkey == pt.p_partkey)
            .select(asset_name_of_part("l_partkey").alias("asset_name"), "year", "month",
                    F.col("p_retailprice").alias("price")))


def liquidity(t: Tables, with_nation: bool = False) -> DataFrame:
    """Liquidity balances: order totals per customer and month (optionally
    with the customer's nation as ``ledger_id``)."""
    o = t.orders.select("o_custkey", "o_totalprice", *_ym("o_orderdate"))
    c = t.customer.select("c_custkey", "c_name", "c_nationkey")
    agg = (o.groupBy("o_custkey", "year", "month")
           .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value")))
    led = [F.col("c_nationkey").alias("ledger_id")] if with_nation else []
    return (agg.join(c, agg.o_custkey == c.c_custkey)
            .select(*led, F.col("c_name").alias("asset_name"),
                    _pick(F.col("c_custkey"), LIQUIDITY_CATEGORIES).alias("category"),
                    F.lit(DEFAULT_CURRENCY).alias("currency"), "year", "month", "value"))


def credits(t: Tables, with_nation: bool = False) -> DataFrame:
    """Credits/debts: the customer's account balance (either sign) once per
    month in which the customer ordered (optionally with its nation as
    ``ledger_id``)."""
    o = t.orders.select("o_custkey", *_ym("o_orderdate")).distinct()
    c = t.customer.select("c_custkey", "c_name", "c_acctbal", "c_nationkey")
    led = [F.col("c_nationkey").alias("ledger_id")] if with_nation else []
    return (o.join(c, o.o_custkey == c.c_custkey)
            .select(*led, F.col("c_name").alias("name"), F.lit(DEFAULT_CURRENCY).alias("currency"),
                    "year", "month", F.col("c_acctbal").alias("value")))


def recurring(t: Tables) -> DataFrame:
    """Recurring templates, one per part: day 1 + key mod 28, retail price."""
    return t.part.select(
        F.col("p_partkey").alias("template_id"),
        F.col("p_name").alias("expense_name"),
        (F.pmod("p_partkey", F.lit(28)) + 1).cast("long").alias("expense_day"),
        F.col("p_retailprice").alias("expense_amount"),
        F.lit(DEFAULT_CURRENCY).alias("currency"),
        normalize_category("p_type").alias("primary_category"),
        normalize_category("p_brand").alias("secondary_category"),
    )


def mappings(t: Tables) -> DataFrame:
    """Category mappings keyed by part name (stored stripped, lower-case)."""
    from tillbook.functions.scalars import mapping_key
    p = t.part.select(mapping_key("p_name").alias("name_key"), "p_type", "p_brand")
    return p.groupBy("name_key").agg(
        F.lower(F.trim(F.min("p_type"))).alias("primary_category"),
        F.lower(F.trim(F.min("p_brand"))).alias("secondary_category"))


def known_categories(t: Tables) -> DataFrame:
    """Known categories: market segments and normalised part types (primary),
    nation names (secondary)."""
    pri = t.customer.select(F.lit("primary").alias("kind"), F.col("c_mktsegment").alias("category"))
    typ = t.part.select(F.lit("primary").alias("kind"), normalize_category("p_type").alias("category"))
    sec = t.nation.select(F.lit("secondary").alias("kind"), F.col("n_name").alias("category"))
    return pri.unionByName(typ).unionByName(sec).distinct()


# ---- One ledger per nation (multi-ledger jobs) -----------------------------------
# Line items belong to their supplier's nation, orders to their customer's.

def holdings_by_nation(t: Tables) -> DataFrame:
    li = t.lineitem.select("l_partkey", "l_suppkey", "l_quantity", *_ym("l_shipdate"))
    s = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("ledger_id"))
    return (li.join(s, li.l_suppkey == s.s_suppkey)
            .groupBy("ledger_id", "l_partkey", "year", "month")
            .agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"))
            .select("ledger_id", asset_name_of_part("l_partkey").alias("asset_name"),
                    _pick(F.col("l_partkey"), INVESTMENT_CATEGORIES).alias("category"),
                    F.lit("").alias("link"), "year", "month", "quantity"))


def prices_by_nation(t: Tables) -> DataFrame:
    """Prices a nation ledger quotes: retail price for every month it holds the part."""
    li = t.lineitem.select("l_partkey", "l_suppkey", *_ym("l_shipdate"))
    s = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("ledger_id"))
    held = li.join(s, li.l_suppkey == s.s_suppkey).select("ledger_id", "l_partkey", "year", "month").distinct()
    pt = t.part.select("p_partkey", "p_retailprice").where(F.col("p_size") >= 5)
    return (held.join(pt, held.l_partkey == pt.p_partkey)
            .select("ledger_id", asset_name_of_part("l_partkey").alias("asset_name"), "year", "month",
                    F.col("p_retailprice").alias("price")))


def liquidity_by_nation(t: Tables) -> DataFrame:
    return liquidity(t, with_nation=True)


def credits_by_nation(t: Tables) -> DataFrame:
    return credits(t, with_nation=True)


def ledger_by_nation(t: Tables) -> DataFrame:
    led = ledger(t, with_ledger_id=True).withColumnRenamed("ledger_id", "_supp")
    s = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("ledger_id"))
    return led.join(s, led._supp == s.s_suppkey).drop("_supp", "s_suppkey")


def income_by_nation(t: Tables) -> DataFrame:
    o = t.orders.select("o_custkey", income_category_of_priority(F.col("o_orderpriority")).alias("category"),
                        *_ym("o_orderdate"), "o_totalprice")
    c = t.customer.select("c_custkey", F.col("c_nationkey").alias("ledger_id"))
    return (o.join(c, o.o_custkey == c.c_custkey)
            .groupBy("ledger_id", "category", "year", "month")
            .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value")))
