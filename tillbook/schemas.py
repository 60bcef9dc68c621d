"""Canonical table schemas (long form)."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY_SCALE = 6          # decimals kept by exact money sums
SUM_SCALE = 6            # decimals kept by sums in whole units (totals up to 9.2e12)
POSITION_SCALE = 9       # decimals of a quantity and a price whose product is taken exactly

LEDGER = T.StructType([
    T.StructField("expense_name", T.StringType()),
    T.StructField("expense_date", T.DateType()),
    T.StructField("expense_amount", T.DoubleType()),
    T.StructField("currency", T.StringType()),
    T.StructField("expense_in_ref_currency", T.DoubleType()),
    T.StructField("primary_category", T.StringType()),
    T.StructField("secondary_category", T.StringType()),
])
LEDGER_COLUMNS = [f.name for f in LEDGER.fields]

RECURRING = T.StructType([
    T.StructField("template_id", T.LongType()),
    T.StructField("expense_name", T.StringType()),
    T.StructField("expense_day", T.LongType()),
    T.StructField("expense_amount", T.DoubleType()),
    T.StructField("currency", T.StringType()),
    T.StructField("primary_category", T.StringType()),
    T.StructField("secondary_category", T.StringType()),
])

MAPPINGS = T.StructType([
    T.StructField("name_key", T.StringType()),
    T.StructField("primary_category", T.StringType()),
    T.StructField("secondary_category", T.StringType()),
])

# Raw JSON forms of the two configuration objects.
MAPPINGS_JSON = T.MapType(
    T.StringType(),
    T.StructType([
        T.StructField("primary_category", T.StringType()),
        T.StructField("secondary_category", T.StringType()),
    ]),
)
KNOWN_CATEGORIES_JSON = T.StructType([
    T.StructField("primary", T.ArrayType(T.StringType())),
    T.StructField("secondary", T.ArrayType(T.StringType())),
])

KNOWN_CATEGORIES = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("category", T.StringType()),
])

# Long facts of the yearly wide tables: one row per name, year and month.
HOLDINGS = T.StructType([
    T.StructField("asset_name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("link", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("quantity", T.DoubleType()),
])
PRICES = T.StructType([
    T.StructField("asset_name", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("price", T.DoubleType()),
])
LIQUIDITY = T.StructType([
    T.StructField("asset_name", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("currency", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("value", T.DoubleType()),
])
CREDITS = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("currency", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("value", T.DoubleType()),
])
INCOME = T.StructType([
    T.StructField("category", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("value", T.DoubleType()),
])
