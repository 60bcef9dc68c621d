"""Scalar Column functions.

All are built-in Spark expressions: they stay inside whole-stage codegen and
never cross into Python.
"""

from __future__ import annotations

from decimal import Decimal
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.domains import CASING_EXCEPTIONS, REF_CURRENCY_RATE
from tillbook.schemas import MONEY_SCALE, SUM_SCALE

__all__ = [
    "col_of", "normalize_category", "mapping_key", "month_label", "month_column",
    "safe_date", "date_from_day_or_iso", "day_of_month", "month_abbr", "month_name",
    "round_whole", "round2", "fill_zero", "guarded_pct", "fmt_amount", "fmt_percent",
    "to_ref_currency", "money", "money_sum", "contains_ci", "units", "from_units",
    "units_sum", "units_decimal",
]


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _exceptions_map() -> Column:
    return F.create_map(*chain.from_iterable(
        (F.lit(k), F.lit(v)) for k, v in CASING_EXCEPTIONS.items()))


def normalize_category(c) -> Column:
    """lower-case, then the exception spelling or first letter upper-cased.

    Not ``initcap``: only the very first character is upper-cased.
    """
    low = F.lower(col_of(c))
    first_upper = F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, 1 << 30))
    return F.coalesce(F.try_element_at(_exceptions_map(), low), first_upper)


def mapping_key(c) -> Column:
    """strip surrounding whitespace (tabs and newlines too), lower-case."""
    return F.lower(F.regexp_replace(col_of(c), r"^\s+|\s+$", ""))


def month_label(year, month) -> Column:
    """``YYYY-MM``."""
    return F.concat_ws("-", col_of(year).cast("string"),
                       F.lpad(col_of(month).cast("string"), 2, "0"))


def month_column(month) -> Column:
    """``MM`` column label of the yearly wide tables."""
    return F.lpad(col_of(month).cast("string"), 2, "0")


def safe_date(year, month, day) -> Column:
    """date from parts; an impossible date gives null (a reject), never an error."""
    return F.try_make_timestamp(col_of(year), col_of(month), col_of(day),
                                F.lit(0), F.lit(0), F.lit(0)).cast("date")


def date_from_day_or_iso(value, year, month) -> Column:
    """F5 for edits: a bare day of month, or an ISO ``YYYY-MM-DD`` date."""
    v = F.trim(col_of(value).cast("string"))
    as_day = safe_date(year, month, v.try_cast("int"))
    return F.when(v.rlike(r"^[0-9]{1,2}$"), as_day).otherwise(F.try_to_date(v, "yyyy-MM-dd"))


def day_of_month(d) -> Column:
    """F6."""
    return F.dayofmonth(col_of(d))


def month_abbr(month) -> Column:
    """``Jan``."""
    return F.date_format(F.make_date(F.lit(2000), col_of(month), F.lit(1)), "MMM")


def month_name(month) -> Column:
    """``January``."""
    return F.date_format(F.make_date(F.lit(2000), col_of(month), F.lit(1)), "MMMM")


def round_whole(v) -> Column:
    """F8: round half to even to a whole number (Python ``round(v)``)."""
    return F.rint(col_of(v)).cast("long")


def round2(v) -> Column:
    """F8: round half to even to 2 decimals (decimal-exact)."""
    return F.bround(col_of(v), 2)


def fill_zero(v) -> Column:
    """nulls only become 0.0 (NaN is kept)."""
    return F.coalesce(col_of(v), F.lit(0.0))


def guarded_pct(a, b) -> Column:
    """``100*a/b``, 0.0 when ``b`` is 0."""
    a, b = col_of(a), col_of(b)
    return F.when(b != 0, F.lit(100.0) * a / b).otherwise(F.lit(0.0))


def fmt_amount(v) -> Column:
    """thousands separators, 2 decimals, blank for zero or null."""
    v = col_of(v)
    return F.when(v.isNotNull() & (v != 0), F.format_number(v, 2)).otherwise(F.lit(""))


def fmt_percent(v, decimals: int = 1) -> Column:
    """``12.3%`` (half to even)."""
    return F.format_string(f"%.{decimals}f%%", F.bround(col_of(v), decimals))


def to_ref_currency(amount) -> Column:
    """P10: amount in the reference currency (single currency, rate 1.0)."""
    return col_of(amount) * F.lit(REF_CURRENCY_RATE)


def units(v, scale: int = SUM_SCALE) -> Column:
    """Money as whole units of 10**-scale (half-up), for fast order-independent sums.

    Long sums stay in primitive aggregation buffers (no BigDecimal), and an
    overflow fails loudly under ANSI mode instead of wrapping.  Amounts are
    rounded only here, to ``scale`` decimals that the caller chooses: a smaller scale
    leaves room for larger totals.
    """
    return F.round(col_of(v) * F.lit(float(10 ** scale))).cast("long")


def units_decimal(c, scale: int = SUM_SCALE) -> Column:
    """Units as an exact decimal amount."""
    return (col_of(c).cast("decimal(20,0)") * F.lit(Decimal(1).scaleb(-scale))).cast(f"decimal(28,{scale})")


def from_units(c, scale: int = SUM_SCALE) -> Column:
    """Units back to a money double (the double nearest to the exact amount)."""
    return units_decimal(c, scale).cast("double")


def units_sum(v, scale: int = SUM_SCALE) -> Column:
    """Order-independent money sum in units (long)."""
    return F.sum(units(v, scale))


def money(v, scale: int = MONEY_SCALE) -> Column:
    """Exact decimal form of a money double, so sums do not depend on order."""
    return col_of(v).cast(T.DecimalType(18, scale))


def money_sum(v, scale: int = MONEY_SCALE) -> Column:
    """Order-independent sum of money: decimal sum (kept decimal)."""
    return F.sum(money(v, scale))


def contains_ci(c, term: str) -> Column:
    """Case-insensitive literal substring test (no pattern characters)."""
    return F.contains(F.lower(col_of(c)), F.lower(F.lit(term)))
