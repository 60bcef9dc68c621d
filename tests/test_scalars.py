from pyspark.sql import functions as F

from tillbook.functions import scalars as X
from tillbook.operators.categories import resolve_categories


def test_normalize_category(spark):
    df = spark.createDataFrame([("TV",), ("takeaway",), ("CREDIT card",), ("patreon-LIKE",), ("",)], "v string")
    got = [r[0] for r in df.select(X.normalize_category("v")).collect()]
    assert got == ["TV", "TakeAway", "Credit card", "Patreon-Like", ""]


def test_normalize_is_idempotent(spark):
    df = spark.createDataFrame([("tAkEaWaY",), ("hello World",), ("x",)], "v string")
    once = df.select(X.normalize_category("v").alias("v"))
    twice = once.select(X.normalize_category("v").alias("v"))
    assert once.collect() == twice.collect()


def test_resolve_category(spark):
    vals = spark.createDataFrame([("mycat",), ("other",), ("",)], "v string")
    existing = spark.createDataFrame([("MyCat",)], "c string")
    got = {r.v: r.resolved for r in resolve_categories(vals, "v", existing, "c").collect()}
    assert got == {"mycat": "MyCat", "other": "Other", "": ""}


def test_mapping_key_strips_tabs_and_newlines(spark):
    df = spark.createDataFrame([("\t PAM \n",)], "v string")
    assert df.select(X.mapping_key("v")).first()[0] == "pam"


def test_round_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "v double")
    assert [r[0] for r in df.select(X.round_whole("v")).collect()] == [0, 2, 2]


def test_safe_date_and_day_or_iso(spark):
    df = spark.createDataFrame([(2026, 2, 30), (2026, 2, 28)], "y int, m int, d int")
    got = [r[0] for r in df.select(X.safe_date("y", "m", "d")).collect()]
    assert got[0] is None and str(got[1]) == "2026-02-28"
    e = spark.createDataFrame([("5",), ("2026-03-04",), ("31",), ("junk",)], "v string")
    got = [r[0] for r in e.select(X.date_from_day_or_iso("v", F.lit(2026), F.lit(2))).collect()]
    assert [str(x) if x else None for x in got] == ["2026-02-05", "2026-03-04", None, None]


def test_guarded_pct_and_formats(spark):
    df = spark.createDataFrame([(50.0, 200.0), (1.0, 0.0)], "a double, b double")
    assert [r[0] for r in df.select(X.guarded_pct("a", "b")).collect()] == [25.0, 0.0]
    f = spark.createDataFrame([(1234.567,), (0.0,), (None,)], "v double")
    assert [r[0] for r in f.select(X.fmt_amount("v")).collect()] == ["1,234.57", "", ""]


def test_month_names(spark):
    df = spark.createDataFrame([(1,), (12,)], "m int")
    r = df.select(X.month_abbr("m"), X.month_name("m"), X.month_column("m")).collect()
    assert [tuple(x) for x in r] == [("Jan", "January", "01"), ("Dec", "December", "12")]


def test_units_round_trip(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (12345.67,)], "v double")
    got = df.select(X.from_units(X.units_sum("v"))).first()[0]
    assert got == 12345.97
