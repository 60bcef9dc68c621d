"""Registered queries: ledger view, scalar functions, categories, chart datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillbook.functions import scalars as X
from tillbook.operators import categories as K
from tillbook.operators import filters as V
from tillbook.operators import reports as R
from tillbook.operators import summaries as S
from tillbook.plans import sql_parts as Q
from tillbook.plans.registry import register
from tillbook.sources import adapters as A

SEARCH = dict(name="URG", category="o", amount_min=100000.0, amount_max=300000.0)
COMPARE_MONTHS = [1, 3, 6, 9, 12]
CHOSEN_CATEGORIES = ["Standard", "Promo", "Nosuch", "Economy", "Small"]

VIEW_COLS = """expense_id AS id, expense_name, CAST(day(expense_date) AS INTEGER) AS expense_date,
  round_even(expense_amount, 2) AS expense_amount, currency,
  round_even(expense_in_ref_currency, 2) AS expense_in_ref_currency,
  primary_category, secondary_category, year, month"""


@register("ledger_search", f"""
WITH {Q.LEDGER_IDS}
SELECT {VIEW_COLS} FROM ledger_ids
WHERE contains(lower(expense_name), lower('{SEARCH['name']}'))
  AND (contains(lower(primary_category), lower('{SEARCH['category']}'))
       OR contains(lower(secondary_category), lower('{SEARCH['category']}')))
  AND expense_amount >= {SEARCH['amount_min']} AND expense_amount <= {SEARCH['amount_max']}""")
def ledger_search(spark, sf_dir):
    return V.ledger_view(A.ledger_with_ids(A.Tables(spark, sf_dir)), **SEARCH)


@register("ledger_page", f"""
WITH {Q.LEDGER_IDS}
SELECT {VIEW_COLS} FROM ledger_ids ORDER BY expense_amount DESC, expense_id LIMIT 50 OFFSET 100""")
def ledger_page(spark, sf_dir):
    view = V.ledger_view(A.ledger_with_ids(A.Tables(spark, sf_dir)))
    return V.page(view, "expense_amount", descending=True, page_no=2)


@register("normalize_categories", f"""
SELECT p_partkey, {Q.f1('p_name')} AS name_norm, {Q.f1('p_type')} AS type_norm,
       {Q.f1('p_brand')} AS brand_norm, {Q.f3('p_name')} AS name_key FROM part""")
def normalize_categories(spark, sf_dir):
    p = A.Tables(spark, sf_dir).part
    return p.select("p_partkey", X.normalize_category("p_name").alias("name_norm"),
                    X.normalize_category("p_type").alias("type_norm"),
                    X.normalize_category("p_brand").alias("brand_norm"),
                    X.mapping_key("p_name").alias("name_key"))


@register("scalar_functions", """
SELECT o_orderkey, concat_ws('-', CAST(y AS VARCHAR), lpad(CAST(m AS VARCHAR), 2, '0')) AS label,
       lpad(CAST(m AS VARCHAR), 2, '0') AS month_col,
       strftime(make_date(2000, m, 1), '%b') AS abbr, strftime(make_date(2000, m, 1), '%B') AS mname,
       CAST(day(o_orderdate) AS INTEGER) AS dom,
       CAST(round_even(o_totalprice, 0) AS BIGINT) AS whole, round_even(o_totalprice, 2) AS cents,
       TRY_CAST(printf('%04d-%02d-%02d', y, m, 31) AS DATE) AS day31,
       CASE WHEN o_custkey <> 0 THEN CAST(100.0 AS DOUBLE) * o_totalprice / o_custkey ELSE 0.0 END AS pct,
       COALESCE(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END, 0.0) AS filled,
       CASE WHEN o_totalprice IS NOT NULL AND o_totalprice <> 0 THEN format('{:,.2f}', o_totalprice)
            ELSE '' END AS amount_text,
       printf('%.1f%%', (o_orderkey % 1000) / 8.0) AS pct_text
FROM (SELECT *, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m
      FROM orders) o""")
def scalar_functions(spark, sf_dir):
    o = A.Tables(spark, sf_dir).orders
    d = F.col("o_orderdate").cast("date")
    o = o.withColumn("y", F.year(d)).withColumn("m", F.month(d))
    return o.select(
        "o_orderkey", X.month_label("y", "m").alias("label"), X.month_column("m").alias("month_col"),
        X.month_abbr("m").alias("abbr"), X.month_name("m").alias("mname"),
        X.day_of_month(d).alias("dom"), X.round_whole("o_totalprice").alias("whole"),
        X.round2("o_totalprice").alias("cents"), X.safe_date("y", "m", F.lit(31)).alias("day31"),
        X.guarded_pct("o_totalprice", "o_custkey").alias("pct"),
        X.fill_zero(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))).alias("filled"),
        X.fmt_amount("o_totalprice").alias("amount_text"),
        X.fmt_percent((F.col("o_orderkey") % 1000) / 8.0).alias("pct_text"))


@register("resolve_categories", f"""
WITH vals AS (SELECT 'customer' AS source, c_custkey AS id, {Q.f1('c_mktsegment')} AS value FROM customer
              UNION ALL SELECT 'part', p_partkey, p_type FROM part),
lk AS (SELECT lower(c_mktsegment) AS k, min(c_mktsegment) AS spelling FROM customer
       WHERE c_mktsegment IS NOT NULL AND c_mktsegment <> '' GROUP BY lower(c_mktsegment))
SELECT source, id, value,
       CASE WHEN value IS NULL OR value = '' THEN value ELSE COALESCE(lk.spelling, {Q.f1('value')}) END
       AS resolved
FROM vals LEFT JOIN lk ON lower(vals.value) = lk.k""")
def resolve_categories(spark, sf_dir):
    t = A.Tables(spark, sf_dir)
    vals = (t.customer.select(F.lit("customer").alias("source"), F.col("c_custkey").alias("id"),
                              X.normalize_category("c_mktsegment").alias("value"))
            .unionByName(t.part.select(F.lit("part").alias("source"), F.col("p_partkey").alias("id"),
                                       F.col("p_type").alias("value"))))
    return K.resolve_categories(vals, "value", t.customer, "c_mktsegment")


KNOWN = Q.KNOWN


@register("category_domain", f"""
WITH {Q.LEDGER}, {KNOWN},
used AS (SELECT 'primary' AS kind, primary_category AS category FROM ledger
         UNION ALL SELECT 'secondary', secondary_category FROM ledger),
allc AS (SELECT * FROM used WHERE category <> 'Total' UNION ALL SELECT * FROM known)
SELECT DISTINCT kind, {Q.f1('category')} AS category FROM allc
WHERE category IS NOT NULL AND category <> ''""")
def category_domain(spark, sf_dir):
    t = A.Tables(spark, sf_dir)
    return K.category_domain(A.ledger(t), A.known_categories(t))


@register("categories_with_totals", f"""
WITH {Q.LEDGER}, {Q.summaries_long()}, {KNOWN},
tot AS (SELECT kind, category AS name, SUM({Q.money('amount')}) AS total FROM summary
        WHERE category IS NOT NULL AND category <> '' AND category <> 'Total' GROUP BY kind, category)
SELECT COALESCE(k.kind, t.kind) AS kind, COALESCE(k.category, t.name) AS name,
       CAST(round_even(COALESCE(t.total, 0), 2) AS DOUBLE) AS total
FROM known k FULL JOIN tot t ON k.kind = t.kind AND k.category = t.name""")
def categories_with_totals(spark, sf_dir):
    t = A.Tables(spark, sf_dir)
    totals = S.category_totals(S.summaries_long(A.ledger(t)))
    return K.categories_with_totals(A.known_categories(t), totals)


PRIMARY_SUMMARY = f"{Q.LEDGER}, {Q.summaries_long(kinds=('primary',))}"


@register("months_compared", f"""
WITH {PRIMARY_SUMMARY}
SELECT year, month, strftime(make_date(2000, month, 1), '%b') AS series, category,
       CAST(round_even(amount, 0) AS BIGINT) AS value
FROM summary WHERE category <> 'Total' AND month IN ({', '.join(map(str, COMPARE_MONTHS))})""")
def months_compared(spark, sf_dir):
    s = S.summary_long(A.ledger(A.Tables(spark, sf_dir)), "primary")
    return R.months_compared(s, COMPARE_MONTHS)


@register("categories_over_months", f"""
WITH {PRIMARY_SUMMARY},
r AS (SELECT * FROM summary WHERE category <> 'Total'),
m AS (SELECT DISTINCT year, month FROM r),
g AS (SELECT year, month, c.category FROM m,
      (VALUES {', '.join(f"('{c}')" for c in CHOSEN_CATEGORIES)}) c(category))
SELECT g.year, g.month, g.category AS series,
       CAST(round_even(COALESCE(r.amount, 0.0), 0) AS BIGINT) AS value
FROM g LEFT JOIN r ON r.year = g.year AND r.month = g.month AND r.category = g.category""")
def categories_over_months(spark, sf_dir):
    s = S.summary_long(A.ledger(A.Tables(spark, sf_dir)), "primary")
    return R.categories_over_months(s, CHOSEN_CATEGORIES)


@register("year_share", f"""
WITH {PRIMARY_SUMMARY}
SELECT year, category, CAST(round_even(CAST(SUM({Q.money('amount')}) AS DOUBLE), 0) AS BIGINT) AS value
FROM summary WHERE category <> 'Total' AND category <> ''
GROUP BY year, category HAVING SUM({Q.money('amount')}) > 0""")
def year_share(spark, sf_dir):
    return R.year_share_wide(S.summary_wide(A.ledger(A.Tables(spark, sf_dir)), "primary"))


@register("month_share", f"""
WITH {Q.LEDGER},
a AS (SELECT year, month, primary_category AS category,
             CAST(SUM({Q.money('expense_in_ref_currency')}) AS DOUBLE) AS t
      FROM ledger GROUP BY year, month, primary_category)
SELECT year, month, category, CAST(round_even(t, 0) AS BIGINT) AS value FROM a
WHERE category IS NOT NULL AND category <> '' AND t > 0""")
def month_share(spark, sf_dir):
    return R.month_share(A.ledger(A.Tables(spark, sf_dir)))
