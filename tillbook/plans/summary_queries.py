"""Registered queries: summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillbook.operators import summaries as S
from tillbook.plans import sql_parts as Q
from tillbook.plans.registry import register
from tillbook.sources.adapters import Tables, ledger


@register("month_spend_by_category", f"""
WITH {Q.LEDGER}
SELECT year, month, primary_category,
       CAST(SUM({Q.money('expense_in_ref_currency')}) AS DOUBLE) AS total_expense_in_ref_currency
FROM ledger GROUP BY year, month, primary_category""")
def month_spend_by_category(spark, sf_dir):
    return S.month_spend(ledger(Tables(spark, sf_dir)), "primary")


@register("summary_primary_long", f"""
WITH {Q.LEDGER}, {Q.summaries_long(kinds=('primary',))}
SELECT category AS primary_category, year, month, amount FROM summary""")
def summary_primary_long(spark, sf_dir):
    return S.summary_long(ledger(Tables(spark, sf_dir)), "primary")


@register("summary_secondary_long", f"""
WITH {Q.LEDGER}, {Q.summaries_long(kinds=('secondary',))}
SELECT category AS secondary_category, year, month, amount FROM summary""")
def summary_secondary_long(spark, sf_dir):
    return S.summary_long(ledger(Tables(spark, sf_dir)), "secondary")


@register("summary_all_long", f"""
WITH {Q.LEDGER}, {Q.summaries_long()}
SELECT kind, category, year, month, amount FROM summary""")
def summary_all_long(spark, sf_dir):
    return S.summaries_long(ledger(Tables(spark, sf_dir)))


@register("summary_by_ledger_long", f"""
WITH {Q.LEDGER.replace('ledger AS', 'ledger0 AS')},
ledger AS (SELECT * FROM ledger0),
facts AS (SELECT ledger_id, year, month, primary_category AS category,
                 {Q.money('expense_in_ref_currency')} AS amt FROM ledger),
kept AS (SELECT * FROM facts WHERE category IS NOT NULL AND category <> 'Total'),
smonths AS (SELECT DISTINCT ledger_id, year, month FROM facts),
scats AS (SELECT DISTINCT ledger_id, year, category FROM kept),
scells AS (SELECT ledger_id, year, month, category, SUM(amt) AS amount FROM kept
           GROUP BY ledger_id, year, month, category)
SELECT c.ledger_id, c.category AS primary_category, c.year, m.month,
       CAST(COALESCE(x.amount, 0) AS DOUBLE) AS amount
FROM scats c JOIN smonths m ON c.ledger_id = m.ledger_id AND c.year = m.year
LEFT JOIN scells x ON x.ledger_id = c.ledger_id AND x.year = c.year AND x.month = m.month
                   AND x.category = c.category
UNION ALL
SELECT m.ledger_id, 'Total', m.year, m.month, CAST(COALESCE(SUM(k.amt), 0) AS DOUBLE)
FROM smonths m LEFT JOIN kept k ON k.ledger_id = m.ledger_id AND k.year = m.year AND k.month = m.month
GROUP BY m.ledger_id, m.year, m.month""")
def summary_by_ledger_long(spark, sf_dir):
    """A2 + A3 with ``by=ledger_id``: one ledger per supplier, one job."""
    return S.summary_long(ledger(Tables(spark, sf_dir), with_ledger_id=True), "primary",
                          by=["ledger_id"])


@register("summary_primary_wide", f"""
WITH {Q.LEDGER}, {Q.summaries_long(kinds=('primary',))}
SELECT year, category AS primary_category, {Q.display_rank('category')} AS display_rank,
       {Q.wide_months()}
FROM summary GROUP BY year, category""")
def summary_primary_wide(spark, sf_dir):
    return S.summary_wide(ledger(Tables(spark, sf_dir)), "primary")


@register("summary_pruned", f"""
WITH {Q.LEDGER}, {Q.summaries_long(kinds=('primary',))},
keep AS (SELECT year, category FROM summary GROUP BY year, category
         HAVING bool_or(COALESCE(amount, 0) <> 0) OR category = 'Total')
SELECT s.category AS primary_category, s.year, s.month, s.amount
FROM summary s JOIN keep k ON s.year = k.year AND s.category = k.category""")
def summary_pruned(spark, sf_dir):
    return S.summary_long(ledger(Tables(spark, sf_dir)), "primary", prune_zero=True)


@register("category_totals_all_years", f"""
WITH {Q.LEDGER}, {Q.summaries_long()}
SELECT kind, category, CAST(COALESCE(SUM({Q.money('amount')}), 0) AS DOUBLE) AS total
FROM summary WHERE category IS NOT NULL AND category <> '' AND category <> 'Total'
GROUP BY kind, category""")
def category_totals_all_years(spark, sf_dir):
    return S.category_totals(S.summaries_long(ledger(Tables(spark, sf_dir))))



@register("merge_month", f"""
WITH {Q.LEDGER}, {Q.summaries_long(kinds=('primary',))}
SELECT year, category AS primary_category, {Q.display_rank('category')} AS display_rank,
       {Q.wide_months()}
FROM summary GROUP BY year, category""")
def merge_month(spark, sf_dir):
    """A stored wide summary built without December, then December of
    every year merged in from the ledger, equals the full summary."""
    led = ledger(Tables(spark, sf_dir))
    stored = S.summary_wide(led.where(F.col("month") != 12), "primary")
    december = led.where(F.col("month") == 12).select("year", "month").distinct()
    return S.merge_months_into_wide(stored, led, december, "primary")
