"""Registered queries: cashflow and net worth."""

from __future__ import annotations

from tillbook.operators import cashflow as C
from tillbook.operators import networth as N
from tillbook.plans import sql_parts as Q
from tillbook.plans.registry import register
from tillbook.sources import adapters as A

D = "CAST({} AS DOUBLE)"


def _cash(spark, sf_dir):
    t = A.Tables(spark, sf_dir)
    return A.income(t), A.ledger(t)


def _nw(spark, sf_dir):
    t = A.Tables(spark, sf_dir)
    return *A.positions(t), A.liquidity(t), A.credits(t)


@register("cashflow_statement", f"""
WITH {Q.CASHFLOW_GRID}
SELECT year, month, v.category, v.value FROM cgrid, LATERAL (VALUES
  ('Salary', CAST(c1 AS DOUBLE)), ('Interests Bank account', CAST(c2 AS DOUBLE)),
  ('Dividendi e Cedole', CAST(c3 AS DOUBLE)), ('Other', CAST(c4 AS DOUBLE)),
  ('Income', CAST(income AS DOUBLE)), ('Spending', CAST(spending AS DOUBLE)),
  ('Saving', CAST(saving AS DOUBLE)),
  ('Saving %', CASE WHEN CAST(income AS DOUBLE) <> 0
               THEN CAST(100.0 AS DOUBLE) * CAST(saving AS DOUBLE) / CAST(income AS DOUBLE)
               ELSE CAST(0.0 AS DOUBLE) END)) v(category, value)""")
def cashflow_statement(spark, sf_dir):
    return C.cashflow_statement(*_cash(spark, sf_dir))


@register("cashflow_bars", f"""
WITH {Q.CASHFLOW_GRID},
act AS (SELECT year FROM cgrid GROUP BY year
        HAVING bool_or(round_even(income, 2) <> 0 OR round_even(spending, 2) <> 0))
SELECT g.year, g.month, v.series, v.value FROM cgrid g JOIN act ON act.year = g.year,
LATERAL (VALUES ('Income', CAST(round_even(g.income, 2) AS DOUBLE)),
                ('Spending', CAST(round_even(g.spending, 2) AS DOUBLE)),
                ('Saving', CAST(round_even(g.saving, 2) AS DOUBLE))) v(series, value)""")
def cashflow_bars(spark, sf_dir):
    return C.cashflow_bars(*_cash(spark, sf_dir))


@register("income_share", f"""
WITH {Q.INCOME}
SELECT year, category, CAST(round_even(SUM({Q.money('value')}), 2) AS DOUBLE) AS value
FROM income_f GROUP BY year, category HAVING SUM({Q.money('value')}) > 0""")
def income_share(spark, sf_dir):
    t = A.Tables(spark, sf_dir)
    return C.income_share(A.income(t))


@register("position_value", f"""
WITH {Q.HOLDINGS}
SELECT asset_name, category, link, year, month, quantity, price,
       CAST(value_dec AS DOUBLE) AS value FROM pos""")
def position_value(spark, sf_dir):
    h, p, _, _ = _nw(spark, sf_dir)
    return N.position_value(h, p).drop("value_dec")


@register("value_table_totals", f"""
WITH {Q.HOLDINGS}
SELECT year, month, asset_name, category, CAST(value_dec AS DOUBLE) AS value FROM pos
UNION ALL
SELECT year, month, 'Total', NULL, CAST(COALESCE(SUM(value_dec), 0) AS DOUBLE) FROM pos
GROUP BY year, month""")
def value_table_totals(spark, sf_dir):
    h, p, _, _ = _nw(spark, sf_dir)
    return N.value_table_totals(h, p)


@register("networth_table", f"""
WITH {Q.NETWORTH_GRID}
SELECT year, month, v.row, v.value FROM ngrid, LATERAL (VALUES
  ('Stocks/ETF', CAST(i1 AS DOUBLE)), ('Commodities', CAST(i2 AS DOUBLE)),
  ('Bonds', CAST(i3 AS DOUBLE)), ('Liquidity', CAST(liq AS DOUBLE)),
  ('Credits/Debts', CAST(cd AS DOUBLE)), ('Net Worth', CAST(nw AS DOUBLE)),
  ('NW Change', CASE WHEN nw <> 0 THEN CAST(nw - prev AS DOUBLE) END),
  ('% NW Change', CASE WHEN nw <> 0 AND prev <> 0
                  THEN CAST(nw - prev AS DOUBLE) / CAST(prev AS DOUBLE) * CAST(100.0 AS DOUBLE) END)
) v(row, value)""")
def networth_table(spark, sf_dir):
    return N.networth_table(*_nw(spark, sf_dir))


@register("networth_evolution", f"""
WITH {Q.NETWORTH_GRID},
r AS (SELECT year, month, round_even(i1, 2) AS i1, round_even(i2, 2) AS i2, round_even(i3, 2) AS i3,
             round_even(liq, 2) AS liq, round_even(cd, 2) AS cd FROM ngrid),
r2 AS (SELECT *, i1 + i2 + i3 + liq + cd AS nw FROM r),
act AS (SELECT year FROM r2 GROUP BY year HAVING bool_or(nw <> 0))
SELECT r2.year, month, v.series, v.value FROM r2 JOIN act ON act.year = r2.year, LATERAL (VALUES
  ('Stocks/ETF', CAST(i1 AS DOUBLE)), ('Commodities', CAST(i2 AS DOUBLE)),
  ('Bonds', CAST(i3 AS DOUBLE)), ('Liquidity', CAST(liq AS DOUBLE)),
  ('Credits/Debts', CAST(cd AS DOUBLE)), ('Net Worth', CAST(nw AS DOUBLE))) v(series, value)""")
def networth_evolution(spark, sf_dir):
    return N.networth_evolution(*_nw(spark, sf_dir))


@register("allocation_month", f"""
WITH {Q.NETWORTH_GRID}
SELECT year, month, slice, CAST(round_even(v, 2) AS DOUBLE) AS value FROM ngrid, LATERAL (VALUES
  ('Stocks/ETF', i1), ('Commodities', i2), ('Bonds', i3), ('Liquidity', liq),
  (CASE WHEN cd < 0 THEN 'Debts' ELSE 'Credits' END, abs(cd))) s(slice, v)
WHERE v > 0""")
def allocation_month(spark, sf_dir):
    return N.allocation(*_nw(spark, sf_dir))


@register("balance_table_totals", f"""
WITH {Q.BALANCES}
SELECT year, month, asset_name, category, currency, value FROM liq_f
UNION ALL
SELECT year, month, 'Total', NULL, NULL, CAST(COALESCE(SUM({Q.money('value', 4)}), 0) AS DOUBLE)
FROM liq_f GROUP BY year, month""")
def balance_table_totals(spark, sf_dir):
    _, _, liq, _ = _nw(spark, sf_dir)
    return N.table_with_totals(liq, "asset_name", "value", attrs=["category", "currency"])


@register("holdings_table_totals", f"""
WITH {Q.HOLDINGS}
SELECT year, month, asset_name, category, link, quantity FROM hold
UNION ALL
SELECT year, month, 'Total', NULL, NULL, CAST(COALESCE(SUM({Q.money('quantity', 4)}), 0) AS DOUBLE)
FROM hold GROUP BY year, month""")
def holdings_table_totals(spark, sf_dir):
    h, _, _, _ = _nw(spark, sf_dir)
    return N.table_with_totals(h, "asset_name", "quantity", attrs=["category", "link"])


NATION_GRID = f"""
hold AS (
  SELECT s_nationkey AS ledger_id, 'Part#' || CAST(l_partkey AS VARCHAR) AS asset_name,
         {Q.INVESTMENT_PICK('l_partkey')} AS category, year, month,
         CAST(SUM({Q.money('l_quantity')}) AS DOUBLE) AS quantity
  FROM (SELECT l_partkey, l_quantity, s_nationkey, CAST(year(l_shipdate) AS INTEGER) AS year,
               CAST(month(l_shipdate) AS INTEGER) AS month
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) x
  GROUP BY s_nationkey, l_partkey, year, month),
prices_f AS (
  SELECT m.ledger_id, 'Part#' || CAST(m.l_partkey AS VARCHAR) AS asset_name, m.year, m.month,
         p.p_retailprice AS price
  FROM (SELECT DISTINCT s_nationkey AS ledger_id, l_partkey, CAST(year(l_shipdate) AS INTEGER) AS year,
               CAST(month(l_shipdate) AS INTEGER) AS month
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) m
  JOIN part p ON m.l_partkey = p.p_partkey WHERE p.p_size >= 5),
pos AS (
  SELECT h.*, CAST({Q.money('h.quantity', 4)} * {Q.money('f.price', 4)} AS DECIMAL(38,4)) AS value_dec
  FROM hold h LEFT JOIN prices_f f ON f.ledger_id = h.ledger_id AND f.asset_name = h.asset_name
    AND f.year = h.year AND f.month = h.month),
{Q.BALANCES},
liq_n AS (SELECT l.*, c.c_nationkey AS ledger_id FROM liq_f l JOIN customer c ON c.c_name = l.asset_name),
cd_n AS (SELECT d.*, c.c_nationkey AS ledger_id FROM cd_f d JOIN customer c ON c.c_name = d.name),
inv AS (SELECT ledger_id, year, month,
   SUM(CASE WHEN category = 'Stocks/ETF' THEN value_dec END) AS i1,
   SUM(CASE WHEN category = 'Commodities' THEN value_dec END) AS i2,
   SUM(CASE WHEN category = 'Bonds' THEN value_dec END) AS i3
   FROM pos GROUP BY ledger_id, year, month),
liq AS (SELECT ledger_id, year, month, CAST(SUM({Q.money('value', 4)}) AS DECIMAL(38,4)) AS liq
        FROM liq_n GROUP BY ledger_id, year, month),
cd AS (SELECT ledger_id, year, month, CAST(SUM({Q.money('value', 4)}) AS DECIMAL(38,4)) AS cd
       FROM cd_n GROUP BY ledger_id, year, month),
ny AS (SELECT ledger_id, min(year) AS y0, max(year) AS y1 FROM
       (SELECT ledger_id, year FROM inv UNION ALL SELECT ledger_id, year FROM liq
        UNION ALL SELECT ledger_id, year FROM cd) u GROUP BY ledger_id),
nspine AS (SELECT ny.ledger_id, CAST(y AS INTEGER) AS year, CAST(m AS INTEGER) AS month
           FROM ny, range(ny.y0, ny.y1 + 1) a(y), range(1, 13) b(m)),
ngrid0 AS (SELECT s.ledger_id, s.year, s.month,
   CAST(COALESCE(inv.i1, 0) AS DECIMAL(38,4)) AS i1, CAST(COALESCE(inv.i2, 0) AS DECIMAL(38,4)) AS i2,
   CAST(COALESCE(inv.i3, 0) AS DECIMAL(38,4)) AS i3, CAST(COALESCE(liq.liq, 0) AS DECIMAL(38,4)) AS liq,
   CAST(COALESCE(cd.cd, 0) AS DECIMAL(38,4)) AS cd
   FROM nspine s
   LEFT JOIN inv ON inv.ledger_id = s.ledger_id AND inv.year = s.year AND inv.month = s.month
   LEFT JOIN liq ON liq.ledger_id = s.ledger_id AND liq.year = s.year AND liq.month = s.month
   LEFT JOIN cd ON cd.ledger_id = s.ledger_id AND cd.year = s.year AND cd.month = s.month),
ngrid1 AS (SELECT *, CAST(i1 + i2 + i3 + liq + cd AS DECIMAL(38,4)) AS nw FROM ngrid0),
ngrid AS (SELECT *, COALESCE(lag(nw) OVER (PARTITION BY ledger_id ORDER BY year, month), 0) AS prev
          FROM ngrid1)"""


@register("networth_by_ledger", f"""
WITH {NATION_GRID}
SELECT ledger_id, year, month, v.row, v.value FROM ngrid, LATERAL (VALUES
  ('Stocks/ETF', CAST(i1 AS DOUBLE)), ('Commodities', CAST(i2 AS DOUBLE)),
  ('Bonds', CAST(i3 AS DOUBLE)), ('Liquidity', CAST(liq AS DOUBLE)),
  ('Credits/Debts', CAST(cd AS DOUBLE)), ('Net Worth', CAST(nw AS DOUBLE)),
  ('NW Change', CASE WHEN nw <> 0 THEN CAST(nw - prev AS DOUBLE) END),
  ('% NW Change', CASE WHEN nw <> 0 AND prev <> 0
                  THEN CAST(nw - prev AS DOUBLE) / CAST(prev AS DOUBLE) * CAST(100.0 AS DOUBLE) END)
) v(row, value)""")
def networth_by_ledger(spark, sf_dir):
    """C9 with ``by=ledger_id``: one net-worth ledger per nation, one job."""
    t = A.Tables(spark, sf_dir)
    return N.networth_table(A.holdings_by_nation(t), A.prices_by_nation(t), A.liquidity_by_nation(t),
                            A.credits_by_nation(t), by=["ledger_id"])


@register("cashflow_by_ledger", f"""
WITH {Q.LEDGER.replace("ledger AS (", "ledger0 AS (")},
ledger AS (SELECT l.*, s.s_nationkey AS nation FROM ledger0 l JOIN supplier s ON l.ledger_id = s.s_suppkey),
income_f AS (
  SELECT nation, category, year, month, CAST(SUM({Q.money('o_totalprice')}) AS DOUBLE) AS value
  FROM (SELECT c_nationkey AS nation, {Q.income_category('o_orderpriority')} AS category,
               CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
               o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey) x
  GROUP BY nation, category, year, month),
inc AS (SELECT nation, year, month,
   SUM(CASE WHEN category = 'Salary' THEN {Q.money('value')} END) AS c1,
   SUM(CASE WHEN category = 'Interests Bank account' THEN {Q.money('value')} END) AS c2,
   SUM(CASE WHEN category = 'Dividendi e Cedole' THEN {Q.money('value')} END) AS c3,
   SUM(CASE WHEN category = 'Other' THEN {Q.money('value')} END) AS c4
   FROM income_f GROUP BY nation, year, month),
spend AS (SELECT nation, year, month,
   COALESCE(SUM(CASE WHEN primary_category IS NOT NULL AND primary_category <> 'Total'
                     THEN {Q.money('expense_in_ref_currency')} END), 0) AS spending
   FROM ledger GROUP BY nation, year, month),
cyears AS (SELECT nation, year FROM inc UNION SELECT nation, year FROM spend),
cspine AS (SELECT nation, year, CAST(m AS INTEGER) AS month FROM cyears CROSS JOIN range(1, 13) t(m)),
cgrid0 AS (SELECT s.nation, s.year, s.month, COALESCE(i.c1, 0) AS c1, COALESCE(i.c2, 0) AS c2,
           COALESCE(i.c3, 0) AS c3, COALESCE(i.c4, 0) AS c4, COALESCE(p.spending, 0) AS spending
           FROM cspine s LEFT JOIN inc i ON i.nation = s.nation AND i.year = s.year AND i.month = s.month
           LEFT JOIN spend p ON p.nation = s.nation AND p.year = s.year AND p.month = s.month),
cgrid AS (SELECT *, c1 + c2 + c3 + c4 AS income, c1 + c2 + c3 + c4 - spending AS saving FROM cgrid0)
SELECT nation AS ledger_id, year, month, v.category, v.value FROM cgrid, LATERAL (VALUES
  ('Salary', CAST(c1 AS DOUBLE)), ('Interests Bank account', CAST(c2 AS DOUBLE)),
  ('Dividendi e Cedole', CAST(c3 AS DOUBLE)), ('Other', CAST(c4 AS DOUBLE)),
  ('Income', CAST(income AS DOUBLE)), ('Spending', CAST(spending AS DOUBLE)),
  ('Saving', CAST(saving AS DOUBLE)),
  ('Saving %', CASE WHEN CAST(income AS DOUBLE) <> 0
               THEN CAST(100.0 AS DOUBLE) * CAST(saving AS DOUBLE) / CAST(income AS DOUBLE)
               ELSE CAST(0.0 AS DOUBLE) END)) v(category, value)""")
def cashflow_by_ledger(spark, sf_dir):
    """C10 with ``by=ledger_id``: one cashflow ledger per nation, one job."""
    t = A.Tables(spark, sf_dir)
    return C.cashflow_statement(A.income_by_nation(t), A.ledger_by_nation(t), by=["ledger_id"])


@register("credits_table_totals", f"""
WITH {Q.BALANCES}
SELECT year, month, name, currency, value FROM cd_f
UNION ALL
SELECT year, month, 'Total', NULL, CAST(COALESCE(SUM({Q.money('value', 4)}), 0) AS DOUBLE)
FROM cd_f GROUP BY year, month""")
def credits_table_totals(spark, sf_dir):
    """C12 for credits/debts: signed balances with a Total row per month."""
    _, _, _, cd = _nw(spark, sf_dir)
    return N.table_with_totals(cd, "name", "value", attrs=["currency"])
