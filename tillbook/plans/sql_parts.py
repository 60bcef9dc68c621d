"""SQL text fragments shared by the DuckDB oracles.

The oracles restate each query independently in plain SQL over the driver's
tables.  Fragments are generated from the same fixed-value lists the Spark
code uses, so a list change moves both sides.
"""

from __future__ import annotations

from tillbook.domains import CASING_EXCEPTIONS, INCOME_CATEGORIES, INVESTMENT_CATEGORIES, \
    LIQUIDITY_CATEGORIES, PRIMARY_DISPLAY_ORDER, TOTAL_LABEL


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def f1(x: str) -> str:
    """Normalise category (F1) in SQL."""
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in CASING_EXCEPTIONS.items())
    return (f"COALESCE(CASE lower({x}) {cases} END, "
            f"upper(substr(lower({x}), 1, 1)) || substr(lower({x}), 2))")


def f3(x: str) -> str:
    return f"lower(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'))"


def money(x: str, scale: int = 2) -> str:
    return f"CAST({x} AS DECIMAL(18,{scale}))"


def pick(key: str, labels: list[str]) -> str:
    n = len(labels)
    whens = " ".join(f"WHEN ({key}) % {n} = {i} THEN {q(v)}" for i, v in enumerate(labels))
    return f"CASE {whens} END"


def display_rank(x: str) -> str:
    whens = " ".join(f"WHEN {q(v)} THEN {i}" for i, v in enumerate([*PRIMARY_DISPLAY_ORDER,
                                                                    TOTAL_LABEL]))
    return f"CAST(CASE {x} {whens} END AS INTEGER)"


def income_category(x: str) -> str:
    return (f"CASE {x} WHEN '1-URGENT' THEN {q(INCOME_CATEGORIES[0])} "
            f"WHEN '2-HIGH' THEN {q(INCOME_CATEGORIES[1])} "
            f"WHEN '3-MEDIUM' THEN {q(INCOME_CATEGORIES[2])} ELSE {q(INCOME_CATEGORIES[3])} END")


LEDGER = f"""ledger AS (
  SELECT p.p_name AS expense_name, CAST(l.l_shipdate AS DATE) AS expense_date,
         l.l_extendedprice AS expense_amount, 'E' AS currency,
         l.l_extendedprice AS expense_in_ref_currency,
         {f1('p.p_type')} AS primary_category, {f1('p.p_brand')} AS secondary_category,
         CAST(year(l.l_shipdate) AS INTEGER) AS year, CAST(month(l.l_shipdate) AS INTEGER) AS month,
         l.l_suppkey AS ledger_id
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""

LEDGER_IDS = f"""ledger_ids AS (
  SELECT o_orderkey AS expense_id, o_orderpriority AS expense_name,
         CAST(o_orderdate AS DATE) AS expense_date, o_totalprice AS expense_amount,
         'E' AS currency, o_totalprice AS expense_in_ref_currency,
         {f1('o_orderpriority')} AS primary_category, {f1('o_orderstatus')} AS secondary_category,
         CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month
  FROM orders)"""


def summaries_long(ledger: str = "ledger", kinds=("primary", "secondary")) -> str:
    """CTEs ending in ``summary(kind, category, year, month, amount)``."""
    facts = " UNION ALL ".join(
        f"SELECT year, month, '{k}' AS kind, {k}_category AS category, "
        f"{money('expense_in_ref_currency')} AS amt FROM {ledger}" for k in kinds)
    return f"""facts AS ({facts}),
kept AS (SELECT * FROM facts WHERE category IS NOT NULL AND category <> 'Total'),
smonths AS (SELECT DISTINCT kind, year, month FROM facts),
scats AS (SELECT DISTINCT kind, year, category FROM kept),
scells AS (SELECT kind, year, month, category, SUM(amt) AS amount FROM kept GROUP BY kind, year, month, category),
sgrid AS (SELECT c.kind, c.category, c.year, m.month, COALESCE(x.amount, 0) AS amount
          FROM scats c JOIN smonths m ON c.kind = m.kind AND c.year = m.year
          LEFT JOIN scells x ON x.kind = c.kind AND x.year = c.year AND x.month = m.month
                             AND x.category = c.category),
stotals AS (SELECT m.kind, 'Total' AS category, m.year, m.month, COALESCE(SUM(k.amt), 0) AS amount
            FROM smonths m LEFT JOIN kept k ON k.kind = m.kind AND k.year = m.year AND k.month = m.month
            GROUP BY m.kind, m.year, m.month),
summary AS (SELECT kind, category, year, month, CAST(amount AS DOUBLE) AS amount FROM sgrid
            UNION ALL SELECT kind, category, year, month, CAST(amount AS DOUBLE) FROM stotals)"""


def wide_months(value: str = "amount", month: str = "month") -> str:
    return ", ".join(f"SUM(CASE WHEN {month} = {m} THEN {value} END) AS \"{m:02d}\""
                     for m in range(1, 13))


INVESTMENT_PICK = lambda key: pick(key, INVESTMENT_CATEGORIES)
LIQUIDITY_PICK = lambda key: pick(key, LIQUIDITY_CATEGORIES)


INCOME = f"""income_f AS (
  SELECT category, year, month, CAST(SUM({money('o_totalprice')}) AS DOUBLE) AS value
  FROM (SELECT {income_category('o_orderpriority')} AS category,
               CAST(year(o_orderdate) AS INTEGER) AS year,
               CAST(month(o_orderdate) AS INTEGER) AS month, o_totalprice FROM orders) x
  GROUP BY category, year, month)"""

CASHFLOW_GRID = f"""{LEDGER}, {INCOME},
inc AS (SELECT year, month,
   SUM(CASE WHEN category = 'Salary' THEN {money('value')} END) AS c1,
   SUM(CASE WHEN category = 'Interests Bank account' THEN {money('value')} END) AS c2,
   SUM(CASE WHEN category = 'Dividendi e Cedole' THEN {money('value')} END) AS c3,
   SUM(CASE WHEN category = 'Other' THEN {money('value')} END) AS c4
   FROM income_f GROUP BY year, month),
spend AS (SELECT year, month,
   COALESCE(SUM(CASE WHEN primary_category IS NOT NULL AND primary_category <> 'Total'
                     THEN {money('expense_in_ref_currency')} END), 0) AS spending
   FROM ledger GROUP BY year, month),
cyears AS (SELECT year FROM inc UNION SELECT year FROM spend),
cspine AS (SELECT year, CAST(m AS INTEGER) AS month FROM cyears CROSS JOIN range(1, 13) t(m)),
cgrid0 AS (SELECT s.year, s.month, COALESCE(i.c1, 0) AS c1, COALESCE(i.c2, 0) AS c2,
           COALESCE(i.c3, 0) AS c3, COALESCE(i.c4, 0) AS c4, COALESCE(p.spending, 0) AS spending
           FROM cspine s LEFT JOIN inc i ON i.year = s.year AND i.month = s.month
           LEFT JOIN spend p ON p.year = s.year AND p.month = s.month),
cgrid AS (SELECT *, c1 + c2 + c3 + c4 AS income, c1 + c2 + c3 + c4 - spending AS saving FROM cgrid0)"""

HOLDINGS = f"""hold AS (
  SELECT 'Part#' || CAST(l_partkey AS VARCHAR) AS asset_name, {INVESTMENT_PICK('l_partkey')} AS category,
         '' AS link, year, month, CAST(SUM({money('l_quantity')}) AS DOUBLE) AS quantity
  FROM (SELECT l_partkey, l_quantity, CAST(year(l_shipdate) AS INTEGER) AS year,
               CAST(month(l_shipdate) AS INTEGER) AS month FROM lineitem) x
  GROUP BY l_partkey, year, month),
prices_f AS (
  SELECT 'Part#' || CAST(m.l_partkey AS VARCHAR) AS asset_name, m.year, m.month, p.p_retailprice AS price
  FROM (SELECT DISTINCT l_partkey, CAST(year(l_shipdate) AS INTEGER) AS year,
               CAST(month(l_shipdate) AS INTEGER) AS month FROM lineitem) m
  JOIN part p ON m.l_partkey = p.p_partkey WHERE p.p_size >= 5),
pos AS (
  SELECT h.*, f.price,
         CAST({money('h.quantity', 4)} * {money('f.price', 4)} AS DECIMAL(38,4)) AS value_dec
  FROM hold h LEFT JOIN prices_f f
    ON f.asset_name = h.asset_name AND f.year = h.year AND f.month = h.month)"""

BALANCES = f"""liq_f AS (
  SELECT c.c_name AS asset_name, {LIQUIDITY_PICK('c.c_custkey')} AS category, 'E' AS currency,
         a.year, a.month, a.value
  FROM (SELECT o_custkey, year, month, CAST(SUM({money('o_totalprice')}) AS DOUBLE) AS value
        FROM (SELECT o_custkey, o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS year,
                     CAST(month(o_orderdate) AS INTEGER) AS month FROM orders) x
        GROUP BY o_custkey, year, month) a
  JOIN customer c ON a.o_custkey = c.c_custkey),
cd_f AS (
  SELECT c.c_name AS name, 'E' AS currency, o.year, o.month, c.c_acctbal AS value
  FROM (SELECT DISTINCT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year,
               CAST(month(o_orderdate) AS INTEGER) AS month FROM orders) o
  JOIN customer c ON o.o_custkey = c.c_custkey)"""

NETWORTH_GRID = f"""{HOLDINGS}, {BALANCES},
inv AS (SELECT year, month,
   SUM(CASE WHEN category = 'Stocks/ETF' THEN value_dec END) AS i1,
   SUM(CASE WHEN category = 'Commodities' THEN value_dec END) AS i2,
   SUM(CASE WHEN category = 'Bonds' THEN value_dec END) AS i3
   FROM pos GROUP BY year, month),
liq AS (SELECT year, month, CAST(SUM({money('value', 4)}) AS DECIMAL(38,4)) AS liq
        FROM liq_f GROUP BY year, month),
cd AS (SELECT year, month, CAST(SUM({money('value', 4)}) AS DECIMAL(38,4)) AS cd
       FROM cd_f GROUP BY year, month),
ny AS (SELECT min(year) AS y0, max(year) AS y1 FROM
       (SELECT year FROM inv UNION ALL SELECT year FROM liq UNION ALL SELECT year FROM cd) u),
nspine AS (SELECT CAST(y AS INTEGER) AS year, CAST(m AS INTEGER) AS month
           FROM ny, range(ny.y0, ny.y1 + 1) a(y), range(1, 13) b(m)),
ngrid0 AS (SELECT s.year, s.month,
   CAST(COALESCE(inv.i1, 0) AS DECIMAL(38,4)) AS i1, CAST(COALESCE(inv.i2, 0) AS DECIMAL(38,4)) AS i2,
   CAST(COALESCE(inv.i3, 0) AS DECIMAL(38,4)) AS i3, CAST(COALESCE(liq.liq, 0) AS DECIMAL(38,4)) AS liq,
   CAST(COALESCE(cd.cd, 0) AS DECIMAL(38,4)) AS cd
   FROM nspine s LEFT JOIN inv ON inv.year = s.year AND inv.month = s.month
   LEFT JOIN liq ON liq.year = s.year AND liq.month = s.month
   LEFT JOIN cd ON cd.year = s.year AND cd.month = s.month),
ngrid1 AS (SELECT *, CAST(i1 + i2 + i3 + liq + cd AS DECIMAL(38,4)) AS nw FROM ngrid0),
ngrid AS (SELECT *, COALESCE(lag(nw) OVER (ORDER BY year, month), 0) AS prev FROM ngrid1)"""


KNOWN = f"""known AS (SELECT DISTINCT 'primary' AS kind, c_mktsegment AS category FROM customer
          UNION SELECT DISTINCT 'primary', {f1('p_type')} FROM part
          UNION SELECT DISTINCT 'secondary', n_name FROM nation)"""
