"""Registered queries: the refused half of every change batch (J8, M1-M16), and M10/M5/M6 on the other tables.

Each batch holds rows that break every rule of its operator, null keys included.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tillbook.domains import INCOME_CATEGORIES, INVESTMENT_CATEGORIES
from tillbook.functions.scalars import normalize_category
from tillbook.operators import changes as M
from tillbook.operators import summaries as S
from tillbook.plans import sql_parts as Q
from tillbook.plans.change_queries import KNOWN_SQL, MAPPINGS_SQL, PART_YEARS_SQL, TEMPLATES_SQL, _part_years, enrich_sql, event_batch, EVENT_BATCH_SQL
from tillbook.plans.registry import register
from tillbook.session import stored
from tillbook.sources import adapters as A

f1, f3, money = Q.f1, Q.f3, Q.money
INVESTMENTS = ", ".join(Q.q(c) for c in INVESTMENT_CATEGORIES)
INCOMES = ", ".join(Q.q(c) for c in INCOME_CATEGORIES)


def _order_month():
    d = F.col("o_orderdate").cast("date")
    return [F.year(d).alias("year"), F.month(d).alias("month")]


ORDER_MONTH_SQL = "CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month"


def refused_sql(batch: str, columns: str, keys: list[str], rule: str = "NULL", order: str = "seq DESC") -> str:
    """Rejects of ``batch`` in the library's order of checks: the rule, then null keys, then rows that did not win."""
    nulls = " ".join(f"WHEN {k} IS NULL THEN 'missing {k}'" for k in keys)
    return f"""ruled AS (SELECT *, {rule} AS why FROM {batch}),
keyed AS (SELECT * EXCLUDE (why), COALESCE(why, CASE {nulls} END) AS why FROM ruled),
ranked AS (SELECT *, CASE WHEN why IS NULL THEN row_number() OVER (PARTITION BY why, {', '.join(keys)} ORDER BY {order}) END AS place FROM keyed),
refused AS (SELECT {columns}, COALESCE(why, 'superseded in batch') AS reason FROM ranked WHERE why IS NOT NULL OR place > 1),
won AS (SELECT {columns} FROM ranked WHERE why IS NULL AND place = 1)"""


@register("append_rejects", f"""
WITH {MAPPINGS_SQL}, {EVENT_BATCH_SQL.replace('event_id AS seq', 'event_id // 3 AS seq')},
ranked AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY expense_name, y, m, d, expense_amount, currency, primary_category) AS place FROM ebatch),
once AS (SELECT * EXCLUDE (place) FROM ranked WHERE place = 1), {enrich_sql('once')}
SELECT seq, expense_name, year, month, expense_day, expense_amount, reason FROM erejects
UNION ALL SELECT seq, expense_name, y, m, d, expense_amount, 'superseded in batch' FROM ranked WHERE place > 1""")
def append_rejects(spark, sf_dir):
    """M1: three rows share each ``seq``; one of them is taken, so ids stay unique."""
    t = A.Tables(spark, sf_dir)
    batch = event_batch(t).withColumn("seq", F.floor(F.col("seq") / 3).cast("long"))
    _, bad = M.append_expenses(A.ledger_with_ids(t), batch, A.mappings(t))
    return bad.select("seq", "expense_name", "year", "month", "expense_day", "expense_amount", "reason")


@register("appended_ids", f"""
WITH {Q.LEDGER_IDS}, {MAPPINGS_SQL}, {EVENT_BATCH_SQL.replace('event_id AS seq', 'event_id // 3 AS seq')},
once AS (SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY seq
         ORDER BY expense_name, y, m, d, expense_amount, currency, primary_category) AS place FROM ebatch) x WHERE place = 1), {enrich_sql('once')}
SELECT (SELECT count(*) FROM ledger_ids) + (SELECT count(*) FROM enriched) AS n_rows,
       (SELECT count(*) FROM ledger_ids) + (SELECT count(*) FROM enriched) AS n_ids""")
def appended_ids(spark, sf_dir):
    t = A.Tables(spark, sf_dir)
    batch = event_batch(t).withColumn("seq", F.floor(F.col("seq") / 3).cast("long"))
    out, _ = M.append_expenses(A.ledger_with_ids(t), batch, A.mappings(t))
    return out.agg(F.count("*").alias("n_rows"), F.countDistinct("expense_id").alias("n_ids"))


EDITS_SQL = """e AS (SELECT CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_custkey % 5 = 0 THEN -o_orderkey ELSE o_orderkey END AS expense_id,
  o_custkey AS seq, CASE WHEN o_custkey % 2 = 0 THEN '31' ELSE '2020-02-30' END AS expense_date FROM orders
  UNION ALL SELECT o_orderkey, 0, '1' FROM orders WHERE o_custkey % 7 = 0)"""


@register("edit_rejects", f"""
WITH {Q.LEDGER_IDS}, {EDITS_SQL}, {refused_sql('e', 'expense_id, seq, expense_date', ['expense_id'])},
checked AS (SELECT w.*, l.expense_id IS NOT NULL AS found,
       CASE WHEN w.expense_date = '31' THEN TRY_CAST(printf('%04d-%02d-%02d', l.year, l.month, 31) AS DATE)
            WHEN w.expense_date = '1' THEN make_date(l.year, l.month, 1) END AS nd
  FROM won w LEFT JOIN ledger_ids l ON l.expense_id = w.expense_id)
SELECT expense_id, seq, expense_date, reason FROM refused
UNION ALL SELECT expense_id, seq, expense_date, CASE WHEN found THEN 'invalid date' ELSE 'expense not found' END
FROM checked WHERE NOT found OR nd IS NULL""")
def edit_rejects(spark, sf_dir):
    t = A.Tables(spark, sf_dir)
    none = F.lit(None).cast("string")
    o = t.orders
    key = F.when(F.col("o_orderstatus") != "P", F.when(F.col("o_custkey") % 5 == 0, -F.col("o_orderkey")).otherwise(F.col("o_orderkey")))
    a = o.select(key.alias("expense_id"), F.col("o_custkey").alias("seq"),
                 F.when(F.col("o_custkey") % 2 == 0, "31").otherwise("2020-02-30").alias("expense_date"))
    b = o.where("o_custkey % 7 = 0").select(F.col("o_orderkey").alias("expense_id"), F.lit(0).cast("long").alias("seq"), F.lit("1").alias("expense_date"))
    edits = a.unionByName(b).withColumns({"expense_name": none, "expense_amount": F.lit(None).cast("double"), "currency": none,
                                          "primary_category": none, "secondary_category": none})
    _, bad = M.edit_expenses(A.ledger_with_ids(t), edits)
    return bad.select("expense_id", "seq", "expense_date", "reason")


@register("edit_expenses_by_ledger", f"""
WITH {Q.LEDGER_IDS}, l AS (SELECT l.*, o.o_custkey AS ledger_id FROM ledger_ids l JOIN orders o ON o.o_orderkey = l.expense_id),
e AS (SELECT o_custkey AS ledger_id, max(o_orderkey) AS expense_id FROM orders GROUP BY o_custkey)
SELECT l.ledger_id, l.expense_id, l.expense_name, l.expense_date,
       CASE WHEN e.expense_id IS NOT NULL THEN CAST(1.005 AS DOUBLE) ELSE l.expense_amount END AS expense_amount, l.year, l.month
FROM l LEFT JOIN e ON e.ledger_id = l.ledger_id AND e.expense_id = l.expense_id""")
def edit_expenses_by_ledger(spark, sf_dir):
    """M3 over many ledgers: each customer ledger's last order gets a new amount; all other rows stay."""
    t = A.Tables(spark, sf_dir)
    none = F.lit(None).cast("string")
    led = A.ledger_with_ids(t).join(t.orders.select(F.col("o_orderkey").alias("expense_id"), F.col("o_custkey").alias("ledger_id")), "expense_id")
    edits = t.orders.groupBy(F.col("o_custkey").alias("ledger_id")).agg(F.max("o_orderkey").alias("expense_id")).withColumns(
        {"seq": F.lit(1), "expense_name": none, "expense_date": none, "expense_amount": F.lit(1.005), "currency": none,
         "primary_category": none, "secondary_category": none})
    out, _ = M.edit_expenses(led, edits, by=["ledger_id"])
    return out.select("ledger_id", "expense_id", "expense_name", "expense_date", "expense_amount", "year", "month")


INCOME_CHANGES_SQL = f"""ch AS (SELECT o_orderkey AS seq, CAST(year(o_orderdate) AS INTEGER) AS year,
  CASE WHEN o_orderkey % 11 = 0 THEN 13 ELSE CAST(month(o_orderdate) AS INTEGER) END AS month,
  CASE o_orderstatus WHEN 'F' THEN 'Salary' WHEN 'O' THEN CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE 'Other' END ELSE 'Pension' END AS category,
  o_totalprice AS value FROM orders)"""


@register("set_income_rejects", f"""
WITH {INCOME_CHANGES_SQL}, {refused_sql('ch', 'seq, year, month, category, value', ['year', 'month', 'category'],
    f"CASE WHEN category NOT IN ({INCOMES}) THEN 'invalid income category' WHEN month NOT BETWEEN 1 AND 12 THEN 'month out of range' END")}
SELECT * FROM refused""")
def set_income_rejects(spark, sf_dir):
    t = A.Tables(spark, sf_dir)
    d, status = F.col("o_orderdate").cast("date"), F.col("o_orderstatus")
    ch = t.orders.select(
        F.col("o_orderkey").alias("seq"), F.year(d).alias("year"),
        F.when(F.col("o_orderkey") % 11 == 0, 13).otherwise(F.month(d)).alias("month"),
        F.when(status == "F", "Salary").when((status == "O") & (F.col("o_custkey") % 3 != 0), "Other").when(status != "O", "Pension").alias("category"),
        F.col("o_totalprice").alias("value"))
    _, bad = M.set_income(A.income(t), ch)
    return bad


@register("set_positions_rejects", f"""
WITH {Q.BALANCES},
ch AS (SELECT o_orderkey AS seq, CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_custkey % 4 = 0 THEN 'no ' || c_name ELSE c_name END AS asset_name,
              {ORDER_MONTH_SQL}, o_totalprice AS value FROM orders JOIN customer ON o_custkey = c_custkey),
{refused_sql('ch', 'seq, asset_name, year, month, value', ['year', 'month', 'asset_name'])}
SELECT * FROM refused
UNION ALL SELECT *, 'not found' FROM won w WHERE NOT EXISTS (SELECT 1 FROM liq_f f WHERE f.year = w.year AND f.asset_name = w.asset_name)""")
def set_positions_rejects(spark, sf_dir):
    t = A.Tables(spark, sf_dir)
    name = F.when(F.col("o_orderstatus") != "P", F.when(F.col("o_custkey") % 4 == 0, F.concat(F.lit("no "), F.col("c_name"))).otherwise(F.col("c_name")))
    ch = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("seq"), name.alias("asset_name"), *_order_month(), F.col("o_totalprice").alias("value"))
    _, bad = M.set_values(A.liquidity(t), ch, "asset_name", "value")
    return bad


@register("set_quantities_and_prices", f"""
WITH {Q.HOLDINGS}, {PART_YEARS_SQL},
ch AS (SELECT year, 'Part#' || CAST(l_partkey AS VARCHAR) AS asset_name, 7 AS month, CAST(p_size AS DOUBLE) AS v FROM pyp),
hq AS (SELECT COALESCE(h.asset_name, c.asset_name) AS asset_name, COALESCE(h.year, c.year) AS year, COALESCE(h.month, c.month) AS month,
              COALESCE(c.v, h.quantity) AS quantity
       FROM hold h FULL JOIN ch c ON c.asset_name = h.asset_name AND c.year = h.year AND c.month = h.month),
pc AS (SELECT c.* FROM ch c WHERE EXISTS (SELECT 1 FROM prices_f f WHERE f.asset_name = c.asset_name AND f.year = c.year)),
hp AS (SELECT COALESCE(f.asset_name, c.asset_name) AS asset_name, COALESCE(f.year, c.year) AS year, COALESCE(f.month, c.month) AS month,
              COALESCE(c.v, f.price) AS price
       FROM prices_f f FULL JOIN pc c ON c.asset_name = f.asset_name AND c.year = f.year AND c.month = f.month)
SELECT hq.asset_name, hq.year, hq.month, hq.quantity, hp.price FROM hq LEFT JOIN hp USING (asset_name, year, month)""")
def set_quantities_and_prices(spark, sf_dir):
    """M10 on holdings and prices: every July cell of a held asset's year is set (new cells take the asset's attributes)."""
    t = A.Tables(spark, sf_dir)
    holdings, prices = A.positions(t)
    cells = stored(_part_years(t).select(F.col("l_partkey").alias("seq"), "year", F.lit(7).alias("month"),
                                         A.asset_name_of_part("l_partkey").alias("asset_name"), F.col("p_size").cast("double").alias("v")), "july-cells")
    h, _ = M.set_values(holdings, cells.withColumnRenamed("v", "quantity"), "asset_name", "quantity")
    p, _ = M.set_values(prices, cells.withColumnRenamed("v", "price"), "asset_name", "price")
    return h.select("asset_name", "year", "month", "quantity").join(p, ["asset_name", "year", "month"], "left")


ADDS_SQL = """sy AS (SELECT DISTINCT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS year FROM lineitem),
adds AS (SELECT s_suppkey AS seq, sy.year, CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE 'S' || CAST(s_suppkey // 2 AS VARCHAR) END AS asset_name,
  CASE WHEN s_acctbal > 5000 THEN 'Stocks/ETF' WHEN s_acctbal > 0 THEN 'Bonds' WHEN s_acctbal > -500 THEN 'Crypto' END AS category, '' AS link
  FROM sy JOIN supplier ON l_suppkey = s_suppkey
  UNION ALL SELECT l_partkey, year, 'Part#' || CAST(l_partkey AS VARCHAR), 'Bonds', '' FROM pyp)"""


def _adds(t):
    d, bal = F.col("l_shipdate").cast("date"), F.col("s_acctbal")
    sy = t.lineitem.select("l_suppkey", F.year(d).alias("year")).distinct()
    name = F.when(F.col("s_suppkey") % 6 != 0, F.concat(F.lit("S"), F.floor(F.col("s_suppkey") / 2).cast("string")))
    a = sy.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("s_suppkey").alias("seq"), "year", name.alias("asset_name"),
        F.when(bal > 5000, "Stocks/ETF").when(bal > 0, "Bonds").when(bal > -500, "Crypto").alias("category"), F.lit("").alias("link"))
    b = _part_years(t).select(F.col("l_partkey").alias("seq"), "year", A.asset_name_of_part("l_partkey").alias("asset_name"),
                              F.lit("Bonds").alias("category"), F.lit("").alias("link"))
    return a.unionByName(b)


ADD_RULE = f"""CASE WHEN category IS NULL OR category NOT IN ({INVESTMENTS}) THEN 'invalid category'
     WHEN EXISTS (SELECT 1 FROM hold h WHERE h.year = adds.year AND h.asset_name = adds.asset_name) THEN 'already exists' END"""


@register("add_assets_rejects", f"""
WITH {Q.HOLDINGS}, {PART_YEARS_SQL}, {ADDS_SQL},
{refused_sql('adds', 'seq, year, asset_name, category, link', ['year', 'asset_name'], ADD_RULE, 'seq')}
SELECT * FROM refused""")
def add_assets_rejects(spark, sf_dir):
    t = A.Tables(spark, sf_dir)
    _, _, bad = M.add_holdings(*A.positions(t), _adds(t), INVESTMENT_CATEGORIES)
    return bad


@register("holdings_and_prices_added_and_removed", f"""
WITH {Q.HOLDINGS}, {PART_YEARS_SQL}, {ADDS_SQL},
{refused_sql('adds', 'seq, year, asset_name, category, link', ['year', 'asset_name'], ADD_RULE, 'seq')},
gone AS (SELECT year, 'Part#' || CAST(l_partkey AS VARCHAR) AS asset_name FROM pyp WHERE p_size < 10),
p2 AS (SELECT asset_name, year, month, price FROM prices_f
       UNION ALL SELECT asset_name, year, CAST(m AS INTEGER), CAST(0.0 AS DOUBLE) FROM won, range(1, 13) t(m))
SELECT asset_name, year, month, price FROM p2 WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.year = p2.year AND g.asset_name = p2.asset_name)""")
def holdings_and_prices_added_and_removed(spark, sf_dir):
    """M5 and M6 on the price side: added assets get zero prices, removed assets leave both tables."""
    t = A.Tables(spark, sf_dir)
    h, p, _ = M.add_holdings(*A.positions(t), _adds(t), INVESTMENT_CATEGORIES)
    gone = _part_years(t).where("p_size < 10").select("year", A.asset_name_of_part("l_partkey").alias("asset_name"))
    _, p = M.remove_holdings(h, p, gone)
    return p.select("asset_name", "year", "month", "price")


@register("set_category_rejects", f"""
WITH {Q.HOLDINGS}, {PART_YEARS_SQL},
ch AS (SELECT l_partkey AS seq, year, CASE WHEN p_size < 5 THEN NULL WHEN p_size < 15 THEN 'no asset' ELSE 'Part#' || CAST(l_partkey // 2 * 2 AS VARCHAR) END AS asset_name,
              CASE WHEN p_size % 3 = 0 THEN 'Bonds' WHEN p_size % 3 = 1 THEN 'Stocks/ETF' WHEN p_size % 2 = 0 THEN 'Crypto' END AS category FROM pyp),
{refused_sql('ch', 'seq, year, asset_name, category', ['year', 'asset_name'],
             f"CASE WHEN category IS NULL OR category NOT IN ({INVESTMENTS}) THEN 'invalid category' END")}
SELECT * FROM refused
UNION ALL SELECT *, 'not found' FROM won w WHERE NOT EXISTS (SELECT 1 FROM hold h WHERE h.year = w.year AND h.asset_name = w.asset_name)""")
def set_category_rejects(spark, sf_dir):
    t = A.Tables(spark, sf_dir)
    size = F.col("p_size")
    name = F.when(size >= 5, F.when(size < 15, F.lit("no asset")).otherwise(
        F.concat(F.lit("Part#"), (F.floor(F.col("l_partkey") / 2) * 2).cast("string"))))
    ch = _part_years(t).select(F.col("l_partkey").alias("seq"), "year", name.alias("asset_name"),
                               F.when(size % 3 == 0, "Bonds").when(size % 3 == 1, "Stocks/ETF").when(size % 2 == 0, "Crypto").alias("category"))
    _, bad = M.set_attribute(A.holdings(t), ch, "asset_name", "category", valid=INVESTMENT_CATEGORIES)
    return bad


@register("set_link_rejects", f"""
WITH {Q.HOLDINGS}, {PART_YEARS_SQL},
ch AS (SELECT l_partkey AS seq, year + p_size % 2 * 100 AS year, CASE WHEN p_size < 5 THEN NULL ELSE 'Part#' || CAST(l_partkey AS VARCHAR) END AS asset_name, p_brand AS link FROM pyp),
{refused_sql('ch', 'seq, year, asset_name, link', ['year', 'asset_name'])}
SELECT * FROM refused
UNION ALL SELECT *, 'not found' FROM won w WHERE NOT EXISTS (SELECT 1 FROM hold h WHERE h.year = w.year AND h.asset_name = w.asset_name)""")
def set_link_rejects(spark, sf_dir):
    t = A.Tables(spark, sf_dir)
    ch = _part_years(t).select(F.col("l_partkey").alias("seq"), (F.col("year") + F.col("p_size") % 2 * 100).cast("int").alias("year"),
                               F.when(F.col("p_size") >= 5, A.asset_name_of_part("l_partkey")).alias("asset_name"), F.col("p_brand").alias("link"))
    _, bad = M.set_attribute(A.holdings(t), ch, "asset_name", "link")
    return bad


@register("rename_rejects", f"""
WITH {Q.HOLDINGS}, {PART_YEARS_SQL},
rn AS (SELECT l_partkey AS seq, year,
              CASE WHEN p_size < 5 THEN NULL WHEN p_size < 10 THEN 'no asset' ELSE 'Part#' || CAST(l_partkey AS VARCHAR) END AS old_name,
              CASE WHEN p_size > 45 THEN 'Part#' || CAST(l_partkey + 1 AS VARCHAR) ELSE 'New ' || p_brand END AS new_name FROM pyp),
names AS (SELECT DISTINCT year, asset_name FROM hold),
ruled AS (SELECT *, CASE WHEN old_name IS NULL THEN 'missing name'
    WHEN NOT EXISTS (SELECT 1 FROM names n WHERE n.year = rn.year AND n.asset_name = rn.old_name) THEN 'not found'
    WHEN new_name <> old_name AND EXISTS (SELECT 1 FROM names n WHERE n.year = rn.year AND n.asset_name = rn.new_name) THEN 'already exists' END AS why FROM rn),
a1 AS (SELECT *, row_number() OVER (PARTITION BY year, old_name ORDER BY seq) AS o FROM ruled WHERE why IS NULL),
a2 AS (SELECT *, row_number() OVER (PARTITION BY year, new_name ORDER BY seq) AS n FROM a1 WHERE o = 1)
SELECT seq, year, old_name, new_name, why AS reason FROM ruled WHERE why IS NOT NULL
UNION ALL SELECT seq, year, old_name, new_name, 'superseded in batch' FROM a1 WHERE o > 1
UNION ALL SELECT seq, year, old_name, new_name, 'superseded in batch' FROM a2 WHERE n > 1""")
def rename_rejects(spark, sf_dir):
    t = A.Tables(spark, sf_dir)
    size = F.col("p_size")
    rn = _part_years(t).select(
        F.col("l_partkey").alias("seq"), "year",
        F.when(size >= 5, F.when(size < 10, F.lit("no asset")).otherwise(A.asset_name_of_part("l_partkey"))).alias("old_name"),
        F.when(size > 45, F.concat(F.lit("Part#"), (F.col("l_partkey") + 1).cast("string"))).otherwise(F.concat(F.lit("New "), F.col("p_brand"))).alias("new_name"))
    _, bad = M.rename_entities(A.holdings(t), rn, "asset_name")
    return bad


@register("add_recurring_rejects", f"""
WITH {TEMPLATES_SQL},
adds AS (SELECT s_suppkey // 2 AS seq, s_name AS expense_name, CASE WHEN s_nationkey = 3 THEN NULL ELSE CAST(s_nationkey + 5 AS BIGINT) END AS expense_day FROM supplier),
{refused_sql('adds', 'seq, expense_name, expense_day', ['seq'], "CASE WHEN expense_day IS NULL OR expense_day NOT BETWEEN 1 AND 28 THEN 'day outside 1..28' END", 'expense_name')}
SELECT * FROM refused""")
def add_recurring_rejects(spark, sf_dir):
    t = A.Tables(spark, sf_dir)
    adds = t.supplier.select(F.floor(F.col("s_suppkey") / 2).cast("long").alias("seq"), F.col("s_name").alias("expense_name"),
                             F.when(F.col("s_nationkey") != 3, F.col("s_nationkey") + 5).cast("long").alias("expense_day"),
                             F.col("s_acctbal").alias("expense_amount"), F.lit("E").alias("currency"),
                             F.lit("x").alias("primary_category"), F.lit("y").alias("secondary_category"))
    _, bad = M.add_recurring(A.recurring(t), adds)
    return bad.select("seq", "expense_name", "expense_day", "reason")


MAPPING_CHANGES_SQL = """ch AS (SELECT p_partkey AS seq, 'add' AS op, CASE WHEN p_size < 3 THEN NULL ELSE ' ' || upper(p_name) END AS expense_name, p_size > 40 AS overwrite FROM part
  UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'remove' ELSE 'drop' END, c_name, false FROM customer)"""


@register("mapping_change_rejects", f"""
WITH {MAPPINGS_SQL}, {MAPPING_CHANGES_SQL}, keyed0 AS (SELECT *, {f3('expense_name')} AS name_key FROM ch),
{refused_sql('keyed0', 'seq, op, expense_name, overwrite, name_key', ['name_key'], order='seq')}
SELECT seq, op, expense_name, overwrite, reason FROM refused
UNION ALL SELECT seq, op, expense_name, overwrite, why FROM (SELECT w.*, CASE WHEN op NOT IN ('add', 'remove') THEN 'unknown op'
    WHEN op = 'add' AND ex AND NOT overwrite THEN 'mapping exists; pass overwrite' WHEN op = 'remove' AND NOT ex THEN 'no mapping found' END AS why
  FROM (SELECT won.*, EXISTS (SELECT 1 FROM mp WHERE mp.name_key = won.name_key) AS ex FROM won) w) z WHERE why IS NOT NULL""")
def mapping_change_rejects(spark, sf_dir):
    t = A.Tables(spark, sf_dir)
    a = t.part.select(F.col("p_partkey").alias("seq"), F.lit("add").alias("op"),
                      F.when(F.col("p_size") >= 3, F.concat(F.lit(" "), F.upper("p_name"))).alias("expense_name"), (F.col("p_size") > 40).alias("overwrite"))
    c = t.customer.select(F.col("c_custkey").alias("seq"), F.when(F.col("c_custkey") % 2 == 0, "remove").otherwise("drop").alias("op"),
                          F.col("c_name").alias("expense_name"), F.lit(False).alias("overwrite"))
    ch = a.unionByName(c).withColumns({"primary_category": F.lit("x"), "secondary_category": F.lit("y")})
    _, bad = M.change_mappings(A.mappings(t), ch)
    return bad.select("seq", "op", "expense_name", "overwrite", "reason")


@register("mappings_cleared", f"""
WITH {MAPPINGS_SQL}, left_over AS (SELECT * FROM mp WHERE false)
SELECT (SELECT count(*) FROM mp) AS n_before, (SELECT count(*) FROM left_over) AS n_after""")
def mappings_cleared(spark, sf_dir):
    """Clearing keeps the table and drops its rows."""
    m = A.mappings(A.Tables(spark, sf_dir))
    after = M.clear_mappings(m)
    return m.select(F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after.select(F.lit(0).alias("b"), F.lit(1).alias("a"))) \
        .agg(F.coalesce(F.sum("b"), F.lit(0)).cast("long").alias("n_before"), F.coalesce(F.sum("a"), F.lit(0)).cast("long").alias("n_after"))


@register("known_category_rejects", f"""
WITH {KNOWN_SQL},
ch AS (SELECT c_custkey AS seq, CASE WHEN c_custkey % 3 = 0 THEN 'remove' WHEN c_custkey % 3 = 1 THEN 'add' ELSE 'keep' END AS op,
              CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 'tertiary' ELSE 'primary' END AS kind,
              CASE WHEN c_nationkey < 5 THEN c_mktsegment WHEN c_nationkey < 20 THEN c_name END AS category FROM customer),
{refused_sql('ch', 'seq, op, kind, category', ['kind', 'category'], order='seq')}
SELECT * FROM refused
UNION ALL SELECT seq, op, kind, category, why FROM (SELECT w.*, CASE WHEN kind NOT IN ('primary', 'secondary') THEN 'invalid kind'
    WHEN op NOT IN ('add', 'remove') THEN 'unknown op' WHEN op = 'add' AND ex THEN 'category exists' WHEN op = 'remove' AND NOT ex THEN 'category not found' END AS why
  FROM (SELECT won.*, EXISTS (SELECT 1 FROM known k WHERE k.kind = won.kind AND k.category = won.category) AS ex FROM won) w) z WHERE why IS NOT NULL""")
def known_category_rejects(spark, sf_dir):
    t = A.Tables(spark, sf_dir)
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    ch = t.customer.select(
        key.alias("seq"), F.when(key % 3 == 0, "remove").when(key % 3 == 1, "add").otherwise("keep").alias("op"),
        F.when(key % 7 != 0, F.when(key % 5 == 0, "tertiary").otherwise("primary")).alias("kind"),
        F.when(nation < 5, F.col("c_mktsegment")).when(nation < 20, F.col("c_name")).alias("category"))
    _, bad = M.change_known_categories(A.known_categories(t), ch)
    return bad


@register("retire_rejects", f"""
WITH {Q.LEDGER}, {Q.summaries_long()}, {KNOWN_SQL},
tot AS (SELECT kind, category, SUM({money('amount')}) AS total FROM summary
        WHERE category IS NOT NULL AND category <> '' AND category <> 'Total' GROUP BY kind, category),
req AS (SELECT kind, category FROM known UNION SELECT kind, category FROM tot)
SELECT r.kind, r.category, 'category still has expenses' AS reason FROM req r JOIN tot t USING (kind, category)
WHERE round_even(t.total, 2) <> 0""")
def retire_rejects(spark, sf_dir):
    t = A.Tables(spark, sf_dir)
    summary = S.summaries_long(A.ledger(t))
    totals = S.category_totals(summary)
    known = A.known_categories(t)
    requests = known.unionByName(totals.select("kind", "category")).distinct()
    _, _, bad = M.retire_categories(known, summary, totals, requests)
    return bad


@register("sub_cent_amounts", """
WITH l AS (SELECT upper(substr(event_type, 1, 1)) || substr(event_type, 2) AS category, CAST(year(ts) AS INTEGER) AS year,
                  CAST(month(ts) AS INTEGER) AS month, 4 AS thousandths FROM events)
SELECT category, year, month, CAST(SUM(thousandths) AS DOUBLE) / 1000.0 AS amount FROM l GROUP BY category, year, month""")
def sub_cent_amounts(spark, sf_dir):
    """A1: amounts below a cent add up exactly; they are never rounded one by one."""
    e, d = A.Tables(spark, sf_dir).events, F.col("ts").cast("date")
    led = e.select(normalize_category("event_type").alias("primary_category"), F.lit(0.004).alias("expense_in_ref_currency"),
                   F.year(d).alias("year"), F.month(d).alias("month"))
    return S.month_spend(led, "primary", alias="amount").withColumnRenamed("primary_category", "category")
