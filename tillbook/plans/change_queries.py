"""Registered queries: change batches (J1, J5, J8, M1-M16) and reshaping.

Every batch is derived from the driver tables, so its size grows with them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tillbook.domains import INCOME_CATEGORIES, INVESTMENT_CATEGORIES
from tillbook.functions.scalars import normalize_category
from tillbook.operators import changes as M
from tillbook.operators import summaries as S
from tillbook.plans import sql_parts as Q
from tillbook.plans.registry import register
from tillbook.sources import adapters as A

f1, f3, money = Q.f1, Q.f3, Q.money


def _ym(ts):
    d = F.col(ts).cast("date")
    return [F.year(d).alias("year"), F.month(d).alias("month"), F.dayofmonth(d).alias("expense_day")]


# ---- J1 / M1 ---------------------------------------------------------------

def expense_batch(t):
    """Raw expense changes: line items named by part (upper-cased, mapped) and
    orders named by customer (never mapped)."""
    li = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    a = li.select(F.col("l_orderkey").alias("seq"), F.upper("p_name").alias("expense_name"),
                  *_ym("l_shipdate"), F.col("l_extendedprice").alias("expense_amount"),
                  F.lit(None).cast("string").alias("currency"),
                  F.when(F.col("l_returnflag") == "R", F.lit("returns")).alias("primary_category"),
                  F.when(F.col("l_linestatus") == "F", F.lit("closed")).alias("secondary_category"))
    oc = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    b = oc.select(F.col("o_orderkey").alias("seq"), F.col("c_name").alias("expense_name"),
                  *_ym("o_orderdate"), F.col("o_totalprice").alias("expense_amount"),
                  F.lit(None).cast("string").alias("currency"),
                  F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("primary_category"),
                  F.lit(None).cast("string").alias("secondary_category"))
    return a.unionByName(b)


MAPPINGS_SQL = f"""mp AS (SELECT {f3('p_name')} AS name_key, lower(trim(min(p_type))) AS mp,
                         lower(trim(min(p_brand))) AS ms FROM part GROUP BY {f3('p_name')})"""

BATCH_SQL = """batch AS (
  SELECT l.l_orderkey AS seq, upper(p.p_name) AS expense_name, CAST(year(l_shipdate) AS INTEGER) AS y,
         CAST(month(l_shipdate) AS INTEGER) AS m, CAST(day(l_shipdate) AS INTEGER) AS d,
         l_extendedprice AS expense_amount, CAST(NULL AS VARCHAR) AS currency,
         CASE WHEN l_returnflag = 'R' THEN 'returns' END AS primary_category,
         CASE WHEN l_linestatus = 'F' THEN 'closed' END AS secondary_category
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
  UNION ALL
  SELECT o_orderkey, c_name, CAST(year(o_orderdate) AS INTEGER), CAST(month(o_orderdate) AS INTEGER),
         CAST(day(o_orderdate) AS INTEGER), o_totalprice, NULL,
         CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END, NULL
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def enrich_sql(batch: str = "batch") -> str:
    return f"""ej AS (SELECT b.*, mp.name_key IS NOT NULL AS hit, mp.mp, mp.ms
        FROM {batch} b LEFT JOIN mp ON {f3('b.expense_name')} = mp.name_key),
er AS (SELECT *, CASE WHEN primary_category IS NOT NULL THEN primary_category WHEN hit THEN mp END AS pri,
              CASE WHEN secondary_category IS NOT NULL THEN secondary_category WHEN hit THEN ms ELSE '' END
              AS sec, TRY_CAST(printf('%04d-%02d-%02d', y, m, d) AS DATE) AS dt FROM ej),
enriched AS (SELECT seq, expense_name, dt AS expense_date, expense_amount,
       COALESCE(currency, 'E') AS currency, expense_amount AS expense_in_ref_currency,
       {f1('pri')} AS primary_category, {f1('sec')} AS secondary_category,
       CAST(year(dt) AS INTEGER) AS year, CAST(month(dt) AS INTEGER) AS month
       FROM er WHERE pri IS NOT NULL AND dt IS NOT NULL),
erejects AS (SELECT seq, expense_name, y AS year, m AS month, d AS expense_day, expense_amount, currency,
       primary_category, secondary_category,
       CASE WHEN pri IS NULL THEN 'no mapping and no primary_category' ELSE 'invalid date' END AS reason
       FROM er WHERE pri IS NULL OR dt IS NULL)"""


@register("mapping_enrichment", f"""
WITH {MAPPINGS_SQL}, {BATCH_SQL}, {enrich_sql()}
SELECT * FROM enriched""")
def mapping_enrichment(spark, sf_dir):
    t = A.Tables(spark, sf_dir)
    ok, _ = M.enrich_expenses(expense_batch(t), A.mappings(t))
    return ok


@register("mapping_rejects", f"""
WITH {MAPPINGS_SQL}, {BATCH_SQL}, {enrich_sql()}
SELECT * FROM erejects""")
def mapping_rejects(spark, sf_dir):
    t = A.Tables(spark, sf_dir)
    _, bad = M.enrich_expenses(expense_batch(t), A.mappings(t))
    return bad


def event_batch(t):
    e = t.events
    return e.select(F.col("event_id").alias("seq"), F.col("event_type").alias("expense_name"),
                    *_ym("ts"), F.col("value").alias("expense_amount"),
                    F.lit(None).cast("string").alias("currency"),
                    F.when(F.col("event_type").isin("purchase", "click"), F.col("event_type"))
                    .alias("primary_category"),
                    F.lit(None).cast("string").alias("secondary_category"))


EVENT_BATCH_SQL = """ebatch AS (
  SELECT event_id AS seq, event_type AS expense_name, CAST(year(ts) AS INTEGER) AS y,
         CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d, value AS expense_amount,
         CAST(NULL AS VARCHAR) AS currency,
         CASE WHEN event_type IN ('purchase', 'click') THEN event_type END AS primary_category,
         CAST(NULL AS VARCHAR) AS secondary_category FROM events)"""


@register("append_expenses", f"""
WITH {Q.LEDGER_IDS}, {MAPPINGS_SQL}, {EVENT_BATCH_SQL}, {enrich_sql('ebatch')}
SELECT * FROM ledger_ids
UNION ALL
SELECT (SELECT COALESCE(max(expense_id) + 1, 0) FROM ledger_ids) + seq AS expense_id, expense_name,
       expense_date, expense_amount, currency, expense_in_ref_currency, primary_category,
       secondary_category, year, month FROM enriched""")
def append_expenses(spark, sf_dir):
    t = A.Tables(spark, sf_dir)
    out, _ = M.append_expenses(A.ledger_with_ids(t), event_batch(t), A.mappings(t))
    return out


@register("delete_expenses", f"""
WITH {Q.LEDGER_IDS}
SELECT * FROM ledger_ids l WHERE NOT EXISTS (
  SELECT 1 FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE c_acctbal < 0 AND o_orderkey = l.expense_id)""")
def delete_expenses(spark, sf_dir):
    t = A.Tables(spark, sf_dir)
    ids = (t.orders.join(t.customer.where(F.col("c_acctbal") < 0), F.col("o_custkey") == F.col("c_custkey"),
                         "left_semi").select(F.col("o_orderkey").alias("expense_id")))
    return M.delete_expenses(A.ledger_with_ids(t), ids)


def edit_batch(t):
    amounts = (t.lineitem.groupBy("l_orderkey")
               .agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("amt")))
    j = (amounts.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
         .join(t.customer, F.col("o_custkey") == F.col("c_custkey")))
    return j.select(F.col("l_orderkey").alias("expense_id"), F.lit(1).alias("seq"),
                    F.lit(None).cast("string").alias("expense_name"),
                    F.lit("30").alias("expense_date"), F.col("amt").alias("expense_amount"),
                    F.lit(None).cast("string").alias("currency"),
                    F.col("c_mktsegment").alias("primary_category"),
                    F.lower("o_orderstatus").alias("secondary_category"))


@register("edit_expenses", f"""
WITH {Q.LEDGER_IDS},
e AS (SELECT l_orderkey AS expense_id, CAST(SUM({money('l_extendedprice')}) AS DOUBLE) AS amt
      FROM lineitem GROUP BY l_orderkey),
e2 AS (SELECT e.expense_id, e.amt, c.c_mktsegment AS pri, lower(o.o_orderstatus) AS sec
       FROM e JOIN orders o ON o.o_orderkey = e.expense_id JOIN customer c ON c.c_custkey = o.o_custkey),
lk1 AS (SELECT year, month, lower(primary_category) AS k, min(primary_category) AS sp FROM ledger_ids
        WHERE primary_category IS NOT NULL AND primary_category <> '' GROUP BY year, month, lower(primary_category)),
lk2 AS (SELECT year, month, lower(secondary_category) AS k, min(secondary_category) AS sp FROM ledger_ids
        WHERE secondary_category IS NOT NULL AND secondary_category <> ''
        GROUP BY year, month, lower(secondary_category)),
j AS (SELECT l.*, e2.amt, e2.pri, e2.sec,
             e2.expense_id IS NOT NULL AND TRY_CAST(printf('%04d-%02d-%02d', l.year, l.month, 30) AS DATE) IS NOT NULL
             AS ap,
             TRY_CAST(printf('%04d-%02d-%02d', l.year, l.month, 30) AS DATE) AS nd
      FROM ledger_ids l LEFT JOIN e2 ON e2.expense_id = l.expense_id),
j2 AS (SELECT j.*,
         CASE WHEN pri IS NULL OR pri = '' THEN pri ELSE COALESCE(lk1.sp, {f1('pri')}) END AS rpri,
         CASE WHEN sec IS NULL OR sec = '' THEN sec ELSE COALESCE(lk2.sp, {f1('sec')}) END AS rsec
       FROM j LEFT JOIN lk1 ON lk1.year = j.year AND lk1.month = j.month AND lk1.k = lower(j.pri)
       LEFT JOIN lk2 ON lk2.year = j.year AND lk2.month = j.month AND lk2.k = lower(j.sec)),
j3 AS (SELECT expense_id, expense_name, CASE WHEN ap THEN nd ELSE expense_date END AS expense_date,
         CASE WHEN ap AND amt IS NOT NULL THEN amt ELSE expense_amount END AS expense_amount, currency,
         CASE WHEN ap AND amt IS NOT NULL THEN amt ELSE expense_in_ref_currency END AS expense_in_ref_currency,
         CASE WHEN ap AND rpri IS NOT NULL THEN rpri ELSE primary_category END AS primary_category,
         CASE WHEN ap AND rsec IS NOT NULL THEN rsec ELSE secondary_category END AS secondary_category
       FROM j2)
SELECT *, CAST(year(expense_date) AS INTEGER) AS year, CAST(month(expense_date) AS INTEGER) AS month FROM j3""")
def edit_expenses(spark, sf_dir):
    t = A.Tables(spark, sf_dir)
    out, _ = M.edit_expenses(A.ledger_with_ids(t), edit_batch(t))
    return out


# ---- M4, M10 ---------------------------------------------------------------

@register("set_income", f"""
WITH {Q.INCOME},
ch AS (SELECT o_orderkey AS seq, CAST(year(o_orderdate) AS INTEGER) AS year,
              CAST(month(o_orderdate) AS INTEGER) AS month,
              CASE o_orderstatus WHEN 'F' THEN 'Salary' WHEN 'O' THEN 'Other' ELSE 'Pension' END AS category,
              o_totalprice AS value FROM orders),
last AS (SELECT year, month, category, arg_max(value, seq) AS value FROM ch
         WHERE category IN ({', '.join(Q.q(c) for c in INCOME_CATEGORIES)}) AND month BETWEEN 1 AND 12
         GROUP BY year, month, category)
SELECT COALESCE(i.category, l.category) AS category, COALESCE(i.year, l.year) AS year,
       COALESCE(i.month, l.month) AS month, CASE WHEN l.category IS NOT NULL THEN l.value ELSE i.value END AS value
FROM income_f i FULL JOIN last l ON i.category = l.category AND i.year = l.year AND i.month = l.month""")
def set_income(spark, sf_dir):
    t = A.Tables(spark, sf_dir)
    d = F.col("o_orderdate").cast("date")
    ch = t.orders.select(
        F.col("o_orderkey").alias("seq"), F.year(d).alias("year"), F.month(d).alias("month"),
        F.when(F.col("o_orderstatus") == "F", "Salary").when(F.col("o_orderstatus") == "O", "Other")
        .otherwise("Pension").alias("category"), F.col("o_totalprice").alias("value"))
    out, _ = M.set_income(A.income(t), ch)
    return out


@register("set_positions", f"""
WITH {Q.BALANCES},
ch AS (SELECT o_orderkey AS seq, c_name AS asset_name, CAST(year(o_orderdate) AS INTEGER) AS year,
              CAST(month(o_orderdate) AS INTEGER) AS month, o_totalprice AS value
       FROM orders JOIN customer ON o_custkey = c_custkey),
ok AS (SELECT ch.* FROM ch WHERE EXISTS (SELECT 1 FROM liq_f f WHERE f.year = ch.year
       AND f.asset_name = ch.asset_name) AND month BETWEEN 1 AND 12),
last AS (SELECT year, month, asset_name, arg_max(value, seq) AS value FROM ok GROUP BY year, month, asset_name),
dims AS (SELECT year, asset_name, first(category) AS category, first(currency) AS currency
         FROM liq_f GROUP BY year, asset_name),
ins AS (SELECT l.*, d.category, d.currency FROM last l LEFT JOIN dims d ON d.year = l.year
        AND d.asset_name = l.asset_name)
SELECT COALESCE(f.asset_name, i.asset_name) AS asset_name, COALESCE(f.category, i.category) AS category,
       COALESCE(f.currency, i.currency) AS currency, COALESCE(f.year, i.year) AS year,
       COALESCE(f.month, i.month) AS month,
       CASE WHEN i.asset_name IS NOT NULL THEN i.value ELSE f.value END AS value
FROM liq_f f FULL JOIN ins i ON f.year = i.year AND f.month = i.month AND f.asset_name = i.asset_name""")
def set_positions(spark, sf_dir):
    t = A.Tables(spark, sf_dir)
    d = F.col("o_orderdate").cast("date")
    ch = (t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
          .select(F.col("o_orderkey").alias("seq"), F.col("c_name").alias("asset_name"),
                  F.year(d).alias("year"), F.month(d).alias("month"), F.col("o_totalprice").alias("value")))
    out, _ = M.set_values(A.liquidity(t), ch, "asset_name", "value")
    return out


# ---- M5-M9 on holdings -------------------------------------------------------

def _part_years(t):
    d = F.col("l_shipdate").cast("date")
    py = t.lineitem.select("l_partkey", F.year(d).alias("year")).distinct()
    return py.join(t.part, F.col("l_partkey") == F.col("p_partkey"))


PART_YEARS_SQL = """py AS (SELECT DISTINCT l_partkey, CAST(year(l_shipdate) AS INTEGER) AS year FROM lineitem),
pyp AS (SELECT * FROM py JOIN part ON l_partkey = p_partkey)"""


@register("rename_assets", f"""
WITH {Q.HOLDINGS}, {PART_YEARS_SQL},
rn AS (SELECT l_partkey AS seq, year, 'Part#' || CAST(l_partkey AS VARCHAR) AS old_name,
              p_name || ' (' || p_brand || ')' AS new_name FROM pyp),
names AS (SELECT DISTINCT year, asset_name FROM hold),
v AS (SELECT rn.* FROM rn
      WHERE EXISTS (SELECT 1 FROM names n WHERE n.year = rn.year AND n.asset_name = rn.old_name)
        AND NOT (new_name <> old_name AND
                 EXISTS (SELECT 1 FROM names n WHERE n.year = rn.year AND n.asset_name = rn.new_name))),
a1 AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY year, old_name ORDER BY seq) = 1),
a2 AS (SELECT * FROM a1 QUALIFY row_number() OVER (PARTITION BY year, new_name ORDER BY seq) = 1)
SELECT COALESCE(a2.new_name, h.asset_name) AS asset_name, h.category, h.link, h.year, h.month, h.quantity
FROM hold h LEFT JOIN a2 ON a2.year = h.year AND a2.old_name = h.asset_name""")
def rename_assets(spark, sf_dir):
    t = A.Tables(spark, sf_dir)
    rn = _part_years(t).select(
        F.col("l_partkey").alias("seq"), "year", A.asset_name_of_part("l_partkey").alias("old_name"),
        F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")).alias("new_name"))
    h = A.holdings(t)
    ok, _ = M.rename_entities(h, rn, "asset_name")
    return M.apply_renames(h, ok, "asset_name")


CATEGORY_OF_TYPE = {"STANDARD": "Stocks/ETF", "ECONOMY": "Bonds", "PROMO": "Commodities"}


@register("set_asset_category", f"""
WITH {Q.HOLDINGS}, {PART_YEARS_SQL},
ch AS (SELECT l_partkey AS seq, year, 'Part#' || CAST(l_partkey AS VARCHAR) AS asset_name,
              CASE p_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in CATEGORY_OF_TYPE.items())}
              ELSE {f1('p_type')} END AS category FROM pyp),
ok AS (SELECT * FROM ch WHERE category IN ({', '.join(Q.q(c) for c in INVESTMENT_CATEGORIES)})
       AND EXISTS (SELECT 1 FROM hold h WHERE h.year = ch.year AND h.asset_name = ch.asset_name)),
last AS (SELECT year, asset_name, arg_max(category, seq) AS category FROM ok GROUP BY year, asset_name)
SELECT h.asset_name, COALESCE(l.category, h.category) AS category, h.link, h.year, h.month, h.quantity
FROM hold h LEFT JOIN last l ON l.year = h.year AND l.asset_name = h.asset_name""")
def set_asset_category(spark, sf_dir):
    t = A.Tables(spark, sf_dir)
    cat = F.col("p_type")
    expr = normalize_category(cat)
    for k, v in reversed(CATEGORY_OF_TYPE.items()):
        expr = F.when(cat == k, F.lit(v)).otherwise(expr)
    ch = _part_years(t).select(F.col("l_partkey").alias("seq"), "year",
                               A.asset_name_of_part("l_partkey").alias("asset_name"), expr.alias("category"))
    out, _ = M.set_attribute(A.holdings(t), ch, "asset_name", "category", valid=INVESTMENT_CATEGORIES)
    return out


@register("set_link", f"""
WITH {Q.HOLDINGS}, {PART_YEARS_SQL},
ch AS (SELECT l_partkey AS seq, year, 'Part#' || CAST(l_partkey AS VARCHAR) AS asset_name,
              lower(p_brand) AS link FROM pyp),
ok AS (SELECT * FROM ch WHERE EXISTS (SELECT 1 FROM hold h WHERE h.year = ch.year AND h.asset_name = ch.asset_name)),
last AS (SELECT year, asset_name, arg_max(link, seq) AS link FROM ok GROUP BY year, asset_name)
SELECT h.asset_name, h.category, COALESCE(l.link, h.link) AS link, h.year, h.month, h.quantity
FROM hold h LEFT JOIN last l ON l.year = h.year AND l.asset_name = h.asset_name""")
def set_link(spark, sf_dir):
    t = A.Tables(spark, sf_dir)
    ch = _part_years(t).select(F.col("l_partkey").alias("seq"), "year",
                               A.asset_name_of_part("l_partkey").alias("asset_name"),
                               F.lower("p_brand").alias("link"))
    out, _ = M.set_attribute(A.holdings(t), ch, "asset_name", "link")
    return out


@register("add_assets", f"""
WITH {Q.HOLDINGS}, {PART_YEARS_SQL},
sy AS (SELECT DISTINCT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS year FROM lineitem),
adds AS (SELECT s_suppkey AS seq, sy.year, s_name AS asset_name,
                CASE WHEN s_acctbal > 5000 THEN 'Stocks/ETF' WHEN s_acctbal > 0 THEN 'Bonds' ELSE 'Crypto' END
                AS category, '' AS link
         FROM sy JOIN supplier ON l_suppkey = s_suppkey
         UNION ALL
         SELECT l_partkey, year, 'Part#' || CAST(l_partkey AS VARCHAR), 'Bonds', '' FROM pyp),
ok AS (SELECT * FROM adds WHERE category IN ({', '.join(Q.q(c) for c in INVESTMENT_CATEGORIES)})
       AND NOT EXISTS (SELECT 1 FROM hold h WHERE h.year = adds.year AND h.asset_name = adds.asset_name)),
first AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY year, asset_name ORDER BY seq) = 1)
SELECT asset_name, category, link, year, CAST(m AS INTEGER) AS month, CAST(0.0 AS DOUBLE) AS quantity
FROM first, range(1, 13) t(m)""")
def add_assets(spark, sf_dir):
    t = A.Tables(spark, sf_dir)
    d = F.col("l_shipdate").cast("date")
    sy = t.lineitem.select("l_suppkey", F.year(d).alias("year")).distinct()
    bal = F.col("s_acctbal")
    a = (sy.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
         .select(F.col("s_suppkey").alias("seq"), "year", F.col("s_name").alias("asset_name"),
                 F.when(bal > 5000, "Stocks/ETF").when(bal > 0, "Bonds").otherwise("Crypto").alias("category"),
                 F.lit("").alias("link")))
    b = _part_years(t).select(F.col("l_partkey").alias("seq"), "year",
                              A.asset_name_of_part("l_partkey").alias("asset_name"),
                              F.lit("Bonds").alias("category"), F.lit("").alias("link"))
    _, added, _ = M.add_entities(A.holdings(t), a.unionByName(b), "asset_name", "quantity",
                                 valid=INVESTMENT_CATEGORIES)
    return added


@register("remove_assets", f"""
WITH {Q.HOLDINGS}, {PART_YEARS_SQL}
SELECT * FROM hold h WHERE NOT EXISTS (
  SELECT 1 FROM pyp WHERE p_size < 10 AND pyp.year = h.year
  AND 'Part#' || CAST(pyp.l_partkey AS VARCHAR) = h.asset_name)""")
def remove_assets(spark, sf_dir):
    t = A.Tables(spark, sf_dir)
    rm = (_part_years(t).where(F.col("p_size") < 10)
          .select("year", A.asset_name_of_part("l_partkey").alias("asset_name")))
    return M.remove_entities(A.holdings(t), rm, "asset_name")


# ---- M11-M13 ------------------------------------------------------------------

TEMPLATES_SQL = f"""tpl AS (SELECT p_partkey AS template_id, p_name AS expense_name,
  CAST(p_partkey % 28 + 1 AS BIGINT) AS expense_day, p_retailprice AS expense_amount, 'E' AS currency,
  {f1('p_type')} AS primary_category, {f1('p_brand')} AS secondary_category FROM part)"""


def supplier_templates(t):
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(F.col("s_suppkey").alias("seq"), F.col("s_name").alias("expense_name"),
                    (F.col("s_nationkey") + 5).cast("long").alias("expense_day"),
                    F.col("s_acctbal").alias("expense_amount"), F.lit("E").alias("currency"),
                    F.lit("SUPPLIES").alias("primary_category"), F.col("n_name").alias("secondary_category"))


@register("add_recurring", f"""
WITH {TEMPLATES_SQL},
adds AS (SELECT s_suppkey AS seq, s_name AS expense_name, CAST(s_nationkey + 5 AS BIGINT) AS expense_day,
                s_acctbal AS expense_amount, 'E' AS currency, 'SUPPLIES' AS primary_category,
                n_name AS secondary_category
         FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT * FROM tpl
UNION ALL
SELECT (SELECT COALESCE(max(template_id) + 1, 0) FROM tpl) + seq, expense_name, expense_day, expense_amount,
       currency, {f1('primary_category')}, {f1('secondary_category')}
FROM adds WHERE expense_day BETWEEN 1 AND 28""")
def add_recurring(spark, sf_dir):
    t = A.Tables(spark, sf_dir)
    out, _ = M.add_recurring(A.recurring(t), supplier_templates(t))
    return out


@register("remove_recurring", f"""
WITH {TEMPLATES_SQL}
SELECT * FROM tpl WHERE template_id NOT IN (
  SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45)""")
def remove_recurring(spark, sf_dir):
    t = A.Tables(spark, sf_dir)
    # Parts returned from a bulk order (45 units or more) stop recurring.
    ids = (t.lineitem.where((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 45))
           .select(F.col("l_partkey").alias("template_id")))
    return M.remove_recurring(A.recurring(t), ids)


@register("apply_recurring", f"""
WITH {Q.LEDGER},
tpl AS (SELECT DISTINCT l.l_suppkey AS ledger_id, p.p_partkey AS template_id, p.p_name AS expense_name,
               CAST(p.p_partkey % 28 + 1 AS BIGINT) AS expense_day, p.p_retailprice AS expense_amount,
               'E' AS currency, {f1('p.p_type')} AS primary_category, {f1('p.p_brand')} AS secondary_category
        FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
firsts AS (SELECT * FROM tpl QUALIFY row_number() OVER (PARTITION BY ledger_id, expense_name, expense_day
                                                        ORDER BY template_id) = 1),
tgt AS (SELECT ledger_id, max(year * 100 + month) AS ym FROM ledger GROUP BY ledger_id),
cand AS (SELECT f.*, CAST(t.ym // 100 AS INTEGER) AS year, CAST(t.ym % 100 AS INTEGER) AS month
         FROM firsts f JOIN tgt t ON f.ledger_id = t.ledger_id)
SELECT ledger_id, template_id, expense_name, make_date(year, month, CAST(expense_day AS INTEGER)) AS expense_date,
       expense_amount, currency, expense_amount AS expense_in_ref_currency,
       {f1('primary_category')} AS primary_category, {f1('secondary_category')} AS secondary_category, year, month
FROM cand c WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.ledger_id = c.ledger_id AND l.year = c.year
  AND l.month = c.month AND l.expense_name = c.expense_name AND day(l.expense_date) = c.expense_day)""")
def apply_recurring(spark, sf_dir):
    t = A.Tables(spark, sf_dir)
    led = A.ledger(t, with_ledger_id=True)
    pairs = t.lineitem.select(F.col("l_suppkey").alias("ledger_id"), "l_partkey").distinct()
    tpl = pairs.join(A.recurring(t), F.col("l_partkey") == F.col("template_id")).drop("l_partkey")
    targets = led.select("ledger_id", "year", "month")
    return M.apply_recurring(led, tpl, targets, by=["ledger_id"])


# ---- M14-M16 ---------------------------------------------------------------------

def mapping_changes(t):
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    adds_new = c.select(F.col("c_custkey").alias("seq"), F.lit("add").alias("op"),
                        F.col("c_name").alias("expense_name"), F.col("c_mktsegment").alias("primary_category"),
                        F.col("n_name").alias("secondary_category"), F.lit(False).alias("overwrite"))
    adds_old = t.part.select(F.col("p_partkey").alias("seq"), F.lit("add").alias("op"),
                             F.col("p_name").alias("expense_name"), F.col("p_type").alias("primary_category"),
                             F.col("p_brand").alias("secondary_category"), F.lit(True).alias("overwrite"))
    removes = t.nation.select(F.col("n_nationkey").cast("long").alias("seq"), F.lit("remove").alias("op"),
                              F.col("n_name").alias("expense_name"),
                              F.lit(None).cast("string").alias("primary_category"),
                              F.lit(None).cast("string").alias("secondary_category"),
                              F.lit(False).alias("overwrite"))
    return adds_new.unionByName(adds_old).unionByName(removes)


@register("upsert_mappings", f"""
WITH {MAPPINGS_SQL},
ch AS (SELECT c_custkey AS seq, 'add' AS op, c_name AS expense_name, c_mktsegment AS primary_category,
              n_name AS secondary_category, false AS overwrite
       FROM customer JOIN nation ON c_nationkey = n_nationkey
       UNION ALL SELECT p_partkey, 'add', p_name, p_type, p_brand, true FROM part
       UNION ALL SELECT n_nationkey, 'remove', n_name, NULL, NULL, false FROM nation),
chk AS (SELECT *, {f3('expense_name')} AS name_key FROM ch),
firsts AS (SELECT * FROM chk QUALIFY row_number() OVER (PARTITION BY name_key ORDER BY seq) = 1),
m AS (SELECT f.*, EXISTS (SELECT 1 FROM mp WHERE mp.name_key = f.name_key) AS ex FROM firsts f),
ok AS (SELECT * FROM m WHERE NOT ((op = 'add' AND ex AND NOT COALESCE(overwrite, false))
                                  OR (op = 'remove' AND NOT ex)))
SELECT name_key, mp AS primary_category, ms AS secondary_category FROM mp
WHERE name_key NOT IN (SELECT name_key FROM ok)
UNION ALL
SELECT name_key, lower(trim(COALESCE(primary_category, ''))), lower(trim(COALESCE(secondary_category, '')))
FROM ok WHERE op = 'add'""")
def upsert_mappings(spark, sf_dir):
    t = A.Tables(spark, sf_dir)
    out, _ = M.change_mappings(A.mappings(t), mapping_changes(t))
    return out


def known_changes(t):
    a = t.customer.select(F.col("c_custkey").alias("seq"), F.lit("add").alias("op"),
                          F.lit("primary").alias("kind"), normalize_category("c_mktsegment").alias("category"))
    b = t.nation.select((F.col("n_nationkey") + 1000000).cast("long").alias("seq"), F.lit("add").alias("op"),
                        F.lit("secondary").alias("kind"), F.col("n_name").alias("category"))
    c = t.customer.select((F.col("c_custkey") + 2000000).alias("seq"), F.lit("remove").alias("op"),
                          F.lit("primary").alias("kind"), F.col("c_mktsegment").alias("category"))
    d = t.region.select((F.col("r_regionkey") + 3000000).cast("long").alias("seq"), F.lit("remove").alias("op"),
                        F.lit("secondary").alias("kind"), F.col("r_name").alias("category"))
    return a.unionByName(b).unionByName(c).unionByName(d)


KNOWN_SQL = Q.KNOWN


@register("known_categories", f"""
WITH {KNOWN_SQL},
ch AS (SELECT c_custkey AS seq, 'add' AS op, 'primary' AS kind, {f1('c_mktsegment')} AS category FROM customer
       UNION ALL SELECT n_nationkey + 1000000, 'add', 'secondary', n_name FROM nation
       UNION ALL SELECT c_custkey + 2000000, 'remove', 'primary', c_mktsegment FROM customer
       UNION ALL SELECT r_regionkey + 3000000, 'remove', 'secondary', r_name FROM region),
firsts AS (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY kind, category ORDER BY seq) = 1),
m AS (SELECT f.*, EXISTS (SELECT 1 FROM known k WHERE k.kind = f.kind AND k.category = f.category) AS ex
      FROM firsts f),
ok AS (SELECT * FROM m WHERE NOT ((op = 'add' AND ex) OR (op = 'remove' AND NOT ex)))
SELECT kind, category FROM known k WHERE NOT EXISTS (
  SELECT 1 FROM ok WHERE ok.op = 'remove' AND ok.kind = k.kind AND ok.category = k.category)
UNION ALL SELECT kind, category FROM ok WHERE op = 'add'""")
def known_categories(spark, sf_dir):
    t = A.Tables(spark, sf_dir)
    out, _ = M.change_known_categories(A.known_categories(t), known_changes(t))
    return out


@register("retire_category", f"""
WITH {Q.LEDGER}, {Q.summaries_long()}, {KNOWN_SQL},
tot AS (SELECT kind, category, SUM({money('amount')}) AS total FROM summary
        WHERE category IS NOT NULL AND category <> '' AND category <> 'Total' GROUP BY kind, category),
req AS (SELECT kind, category FROM known UNION SELECT kind, category FROM tot),
ok AS (SELECT r.* FROM req r LEFT JOIN tot t ON t.kind = r.kind AND t.category = r.category
       WHERE COALESCE(round_even(t.total, 2), 0) = 0)
SELECT kind, category FROM known k WHERE NOT EXISTS (
  SELECT 1 FROM ok WHERE ok.kind = k.kind AND ok.category = k.category)""")
def retire_category(spark, sf_dir):
    t = A.Tables(spark, sf_dir)
    summary = S.summaries_long(A.ledger(t))
    totals = S.category_totals(summary)
    known = A.known_categories(t)
    requests = known.unionByName(totals.select("kind", "category")).distinct()
    known2, _, _ = M.retire_categories(known, summary, totals, requests)
    return known2


# ---- R2, R3 ----------------------------------------------------------------------

@register("wide_to_long", f"""
WITH {Q.BALANCES},
keys AS (SELECT DISTINCT asset_name, category, currency, year FROM liq_f)
SELECT k.asset_name, k.category, k.currency, k.year, CAST(m AS INTEGER) AS month, f.value
FROM keys k CROSS JOIN range(1, 13) t(m)
LEFT JOIN liq_f f ON f.asset_name = k.asset_name AND f.year = k.year AND f.month = t.m""")
def wide_to_long(spark, sf_dir):
    t = A.Tables(spark, sf_dir)
    ids = ["asset_name", "category", "currency", "year"]
    wide = S.to_wide(A.liquidity(t), ids, value="value")
    return S.to_long(wide, ids, value="value")


@register("dense_month_grid", f"""
WITH {Q.BALANCES},
keys AS (SELECT DISTINCT name, currency, year FROM cd_f)
SELECT k.name, k.currency, k.year, CAST(m AS INTEGER) AS month, COALESCE(f.value, 0.0) AS value
FROM keys k CROSS JOIN range(1, 13) t(m)
LEFT JOIN cd_f f ON f.name = k.name AND f.year = k.year AND f.month = t.m""")
def dense_month_grid(spark, sf_dir):
    t = A.Tables(spark, sf_dir)
    return S.dense_month_grid(A.credits(t), ["name", "currency"], value="value")


@register("rename_positions", f"""
WITH {Q.HOLDINGS}, {PART_YEARS_SQL},
rn AS (SELECT l_partkey AS seq, year, 'Part#' || CAST(l_partkey AS VARCHAR) AS old_name,
              p_name || ' (' || p_brand || ')' AS new_name FROM pyp),
names AS (SELECT DISTINCT year, asset_name FROM hold),
v AS (SELECT rn.* FROM rn
      WHERE EXISTS (SELECT 1 FROM names n WHERE n.year = rn.year AND n.asset_name = rn.old_name)
        AND NOT (new_name <> old_name AND
                 EXISTS (SELECT 1 FROM names n WHERE n.year = rn.year AND n.asset_name = rn.new_name))),
a1 AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY year, old_name ORDER BY seq) = 1),
a2 AS (SELECT * FROM a1 QUALIFY row_number() OVER (PARTITION BY year, new_name ORDER BY seq) = 1),
h2 AS (SELECT COALESCE(a2.new_name, h.asset_name) AS asset_name, h.category, h.link, h.year, h.month,
              h.quantity FROM hold h LEFT JOIN a2 ON a2.year = h.year AND a2.old_name = h.asset_name),
p2 AS (SELECT COALESCE(a2.new_name, f.asset_name) AS asset_name, f.year, f.month, f.price
       FROM prices_f f LEFT JOIN a2 ON a2.year = f.year AND a2.old_name = f.asset_name)
SELECT h2.*, p2.price,
       CAST(CAST({money('h2.quantity', 4)} * {money('p2.price', 4)} AS DECIMAL(38,4)) AS DOUBLE) AS value
FROM h2 LEFT JOIN p2 ON p2.asset_name = h2.asset_name AND p2.year = h2.year AND p2.month = h2.month""")
def rename_positions(spark, sf_dir):
    """M7 with J4: holdings and prices renamed together, then valued."""
    from tillbook.operators import networth as N
    t = A.Tables(spark, sf_dir)
    rn = _part_years(t).select(
        F.col("l_partkey").alias("seq"), "year", A.asset_name_of_part("l_partkey").alias("old_name"),
        F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")).alias("new_name"))
    h, p, _ = M.rename_holdings(*A.positions(t), rn)
    return N.position_value(h, p).drop("value_dec")
