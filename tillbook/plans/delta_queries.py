"""Registered queries: signed changes, snapshots and the change stream (M1-M3, M17, S6, T1), and inputs that earlier rows lack."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillbook.functions.scalars import mapping_key
from tillbook.operators import categories as C
from tillbook.operators import changes as M
from tillbook.operators import deltas as D
from tillbook.operators import filters as V
from tillbook.operators import maintenance as MT
from tillbook.operators import networth as N
from tillbook.operators import summaries as S
from tillbook.plans import sql_parts as Q
from tillbook.plans.change_queries import EVENT_BATCH_SQL, MAPPINGS_SQL, enrich_sql, event_batch
from tillbook.plans.io_queries import in_parts
from tillbook.plans.registry import register
from tillbook.plans.view_queries import VIEW_COLS
from tillbook.session import scratch_dir, stored
from tillbook.sources import adapters as A
from tillbook.sources import io as IO
from tillbook.streaming import change_stream as CS

# ---- signed changes ---------------------------------------------------------------

#: The order ledger after a batch: the first year's Februaries and some of its March go, its April doubles, mapped events come.
CHANGED_IDS = f"""{MAPPINGS_SQL}, {EVENT_BATCH_SQL}, {enrich_sql('ebatch')}, y AS (SELECT min(year) AS y0 FROM ledger_ids),
ledger2 AS (SELECT primary_category, secondary_category, year, month,
                   CASE WHEN year = y0 AND month = 4 THEN 2 * expense_in_ref_currency ELSE expense_in_ref_currency END AS expense_in_ref_currency
            FROM ledger_ids, y WHERE NOT (year = y0 AND (month = 2 OR (month = 3 AND primary_category LIKE '1%')))
            UNION ALL SELECT primary_category, secondary_category, year, month, expense_in_ref_currency FROM enriched)"""


def _order_changes(t):
    """(ledger, the batch's appends, edits and deletes) of the order ledger."""
    led = stored(A.ledger_with_ids(t), "orders-ledger")
    first = F.col("year") == led.select(F.min("year")).scalar()
    deletes = led.where(first & ((F.col("month") == 2) | ((F.col("month") == 3) & F.col("primary_category").like("1%")))).select("expense_id")
    none = F.lit(None).cast("string")
    edits = led.where(first & (F.col("month") == 4)).select(
        F.col("expense_id").alias("seq"), "expense_id", none.alias("expense_name"), none.alias("expense_date"),
        (2 * F.col("expense_amount")).alias("expense_amount"), none.alias("currency"), none.alias("primary_category"), none.alias("secondary_category"))
    return led, {"appends": event_batch(t), "edits": edits, "deletes": deletes}


@register("delta_maintenance", f"""
WITH {Q.LEDGER_IDS}, {CHANGED_IDS}, {Q.summaries_long('ledger2')}
SELECT kind, category, year, month, amount FROM summary
UNION ALL SELECT DISTINCT kind, category, year, 2 AS month, CAST(0.0 AS DOUBLE) AS amount FROM summary, y WHERE year = y0""")
def delta_maintenance(spark, sf_dir):
    """M17 from a batch: stored cells take the old-minus/new-plus cells of appends, edits and deletes; the ledger is not read for it."""
    t = A.Tables(spark, sf_dir)
    led, batch = _order_changes(t)
    table = D.counted_table(spark, scratch_dir(spark, "counted-cells"))
    D.build_cells(table, led)
    feed, _ = D.change_feed(led, A.mappings(t), **batch)
    D.maintain(table, stored(feed, "feed"), "one batch")
    return D.summary_of(table.read())


@register("change_feed_rows", f"""
WITH {Q.LEDGER_IDS}, {CHANGED_IDS},
signed AS (SELECT l.*, y0 FROM ledger_ids l, y),
f AS (SELECT -1 AS sign, year, month, expense_amount FROM signed WHERE year = y0 AND (month IN (2, 4) OR (month = 3 AND primary_category LIKE '1%'))
      UNION ALL SELECT 1, year, month, 2 * expense_amount FROM signed WHERE year = y0 AND month = 4
      UNION ALL SELECT 1, year, month, expense_amount FROM enriched)
SELECT sign, year, month, count(*) AS n_rows, CAST(SUM({Q.money('expense_amount')}) AS DOUBLE) AS amount FROM f GROUP BY sign, year, month""")
def change_feed_rows(spark, sf_dir):
    """The signed rows of the same batch, summed by month."""
    t = A.Tables(spark, sf_dir)
    led, batch = _order_changes(t)
    feed, _ = D.change_feed(led, A.mappings(t), **batch)
    return feed.groupBy("sign", "year", "month").agg(F.count("*").alias("n_rows"), F.sum(F.col("expense_amount").cast("decimal(18,2)")).cast("double").alias("amount"))


@register("change_feed_rejects", f"""
WITH {MAPPINGS_SQL}, {EVENT_BATCH_SQL}, {enrich_sql('ebatch')}
SELECT 'append' AS op, reason, count(*) AS n_rows FROM erejects GROUP BY reason""")
def change_feed_rejects(spark, sf_dir):
    t = A.Tables(spark, sf_dir)
    led, batch = _order_changes(t)
    _, rejects = D.change_feed(led, A.mappings(t), **batch)
    return rejects.groupBy("op", "reason").agg(F.count("*").alias("n_rows"))


@register("snapshot_versions", f"""
WITH {Q.LEDGER_IDS}, {CHANGED_IDS},
s AS (SELECT 1 AS version, year, month, {Q.money('expense_in_ref_currency')} AS amt FROM ledger_ids
      UNION ALL SELECT 2, year, month, {Q.money('expense_in_ref_currency')} FROM ledger2
      UNION ALL SELECT 2, y0, 2, 0 FROM y)
SELECT version, CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month, CAST(SUM(amt) AS DOUBLE) AS amount FROM s GROUP BY ALL""")
def snapshot_versions(spark, sf_dir):
    """Both versions of the stored cells can be read side by side after a change batch."""
    t = A.Tables(spark, sf_dir)
    led, batch = _order_changes(t)
    table = D.counted_table(spark, scratch_dir(spark, "snapshots"))
    D.build_cells(table, led)
    D.maintain(table, stored(D.change_feed(led, A.mappings(t), **batch)[0], "feed"), "one batch")
    both = [D.summary_of(table.read(version=v)).where("kind = 'primary' AND category = 'Total'").select(F.lit(v).alias("version"), "year", "month", "amount") for v in (1, 2)]
    return both[0].unionByName(both[1])


# ---- the change stream ---------------------------------------------------------------

def _arrivals(spark, rows, files=6):
    """A stream of part files over rows derived from the driver tables, a few files at a time."""
    folder = scratch_dir(spark, "arrivals")
    rows.repartition(files).write.parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files // 3).parquet(folder)


def _raw_events(t):
    e, d, none = t.events, F.col("ts").cast("date"), F.lit(None).cast("string")
    return e.select(F.concat(F.lit(" \t"), F.upper("event_type")).alias("expense_name"), F.year(d).alias("year"), F.month(d).alias("month"),
                    F.dayofmonth(d).alias("expense_day"), F.col("value").alias("expense_amount"), none.alias("currency"),
                    F.when(F.col("event_id") % 11 == 0, "by hand").alias("primary_category"), none.alias("secondary_category"), "event_id")


def _event_mappings(t):
    kinds = t.events.select("event_type").distinct().where("event_type != 'click'")
    return stored(kinds.select(mapping_key("event_type").alias("name_key"), F.col("event_type").alias("primary_category"),
                               F.concat("event_type", F.lit(" kind")).alias("secondary_category")), "event-mappings")


STREAMED = f"""raw AS (SELECT *, event_type <> 'click' AS hit, event_id % 11 = 0 AS filed FROM events),
sledger AS (SELECT CASE WHEN filed THEN 'By hand' ELSE {Q.f1('event_type')} END AS primary_category,
                   CASE WHEN hit THEN {Q.f1("event_type || ' kind'")} ELSE '' END AS secondary_category,
                   value AS expense_in_ref_currency, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, event_id
            FROM raw WHERE hit OR filed)"""


@register("stream_enriched", f"""
WITH {STREAMED}, {Q.summaries_long('sledger')}
SELECT kind, category, year, month, amount FROM summary""")
def stream_enriched(spark, sf_dir):
    """T1 with J1: events arrive without categories and take them from the mapping table; rows without any are refused."""
    t = A.Tables(spark, sf_dir)
    kept = CS.run_change_stream(_arrivals(spark, _raw_events(t).drop("event_id")), _event_mappings(t), scratch_dir(spark, "enriched"), compact_every=2)
    return D.summary_of(kept.cells.read(spark))


@register("stream_rejects", """
SELECT ' ' || chr(9) || upper(event_type) AS expense_name, 'no mapping and no primary_category' AS reason, count(*) AS n_rows,
       CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS amount
FROM events WHERE event_type = 'click' AND event_id % 11 <> 0 GROUP BY ALL""")
def stream_rejects(spark, sf_dir):
    """The rejects sink of the same stream."""
    t = A.Tables(spark, sf_dir)
    kept = CS.run_change_stream(_arrivals(spark, _raw_events(t).drop("event_id")), _event_mappings(t), scratch_dir(spark, "refused"))
    return kept.rejects(spark).groupBy("expense_name", "reason").agg(
        F.count("*").alias("n_rows"), F.sum(F.col("expense_amount").cast("decimal(18,2)")).cast("double").alias("amount"))


@register("stream_retraction", f"""
WITH {STREAMED},
left_over AS (SELECT * REPLACE (CASE WHEN event_id % 7 = 3 THEN 2 * expense_in_ref_currency ELSE expense_in_ref_currency END AS expense_in_ref_currency)
              FROM sledger WHERE event_id % 5 <> 0), {Q.summaries_long('left_over')}
SELECT kind, category, year, month, amount FROM summary""")
def stream_retraction(spark, sf_dir):
    """T1 with M2 and M3: rows that go and rows that change stream in any order with those that come; equals the batch summary."""
    t = A.Tables(spark, sf_dir)
    mappings = _event_mappings(t)
    rows = M.enrichment(_raw_events(t).withColumn("seq", F.col("event_id")), mappings).where("_reason IS NULL")
    filed = rows.select("event_id", "expense_name", "year", "month", "expense_day", "expense_amount", "currency",
                        F.col("_pri").alias("primary_category"), F.col("_sec").alias("secondary_category"))
    sign = lambda df, s: df.withColumn("sign", F.lit(s))
    gone, changed = F.col("event_id") % 5 == 0, (F.col("event_id") % 7 == 3) & (F.col("event_id") % 5 != 0)
    feed = sign(_raw_events(t).select(*filed.columns), 1).unionByName(sign(filed.where(gone | changed), -1)) \
        .unionByName(sign(filed.where(changed).withColumn("expense_amount", 2 * F.col("expense_amount")), 1))
    kept = CS.run_change_stream(_arrivals(spark, feed.drop("event_id")), mappings, scratch_dir(spark, "retracted"), compact_every=2)
    return D.summary_of(kept.cells.read(spark))


# ---- inputs that earlier rows lack ---------------------------------------------------

@register("small_positions", """
WITH h AS (SELECT l_partkey, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(month(l_shipdate) AS INTEGER) AS month,
                  CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / 100000 AS quantity FROM lineitem GROUP BY ALL)
SELECT 'Part#' || CAST(l_partkey AS VARCHAR) AS asset_name, year, month, quantity,
       CAST(CAST(CAST(quantity AS DECIMAL(18,9)) * CAST(p_retailprice AS DECIMAL(18,9)) AS DECIMAL(38,6)) AS DOUBLE) AS value
FROM h JOIN part ON l_partkey = p_partkey WHERE p_size >= 5""")
def small_positions(spark, sf_dir):
    """J4 for fractions of a unit (funds, metals): quantities with more than four decimals."""
    t = A.Tables(spark, sf_dir)
    held = A.holdings(t).withColumn("quantity", F.col("quantity") / 100000)
    value = N.position_value(held, A.prices(t)).where("price IS NOT NULL")
    return value.select("asset_name", "year", "month", "quantity", F.col("value_dec").cast("decimal(38,6)").cast("double").alias("value"))


@register("append_by_ledger", """
SELECT event_id % 10 AS ledger_id, (SELECT max(o_orderkey) + 1 FROM orders) + event_id // 10 AS expense_id, event_type AS expense_name, value AS expense_amount
FROM events WHERE event_type IN ('purchase', 'click')""")
def append_by_ledger(spark, sf_dir):
    """M1 for many ledgers: the rows of each are numbered anew, and none is taken for another's."""
    t = A.Tables(spark, sf_dir)
    led = A.ledger_with_ids(t).withColumn("ledger_id", F.pmod("expense_id", F.lit(10)))
    batch = event_batch(t).withColumn("ledger_id", F.pmod("seq", F.lit(10))).withColumn("seq", F.floor(F.col("seq") / 10))
    mappings = A.mappings(t).withColumn("ledger_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))))
    new, _ = M.new_expenses(led, batch, mappings, ["ledger_id"])
    return new.select("ledger_id", "expense_id", "expense_name", "expense_amount")


@register("json_mixed_forms", f"""
SELECT p_brand, {Q.f3('p_name')} AS name_key, lower(trim(min(p_type))) AS primary_category, lower(trim(min(p_brand))) AS secondary_category
FROM part GROUP BY p_brand, {Q.f3('p_name')}""")
def json_mixed_forms(spark, sf_dir):
    """Files of one object over several lines beside files of one object per line, in one folder."""
    t = A.Tables(spark, sf_dir)
    root = scratch_dir(spark, "mappings-mixed")
    m = t.part.groupBy("p_brand", mapping_key("p_name").alias("name_key")).agg(
        F.lower(F.trim(F.min("p_type"))).alias("primary_category"), F.lower(F.trim(F.min("p_brand"))).alias("secondary_category"))
    long = F.col("p_brand").like("%1")
    IO.mappings_to_json(m.where(~long), ["p_brand"], entries=20).write.partitionBy("p_brand").text(root)
    spread = F.regexp_replace("value", r"\},", "},\n  ")
    IO.mappings_to_json(m.where(long), ["p_brand"], entries=1 << 30).withColumn("value", spread).write.mode("append").partitionBy("p_brand").text(root)
    return IO.read_mappings_json(spark, root).drop("source")


@register("emptied_cashflow", f"""
WITH {Q.LEDGER_IDS}, y AS (SELECT min(year) AS y0 FROM ledger_ids),
c AS (SELECT unnest(['Salary', 'Interests Bank account', 'Dividendi e Cedole', 'Other', 'Income', 'Spending', 'Saving', 'Saving %']) AS category)
SELECT y0 AS year, CAST(m AS INTEGER) AS month, category, CAST(0.0 AS DOUBLE) AS value FROM y, c, range(1, 13) t(m)""")
def emptied_cashflow(spark, sf_dir):
    """The stored cashflow of a year whose rows have all gone is refreshed to zeros."""
    led = A.ledger_with_ids(A.Tables(spark, sf_dir))
    ledger_root, root = scratch_dir(spark, "cf-emptied"), scratch_dir(spark, "cashflow-emptied")
    IO.write_partitioned(led, ledger_root)
    years = [r.year for r in led.select("year").distinct().collect()]
    if not years:
        return spark.createDataFrame([], "year int, month int, category string, value double")
    income = spark.createDataFrame([], "category string, year int, month int, value double")
    MT.rebuild_cashflow(spark, ledger_root, income, root, years)
    IO.replace_months(led.limit(0), ledger_root, [(min(years), m) for m in range(1, 13)])
    MT.rebuild_cashflow(spark, ledger_root, income, root, [min(years)])
    return spark.read.parquet(root).where(F.col("year") == min(years)).select("year", "month", "category", "value")


@register("mapping_whitespace", f"""
SELECT {Q.f3('p_name')} AS name_key, lower(trim(arg_min(p_type, p_partkey))) AS primary_category, '' AS secondary_category
FROM part GROUP BY {Q.f3('p_name')}""")
def mapping_whitespace(spark, sf_dir):
    """Categories given with tabs, newlines and blanks around them, or none."""
    t = A.Tables(spark, sf_dir)
    adds = t.part.select(F.col("p_partkey").alias("seq"), F.lit("add").alias("op"), F.col("p_name").alias("expense_name"),
                         F.concat(F.lit("\t "), F.upper("p_type"), F.lit("\n")).alias("primary_category"), F.lit("\n").alias("secondary_category"), F.lit(False).alias("overwrite"))
    out, _ = M.change_mappings(A.mappings(t).limit(0), adds)
    return out


@register("retire_unknown", """
SELECT 'primary' AS kind, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS category,
       CASE WHEN c_custkey % 3 > 0 THEN 'category not found' ELSE 'missing category' END AS reason FROM customer""")
def retire_unknown(spark, sf_dir):
    """Requests for categories that nothing holds, or for none, are refused."""
    t = A.Tables(spark, sf_dir)
    summary = S.summaries_long(A.ledger(t))
    requests = t.customer.select(F.lit("primary").alias("kind"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).alias("category"))
    return M.retire_categories(A.known_categories(t), summary, S.category_totals(summary), requests)[2]


@register("totals_half_to_even", f"""
WITH {Q.KNOWN}, tot AS (SELECT 'secondary' AS kind, n_name AS name, CAST(n_nationkey + CASE WHEN n_nationkey % 2 = 0 THEN 0.125 ELSE 0.375 END AS DECIMAL(18,3)) AS total FROM nation)
SELECT COALESCE(k.kind, t.kind) AS kind, COALESCE(k.category, t.name) AS name, CAST(COALESCE(round_even(t.total, 2), 0) AS DOUBLE) AS total
FROM known k FULL JOIN tot t ON t.kind = k.kind AND t.name = k.category""")
def totals_half_to_even(spark, sf_dir):
    """Totals that lie between two cents."""
    t = A.Tables(spark, sf_dir)
    half = F.when(F.col("n_nationkey") % 2 == 0, 0.125).otherwise(0.375)
    totals = t.nation.select(F.lit("secondary").alias("kind"), F.col("n_name").alias("category"), (F.col("n_nationkey") + half).alias("total"))
    return C.categories_with_totals(A.known_categories(t), totals)


@register("stray_months", """
SELECT CAST(year(o_orderdate) AS INTEGER) + 1000 AS year, 'year out of range' AS reason, count(*) AS n_rows FROM orders WHERE o_custkey % 4 = 0 GROUP BY ALL""")
def stray_months(spark, sf_dir):
    """Rejects of the net-worth months: rows of years that no ledger can have."""
    led = A.Tables(spark, sf_dir).orders.select(F.when(F.col("o_custkey") % 4 == 0, F.year("o_orderdate") + 1000).otherwise(F.year("o_orderdate")).alias("year"))
    return N.stray_months(led).groupBy("year", "reason").agg(F.count("*").alias("n_rows"))


# ---- ids and deep pages -----------------------------------------------------------------

@register("dense_ids", f"""
WITH {Q.LEDGER}
SELECT count(*) AS n_rows, count(*) AS n_ids, CAST(0 AS BIGINT) AS first_id, count(*) - 1 AS last_id, CAST(0 AS BIGINT) AS out_of_order FROM ledger""")
def dense_ids(spark, sf_dir):
    """The ids of a ledger in the application's layout count from 0 over all its part files, month after month."""
    root = scratch_dir(spark, "dense-ids")
    IO.write_legacy_layout(in_parts(A.ledger(A.Tables(spark, sf_dir))), root)
    led, _ = IO.scan_legacy_ledger(spark, root)
    months = led.groupBy("year", "month").agg(F.min("expense_id").alias("low"), F.max("expense_id").alias("high"), F.count("*").alias("n"), F.countDistinct("expense_id").alias("ids"))
    gaps = F.count(F.when(F.col("high") - F.col("low") + 1 != F.col("n"), 1))
    return months.agg(F.sum("n").alias("n_rows"), F.sum("ids").alias("n_ids"), F.min("low").alias("first_id"), F.max("high").alias("last_id"), gaps.alias("out_of_order"))


@register("file_id_deletes", f"""
WITH {Q.LEDGER} SELECT year, month, count(*) AS n_rows, CAST(SUM({Q.money('expense_amount')}) AS DOUBLE) AS amount
FROM ledger WHERE NOT (month = 5 AND expense_amount > 30000) GROUP BY year, month""")
def file_id_deletes(spark, sf_dir):
    """M2 on files: rows are named by the ids that the scan gives them."""
    root = scratch_dir(spark, "id-deletes")
    IO.write_legacy_layout(A.ledger(A.Tables(spark, sf_dir)), root)
    led, _ = IO.scan_legacy_ledger(spark, root)
    left = M.delete_expenses(led, led.where((F.col("month") == 5) & (F.col("expense_amount") > 30000)).select("expense_id"))
    return left.groupBy("year", "month").agg(F.count("*").alias("n_rows"), F.sum(F.col("expense_amount").cast("decimal(18,2)")).cast("double").alias("amount"))


@register("ledger_deep_page", f"""
WITH {Q.LEDGER_IDS}, n AS (SELECT count(*) // 100 * 50 AS low FROM ledger_ids),
r AS (SELECT *, row_number() OVER (ORDER BY expense_amount DESC, expense_id) - 1 AS place FROM ledger_ids)
SELECT {VIEW_COLS} FROM r, n WHERE place >= low AND place < low + 50""")
def ledger_deep_page(spark, sf_dir):
    """A page from the middle of the sorted ledger, read from the partition that holds it."""
    view = V.ledger_view(A.ledger_with_ids(A.Tables(spark, sf_dir)))
    index = V.PageIndex.build(view, scratch_dir(spark, "pages"), "expense_amount", descending=True, part_rows=2000)
    return index.page(view.count() // 100)
