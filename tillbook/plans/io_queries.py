"""Registered queries: sources, sinks, maintenance and streaming.

Each writes data derived from the driver tables into a fresh folder under
the session's shared checkpoint folder, then reads it back through the
operator under test.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tillbook.functions.scalars import mapping_key, normalize_category, to_ref_currency
from tillbook.operators import maintenance as MT
from tillbook.operators import summaries as S
from tillbook.plans import sql_parts as Q
from tillbook.plans.registry import register
from tillbook.session import scratch_dir
from tillbook.sources import adapters as A
from tillbook.sources import io as IO
from tillbook.streaming import summary_stream as ST

LEDGER_COLS = ("expense_name, expense_date, expense_amount, currency, expense_in_ref_currency, "
               "primary_category, secondary_category, year, month")


@register("legacy_layout_scan", f"""
WITH {Q.LEDGER} SELECT {LEDGER_COLS} FROM ledger WHERE year % 2 = 0
UNION ALL SELECT {LEDGER_COLS} FROM ledger WHERE year % 2 = 1 AND expense_amount > 20000""")
def legacy_layout_scan(spark, sf_dir):
    """Written twice: the second write replaces odd years by fewer rows."""
    led = A.ledger(A.Tables(spark, sf_dir))
    root = scratch_dir(spark, "legacy")
    IO.write_legacy_layout(led, root)
    IO.write_legacy_layout(led.where("year % 2 = 1 and expense_amount > 20000"), root)
    ok, _ = IO.scan_legacy_ledger(spark, root)
    return ok.drop("expense_id")


def in_parts(ledger, parts=5):
    """Dealt so that a month is written as several part files (``parts`` groups of names), by as many tasks as a shuffle has."""
    tasks = max(parts, int(ledger.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return ledger.repartition(tasks, "year", "month", F.pmod(F.xxhash64("expense_name"), F.lit(parts)))


@register("legacy_ids", f"""
WITH {Q.LEDGER} SELECT year, month, count(*) AS n_rows, count(*) AS n_ids FROM ledger GROUP BY year, month""")
def legacy_ids(spark, sf_dir):
    """Ids are distinct although a month is stored as several part files."""
    root = scratch_dir(spark, "legacy-ids")
    IO.write_legacy_layout(in_parts(A.ledger(A.Tables(spark, sf_dir))), root)
    ok, _ = IO.scan_legacy_ledger(spark, root)
    return ok.groupBy("year", "month").agg(F.count("*").alias("n_rows"), F.countDistinct("expense_id").alias("n_ids"))


@register("schema_upgrade", f"""
WITH {Q.LEDGER_IDS} SELECT {LEDGER_COLS} FROM ledger_ids""")
def schema_upgrade(spark, sf_dir):
    """Older files keep dates as days since 1970; both generations lie in one root."""
    led = A.ledger_with_ids(A.Tables(spark, sf_dir)).drop("expense_id")
    root = scratch_dir(spark, "legacy-generations")
    old = led.where("year % 2 = 0").withColumn("expense_date", F.unix_date("expense_date").cast("long"))
    IO.write_legacy_layout(old, root)
    IO.write_legacy_layout(led.where("year % 2 = 1"), root)
    ok, _ = IO.scan_legacy_ledger(spark, root)
    return ok.drop("expense_id")


@register("legacy_rejects", f"""
WITH {Q.LEDGER} SELECT 'month out of range 1..12' AS reason, count(*) AS n_rows FROM ledger""")
def legacy_rejects(spark, sf_dir):
    """Files whose month does not parse are rejected with their row counts."""
    root = scratch_dir(spark, "legacy-rejects")
    IO.write_legacy_layout(A.ledger(A.Tables(spark, sf_dir)).withColumn("month", F.col("month") + 12), root)
    _, bad = IO.scan_legacy_ledger(spark, root)
    return bad.groupBy("reason").agg(F.sum("rows").alias("n_rows"))


@register("year_table_scan", f"""
WITH {Q.HOLDINGS},
keys AS (SELECT DISTINCT asset_name, category, year FROM hold)
SELECT k.asset_name, k.category, CASE WHEN k.year % 2 = 0 THEN '' ELSE 'http://' || k.asset_name END AS link,
       k.year, CAST(m AS INTEGER) AS month, h.quantity
FROM keys k CROSS JOIN range(1, 13) t(m)
LEFT JOIN hold h ON h.asset_name = k.asset_name AND h.year = k.year AND h.month = t.m""")
def year_table_scan(spark, sf_dir):
    """Yearly wide holdings: even years were written without the later ``link`` column."""
    root = scratch_dir(spark, "year-tables")
    wide = S.to_wide(A.holdings(A.Tables(spark, sf_dir)), ["asset_name", "category", "year"], value="quantity")
    IO.write_year_tables(wide.where("year % 2 = 0"), root, "investments.parquet")
    IO.write_year_tables(wide.where("year % 2 = 1").withColumn("link", F.concat(F.lit("http://"), "asset_name")), root, "investments.parquet")
    return IO.read_year_table(spark, root, "investments.parquet", ["asset_name", "category", "link"],
                              value="quantity")


@register("json_sources", f"""
SELECT p_brand, {Q.f3('p_name')} AS name_key, lower(trim(min(p_type))) AS primary_category,
       lower(trim(min(p_brand))) AS secondary_category
FROM part GROUP BY p_brand, {Q.f3('p_name')}""")
def json_sources(spark, sf_dir):
    """Mappings JSON objects per brand ledger (several for a large one), written as text, read back."""
    t = A.Tables(spark, sf_dir)
    root = scratch_dir(spark, "mappings-json")
    m = (t.part.groupBy("p_brand", mapping_key("p_name").alias("name_key"))
         .agg(F.lower(F.trim(F.min("p_type"))).alias("primary_category"),
              F.lower(F.trim(F.min("p_brand"))).alias("secondary_category")))
    IO.mappings_to_json(m, ["p_brand"], entries=50).write.partitionBy("p_brand").text(root)
    return IO.read_mappings_json(spark, root).drop("source")


@register("known_json_source", """
SELECT r_name, 'primary' AS kind, n_name AS category
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def known_json_source(spark, sf_dir):
    """One known-categories JSON object per region ledger (no
    "secondary" key, which reads as an empty list), written and read back."""
    t = A.Tables(spark, sf_dir)
    root = scratch_dir(spark, "known-json")
    docs = (t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
            .groupBy("r_name")
            .agg(F.to_json(F.struct(F.array_sort(F.collect_list("n_name")).alias("primary"))).alias("value")))
    docs.write.partitionBy("r_name").text(root)
    return IO.read_known_categories_json(spark, root).drop("source")


@register("years", f"""
WITH {Q.LEDGER}
SELECT DISTINCT year FROM ledger UNION SELECT CAST(year(current_date) AS INTEGER)""")
def years(spark, sf_dir):
    return IO.discover_years(A.ledger(A.Tables(spark, sf_dir)))


CHANGED_LEDGER = """y AS (SELECT min(year) AS y0 FROM ledger),
ledger2 AS (SELECT ledger.* FROM ledger, y
            WHERE NOT (year = y0 AND (month = 2 OR (month = 3 AND primary_category LIKE 'S%'))))"""


def _changed_store(spark, led, ledger_root):
    """After the first build, the first year's February loses all its rows and March some; gives the changed months."""
    first = led.agg(F.min("year")).first()[0]
    months = [(first, 2), (first, 3)] if first is not None else []
    if months:
        left = led.where((F.col("year") == first) & (F.col("month") == 3) & ~F.col("primary_category").like("S%"))
        IO.replace_months(left, ledger_root, months)
    return months


@register("rebuild_partitions", f"""
WITH {Q.LEDGER}, {CHANGED_LEDGER}, {Q.summaries_long('ledger2')}
SELECT kind, category, year, month, amount FROM summary
UNION ALL SELECT DISTINCT kind, category, year, 2 AS month, CAST(0.0 AS DOUBLE) AS amount FROM summary, y WHERE year = y0""")
def rebuild_partitions(spark, sf_dir):
    """Store the ledger and its summary cells, change two months of the stored ledger, rebuild those; read back."""
    led = A.ledger(A.Tables(spark, sf_dir))
    ledger_root, cells_root = scratch_dir(spark, "ledger"), scratch_dir(spark, "cells")
    IO.write_partitioned(led, ledger_root)
    IO.write_partitioned(MT.summary_cells(IO.read_ledger(spark, ledger_root)), cells_root)
    MT.rebuild_months(spark, ledger_root, cells_root, _changed_store(spark, led, ledger_root))
    return MT.read_summary(spark, cells_root)


@register("rebuild_partitions_by_ledger", f"""
WITH {Q.LEDGER}, {CHANGED_LEDGER},
kept AS (SELECT ledger_id, year, month, SUM({Q.money('expense_in_ref_currency')}) AS amt FROM ledger2
         WHERE primary_category IS NOT NULL AND primary_category <> 'Total' GROUP BY ledger_id, year, month),
recorded AS (SELECT DISTINCT ledger_id, year, month FROM ledger)
SELECT r.ledger_id, r.year, r.month, CAST(COALESCE(k.amt, 0) AS DOUBLE) AS amount
FROM recorded r LEFT JOIN kept k USING (ledger_id, year, month)""")
def rebuild_partitions_by_ledger(spark, sf_dir):
    """M17 for many ledgers in one store: each ledger's monthly primary Total; emptied months stay, with 0.0."""
    led = A.ledger(A.Tables(spark, sf_dir), with_ledger_id=True)
    by, schema = ["ledger_id"], IO.ledger_schema(["ledger_id"])
    led = led.withColumn("expense_id", F.xxhash64(*led.columns)).select(*schema.fieldNames())
    ledger_root, cells_root = scratch_dir(spark, "ledgers"), scratch_dir(spark, "ledger-cells")
    IO.write_partitioned(led, ledger_root)
    IO.write_partitioned(MT.summary_cells(IO.read_ledger(spark, ledger_root, schema=schema), by=by), cells_root)
    MT.rebuild_months(spark, ledger_root, cells_root, _changed_store(spark, led, ledger_root), by=by, schema=schema)
    total = MT.read_summary(spark, cells_root, by=by).where((F.col("kind") == "primary") & (F.col("category") == "Total"))
    return total.select("ledger_id", "year", "month", "amount")


@register("rebuild_cashflow", f"""
WITH {Q.LEDGER}, {CHANGED_LEDGER}, months12 AS (SELECT CAST(m AS INTEGER) AS month FROM range(1, 13) t(m)),
spent AS (SELECT year, month, SUM({Q.money('expense_in_ref_currency')}) AS s FROM ledger2
          WHERE primary_category IS NOT NULL AND primary_category <> 'Total' GROUP BY year, month)
SELECT y0 AS year, m.month, CAST(COALESCE(s.s, 0) AS DOUBLE) AS spending
FROM y, months12 m LEFT JOIN spent s ON s.year = (SELECT y0 FROM y) AND s.month = m.month""")
def rebuild_cashflow(spark, sf_dir):
    """The changed year's stored cashflow is recomputed with its summaries; its spending rows."""
    t = A.Tables(spark, sf_dir)
    led = A.ledger(t)
    ledger_root, root = scratch_dir(spark, "cf-ledger"), scratch_dir(spark, "cashflow")
    IO.write_partitioned(led, ledger_root)
    years = [r.year for r in led.select("year").distinct().toLocalIterator()]
    MT.rebuild_cashflow(spark, ledger_root, A.income(t), root, years)
    changed = _changed_store(spark, led, ledger_root)
    MT.rebuild_cashflow(spark, ledger_root, A.income(t), root, sorted({y for y, _ in changed}))
    return spark.read.parquet(root).where(F.col("category") == "Spending").where(F.col("year").isin([y for y, _ in changed])) \
        .select("year", "month", F.col("value").alias("spending"))


STREAM_LEDGER = f"""sledger AS (
  SELECT {Q.f1('event_type')} AS primary_category,
         {Q.f1('CAST(user_id % 10 AS VARCHAR)')} AS secondary_category,
         value AS expense_in_ref_currency, CAST(year(ts) AS INTEGER) AS year,
         CAST(month(ts) AS INTEGER) AS month
  FROM events)"""


def stream_ledger(stream):
    d = F.col("ts").cast("date")
    return (stream
            .select(F.col("event_type").alias("expense_name"), d.alias("expense_date"),
                    F.col("value").alias("expense_amount"), F.lit("E").alias("currency"),
                    to_ref_currency("value").alias("expense_in_ref_currency"),
                    normalize_category("event_type").alias("primary_category"),
                    normalize_category(F.pmod("user_id", F.lit(10)).cast("string")).alias("secondary_category"),
                    F.year(d).alias("year"), F.month(d).alias("month")))


@register("stream_summary", f"""
WITH {STREAM_LEDGER}, {Q.summaries_long('sledger')}
SELECT kind, category, year, month, amount FROM summary""")
def stream_summary(spark, sf_dir):
    """All events streamed from a table stored as a folder of part files, in several batches (so months come late and
    again) with a compaction between; the result equals the batch summary."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder, files = scratch_dir(spark, "events"), 6
    events.repartition(files, "event_id").write.parquet(folder)
    src = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files // 3).parquet(folder)
    table = ST.run_summary_stream(stream_ledger(src), scratch_dir(spark, "stream"), compact_every=2)
    return ST.summary_from_cells(table.read(spark))
