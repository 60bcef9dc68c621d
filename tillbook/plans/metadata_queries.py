"""Registered queries that skip data: search by a trigram index, years, categories and months from listings and stored cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillbook.domains import LEDGER_FILE_SUFFIX
from tillbook.operators import categories as K
from tillbook.operators import deltas as D
from tillbook.operators import filters as V
from tillbook.operators import reports as R
from tillbook.plans import io_queries  # noqa: F401
from tillbook.plans import sql_parts as Q
from tillbook.plans.registry import ORACLES, register
from tillbook.plans.view_queries import COMPARE_MONTHS, SEARCH
from tillbook.session import scratch_dir
from tillbook.sources import adapters as A
from tillbook.sources import io as IO
from tillbook.sources.footers import FooterIndex
from tillbook.sources.ngram_index import NgramIndex


def _cells(spark, led):
    table = D.counted_table(spark, scratch_dir(spark, "domain-cells"))
    D.build_cells(table, led)
    return table


@register("ledger_search_indexed", ORACLES["ledger_search"])
def ledger_search_indexed(spark, sf_dir):
    """Half of the files are indexed, the others have come since; only files with all trigrams of the terms are read."""
    led = A.ledger_with_ids(A.Tables(spark, sf_dir))
    root = scratch_dir(spark, "searched")
    index = NgramIndex(spark, root, scratch_dir(spark, "trigrams"), led.schema)
    by_name = led.repartitionByRange(8, "expense_name", "primary_category")
    by_name.where("year % 2 = 0").write.partitionBy("year").parquet(root)
    index.refresh()
    by_name.where("year % 2 = 1").write.mode("append").partitionBy("year").parquet(root)
    return V.ledger_view(index.search(**SEARCH).select(*led.columns))


@register("years_listed", ORACLES["years"])
def years_listed(spark, sf_dir):
    """S7 from the names of the partition folders; no file is opened."""
    root = scratch_dir(spark, "listed")
    IO.write_partitioned(A.ledger(A.Tables(spark, sf_dir)), root)
    return IO.discover_years(IO.listed_months(spark, root))


@register("category_domain_stored", ORACLES["category_domain"])
def category_domain_stored(spark, sf_dir):
    """A13 from stored cells; the ledger is not read for it."""
    t = A.Tables(spark, sf_dir)
    return K.domain_of_cells(_cells(spark, A.ledger(t)).read(), A.known_categories(t))


@register("months_compared_stored", ORACLES["months_compared"])
def months_compared_stored(spark, sf_dir):
    """P8 from stored cells: only the folders of the compared months are opened."""
    table = _cells(spark, A.ledger(A.Tables(spark, sf_dir)))
    wanted = table.months().where(F.col("month").isin(COMPARE_MONTHS))
    cells = table.read([(r.year, r.month) for r in wanted.collect()]).where("kind = 'primary'")
    return R.months_compared(D.summary_of(cells, ["primary"]).withColumnRenamed("category", "primary_category"), COMPARE_MONTHS)


@register("footer_generations", f"""
WITH {Q.LEDGER_IDS}
SELECT year, CASE WHEN year % 2 = 0 THEN 'INT64' ELSE 'INT32' END AS date_stored_as, count(*) AS n_rows
FROM ledger_ids GROUP BY year""")
def footer_generations(spark, sf_dir):
    """S2, S4, S5 from footers alone: odd years come after the index was made, so only their files are opened then."""
    led = A.ledger_with_ids(A.Tables(spark, sf_dir)).drop("expense_id")
    root, index = scratch_dir(spark, "footers-of"), FooterIndex(spark, scratch_dir(spark, "footer-index"))
    pattern = f"{root}/*/*{LEDGER_FILE_SUFFIX}"
    IO.write_legacy_layout(led.where("year % 2 = 0").withColumn("expense_date", F.unix_date("expense_date").cast("long")), root)
    index.footers(pattern)
    IO.write_legacy_layout(led.where("year % 2 = 1"), root)
    year, _, _ = IO.parse_legacy_path("file")
    date = F.filter("columns", lambda c: c.startswith("expense_date "))[0]
    return (index.footers(pattern).groupBy(year.alias("year"), F.split(date, " ")[1].alias("date_stored_as"))
            .agg(F.sum("rows").alias("n_rows")))


@register("indexed_layout_scan", ORACLES["schema_upgrade"])
def indexed_layout_scan(spark, sf_dir):
    """A root of two generations, half of whose footers were remembered before the scan."""
    led = A.ledger_with_ids(A.Tables(spark, sf_dir)).drop("expense_id")
    root, index = scratch_dir(spark, "indexed-layout"), FooterIndex(spark, scratch_dir(spark, "footer-index"))
    IO.write_legacy_layout(led.where("year % 2 = 0").withColumn("expense_date", F.unix_date("expense_date").cast("long")), root)
    IO.scan_legacy_ledger(spark, root, index)
    IO.write_legacy_layout(led.where("year % 2 = 1"), root)
    ok, _ = IO.scan_legacy_ledger(spark, root, index)
    return ok.drop("expense_id")
