"""M17 + S6: incremental rebuild of stored summaries and cashflow.

The stored form of a summary is *sparse cells*: one total in whole units per (by, kind,
category, year, month) partitioned by (year, month).  Densifying (gaps ->
0.0) and the Total rows are computed when reading, so rebuilding a month
rewrites only that month's partition (dynamic partition overwrite) and
never touches the rest of the year.  The months are a bounded list of literals, so the ledger
scan reads only their partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.domains import INCOME_CATEGORIES, KINDS
from tillbook.operators.cashflow import cashflow_statement
from tillbook.operators.summaries import _stack_kinds, summaries_from_stacked
from tillbook.session import stored
from tillbook.sources.io import LEDGER_PARTITIONED, month_filter, read_ledger, write_partitioned


def summary_cells(ledger: DataFrame, kinds: Sequence[str] = KINDS, by: Sequence[str] = ()) -> DataFrame:
    """Sparse cells ``(by..., kind, category, year, month, amt)``; null and
    ``Total`` categories are kept as cells (they mark recorded months)."""
    # stacked first: one shuffle, as many ledgers' category combinations are nearly as many as their rows
    return (_stack_kinds(ledger, kinds, by)
            .groupBy(*by, "kind", "category", "year", "month").agg(F.sum("amt").alias("amt")))


def _stored_table(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """A stored table, or one without rows where nothing has been written yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.parquet(root) if there else spark.createDataFrame([], schema)


def rebuild_months(spark: SparkSession, ledger_root: str, cells_root: str, months: Sequence[tuple[int, int]],
                   kinds: Sequence[str] = KINDS, by: Sequence[str] = (), schema: T.StructType = LEDGER_PARTITIONED) -> None:
    """Recompute the cells of the listed (year, month)s from the stored ledger and overwrite just those partitions.

    A month that has lost all its rows stays recorded: every ledger that had cells in a listed month
    (and the single ledger without ``by``) gets a zero marker cell there, so its summary shows 0.0.
    ``schema`` names the stored ledger's columns (``ledger_schema`` with ``by`` and ids).
    """
    months = sorted({(int(y), int(m)) for y, m in months})
    fresh = summary_cells(read_ledger(spark, ledger_root, schema=schema, months=months), kinds, by)
    keys = [*by, "kind", "year", "month"]
    known = _stored_table(spark, cells_root, fresh.schema)
    marks = known.where(month_filter(months)).select(*keys).distinct()
    if not by:
        listed = spark.createDataFrame(months, "year int, month int")
        marks = marks.unionByName(listed.select(F.explode(F.array(*[F.lit(k) for k in kinds])).alias("kind"), "year", "month")).distinct()
    marks = stored(marks, "recorded-months")  # read before the partitions are overwritten
    zero = marks.select(*by, "kind", F.lit(None).cast("string").alias("category"), "year", "month", F.lit(0).cast("long").alias("amt"))
    write_partitioned(fresh.unionByName(zero.select(*fresh.columns)), cells_root)


def rebuild_cashflow(spark: SparkSession, ledger_root: str, income: DataFrame, cashflow_root: str, years: Sequence[int],
                     by: Sequence[str] = (), schema: T.StructType = LEDGER_PARTITIONED) -> None:
    """Recompute the stored cashflow statement of the listed years from the stored ledger and the income table.

    A year that has lost all its rows stays recorded: every ledger with a stored statement of it gets one of zeros.
    """
    months = [(int(y), m) for y in years for m in range(1, 13)]
    ledger = read_ledger(spark, ledger_root, schema=schema, months=months)
    wanted = F.col("year").isin([int(y) for y in years])
    income = income.where(wanted).select(*by, "category", "year", "month", "value")
    shape = T.StructType([*[income.schema[c] for c in (*by, "category", "year")]])
    kept = stored(_stored_table(spark, cashflow_root, shape).where(wanted).select(*by, "year").distinct(), "recorded-years")
    nothing = kept.select(*by, F.lit(INCOME_CATEGORIES[0]).alias("category"), F.col("year").cast(income.schema["year"].dataType).alias("year"),
                          F.lit(1).cast(income.schema["month"].dataType).alias("month"), F.lit(0.0).alias("value"))
    statement = cashflow_statement(income.unionByName(nothing), ledger, by)
    write_partitioned(statement, cashflow_root, ["year"])


def read_summary(spark: SparkSession, cells_root: str, kinds: Sequence[str] = KINDS,
                 by: Sequence[str] = ()) -> DataFrame:
    """The dense summary with Total rows from the stored cells."""
    cells = spark.read.parquet(cells_root)
    return summaries_from_stacked(cells, kinds, by)
