"""Ledger view: P1-P5 and O4.

Filters are plain Column predicates, so Catalyst pushes the amount range
into the Parquet scan; the case-insensitive substring tests run right after
the scan inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.domains import PAGE_SIZE
from tillbook.functions.scalars import contains_ci, day_of_month, round2


def search_ledger(ledger: DataFrame, name: str | None = None, category: str | None = None,
                  amount_min: float | None = None, amount_max: float | None = None) -> DataFrame:
    """Literal, case-insensitive name and category search plus an
    inclusive amount range on ``expense_amount``; every filter optional.
    Null names (or both categories null) drop out of a search on them."""
    df = ledger
    if name:
        df = df.where(contains_ci("expense_name", name))
    if category:
        df = df.where(contains_ci("primary_category", category)
                      | contains_ci("secondary_category", category))
    if amount_min is not None:
        df = df.where(F.col("expense_amount") >= F.lit(float(amount_min)))
    if amount_max is not None:
        df = df.where(F.col("expense_amount") <= F.lit(float(amount_max)))
    return df


def display_rows(df: DataFrame, day_only: bool = True) -> DataFrame:
    """Dates as day of month (or ISO text), floats rounded to 2."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.name == "expense_date":
            c = day_of_month(c) if day_only else F.date_format(c, "yyyy-MM-dd")
        elif f.dataType.typeName() == "double":
            c = round2(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def ledger_view(ledger: DataFrame, **filters) -> DataFrame:
    """``id`` assigned before filtering (the stored ``expense_id``), then
    the filters, then the display projection."""
    return display_rows(search_ledger(ledger.withColumnRenamed("expense_id", "id"), **filters))


def _order(sort_by: str, descending: bool, tie_break: str) -> list:
    key = F.col(sort_by).desc_nulls_last() if descending else F.col(sort_by).asc_nulls_first()
    return [key, F.col(tie_break).asc()]


class PageIndex:
    """O4 for deep pages: the rows in sorted order as range partitions under ``root``, and how many rows lie before each.

    Built once by a range shuffle (ties are parted by ``tie_break``, so a hot value is spread too); a page then reads only
    the one or two partitions that hold it, whatever its number, and no task handles the rows before it.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, sort_by: str, descending: bool = False, tie_break: str = "id"):
        self.spark, self.root, self.order = spark, root.rstrip("/"), _order(sort_by, descending, tie_break)
        self.schema = T.StructType([*schema.fields, T.StructField("_part", T.IntegerType())])

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/rows")

    @classmethod
    def build(cls, df: DataFrame, root: str, sort_by: str, descending: bool = False, tie_break: str = "id", part_rows: int = 1_000_000) -> "PageIndex":
        index = cls(df.sparkSession, root, df.schema, sort_by, descending, tie_break)
        parts = max(1, -(-df.count() // part_rows))
        (df.repartitionByRange(parts, *index.order).withColumn("_part", F.spark_partition_id())
         .write.mode("overwrite").partitionBy("_part").parquet(f"{index.root}/rows"))
        sizes = index._rows().groupBy("_part").agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.orderBy("_part")) - F.col("n")  # one row per partition
        sizes.select("_part", "n", before.alias("before")).coalesce(1).write.mode("overwrite").parquet(f"{index.root}/parts")
        return index

    def page(self, page_no: int, page_size: int = PAGE_SIZE) -> DataFrame:
        """The rows of one page, in order."""
        low, high = page_no * page_size, (page_no + 1) * page_size
        hit = self.spark.read.parquet(f"{self.root}/parts").where((F.col("before") < high) & (F.col("before") + F.col("n") > low)).collect()
        before = F.lit(None).cast("long")
        for r in hit:
            before = F.when(F.col("_part") == r["_part"], F.lit(r.before)).otherwise(before)
        rows = self._rows().where(F.col("_part").isin([r["_part"] for r in hit]))
        place = before + F.row_number().over(Window.partitionBy("_part").orderBy(*self.order)) - 1
        return rows.withColumn("_place", place).where((F.col("_place") >= low) & (F.col("_place") < high)).orderBy("_place").drop("_part", "_place")


def page(df: DataFrame, sort_by: str, descending: bool = False, page_no: int = 0,
         page_size: int = PAGE_SIZE, tie_break: str = "id") -> DataFrame:
    """Sort by any column (tie-broken by id), one page.

    Spark plans ``orderBy + offset + limit`` as a distributed top-k: each
    partition keeps its best ``offset + limit`` rows before the merge, so no
    full sort of the ledger happens.
    """
    return df.orderBy(*_order(sort_by, descending, tie_break)).offset(page_no * page_size).limit(page_size)
