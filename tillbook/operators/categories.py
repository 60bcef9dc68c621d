"""Category domain and resolution: F2, A13, J6, U2, O3."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.domains import KINDS, TOTAL_LABEL, category_column
from tillbook.functions.scalars import normalize_category, round2


def resolve_categories(values: DataFrame, value: str, existing: DataFrame, existing_col: str,
                       out: str = "resolved", by: Sequence[str] = ()) -> DataFrame:
    """match each value case-insensitively to an existing spelling, else F1.

    Empty and null values stay as they are.  When existing spellings clash
    on case, the smallest one wins (deterministic).  The lookup is a plain
    equi join on the lower-cased key: Spark broadcasts it only when its size
    is under the session's broadcast threshold.
    """
    lookup = (existing.where(F.col(existing_col).isNotNull() & (F.col(existing_col) != ""))
              .groupBy(*by, F.lower(existing_col).alias("_k"))
              .agg(F.min(existing_col).alias("_spelling")))
    j = values.withColumn("_k", F.lower(value)).join(lookup, [*by, "_k"], "left")
    v = F.col(value)
    resolved = (F.when(v.isNull() | (v == ""), v)
                .otherwise(F.coalesce(F.col("_spelling"), normalize_category(v))))
    return j.withColumn(out, resolved).drop("_k", "_spelling")


def used_categories(ledger: DataFrame, kinds: Sequence[str] = KINDS,
                    by: Sequence[str] = ()) -> DataFrame:
    """Categories used by the ledger (and hence its summaries): ``(by..., kind, category)``."""
    entries = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(category_column(k)).alias("category"))
                        for k in kinds])
    return ledger.select(*by, F.inline(entries))


def category_domain(ledger: DataFrame, known: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A13 + U2 + O3: distinct non-empty categories of the ledger and its
    summaries (Total excluded) and the known list, each normalised (F1),
    de-duplicated and sorted by code point per kind."""
    pairs = ledger.select(*by, *[category_column(k) for k in KINDS]).distinct()  # few spellings left, whatever the rows
    return _domain(used_categories(pairs, by=by), known, by)


def domain_of_cells(cells: DataFrame, known: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A13 without a scan of the ledger: the same domain from counted cells (``operators.deltas``), which hold every category with rows."""
    return _domain(cells.where(F.col("n") > 0).select(*by, "kind", "category").distinct(), known, by)


def _domain(used: DataFrame, known: DataFrame, by: Sequence[str]) -> DataFrame:
    used = used.where(F.col("category") != TOTAL_LABEL)
    allc = used.unionByName(known.select(*by, "kind", "category"))
    return (allc.where(F.col("category").isNotNull() & (F.col("category") != "")).distinct()
            .select(*by, "kind", normalize_category("category").alias("category"))
            .distinct()
            .orderBy(*by, "kind", "category"))


def categories_with_totals(known: DataFrame, totals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Known categories and used ones (A5 totals) merged by a full outer
    join; a missing total is 0.0; totals rounded to 2; sorted by lower-cased name."""
    k = known.select(*by, "kind", F.col("category").alias("name")).distinct()
    t = totals.select(*by, "kind", F.col("category").alias("name"), "total")
    j = k.join(t, [*by, "kind", "name"], "full")
    return (j.select(*by, "kind", "name",
                     round2(F.coalesce(F.col("total").cast("decimal(38,6)"), F.lit(0).cast("decimal(38,6)"))).cast("double").alias("total"))
            .orderBy(*by, "kind", F.lower("name"), "name"))
