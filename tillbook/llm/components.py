"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = near.join(low, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge table (u, v): root is the smallest node of its component.

    Self-links and repeated links are harmless; an empty table gives no rows.  The rounds (their number grows with the logarithm
    of the longest path) end when the table no longer changes.
    """
    now = stored(edges.where("u != v").distinct(), "links")
    mark = None
    while True:
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (row.n, row.s) == mark or not row.n:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")) \
                .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        mark = (row.n, row.s)
        now = stored(_stars(_stars(now, True), False), "links")
