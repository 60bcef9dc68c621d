"""Contiguous shards of near-equal bytes from global prefix sums (DataFrame functions only).

Rows are range-partitioned in document order, every partition is summed, and
the running totals of those sums (one row per partition) turn the running sum
inside a partition into a global one.  The global sum is then cut at equal
targets, so no step orders or sums all rows in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_width, stored

ORDER = ["doc_id", "text_crc32", "size", "tie"]


def shard_by_bytes(docs: DataFrame, shards: int = 8, partitions: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    ``size`` is the text's UTF-8 bytes plus 1 (null text: 1, crc32 of nothing: 0).  The order is doc_id
    (nulls first), then crc32 and size, so repeated rows are interchangeable.  A row goes to the shard that holds
    the middle of its byte range; shards differ by at most one row's size from the target, and a row larger than a
    target can leave a shard empty.  An empty table gives no rows; other columns of ``docs`` are not read.
    ``slot`` counts from 0 without gaps inside each shard.
    """
    spark = docs.sparkSession
    partitions = partitions or shuffle_width(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(F.col("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"),
                         F.crc32(text.cast("binary")).alias("text_crc32"),
                         F.monotonically_increasing_id().alias("tie"))
    ranged = stored(narrow.repartitionByRange(partitions, *ORDER).withColumn("part", F.spark_partition_id()), "shard-ranges")

    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    totals = ranged.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    offsets = totals.select("part", F.coalesce(F.sum("part_bytes").over(ahead), F.lit(0)).alias("bytes_ahead"),
                            F.coalesce(F.sum("part_rows").over(ahead), F.lit(0)).alias("rows_ahead"),
                            F.sum("part_bytes").over(Window.partitionBy()).alias("all_bytes"))

    inside = Window.partitionBy("part").orderBy(*ORDER)
    placed = ranged.join(F.broadcast(offsets), "part").select(
        "doc_id", "size", "text_crc32", "all_bytes",
        (F.col("bytes_ahead") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("start"),
        (F.col("rows_ahead") + F.row_number().over(inside) - 1).alias("row"))
    middle = (2 * F.col("start") + F.col("size")).cast("decimal(30,0)")
    shard = F.floor(middle * shards / (2 * F.col("all_bytes")).cast("decimal(30,0)")).cast("int")
    cut = stored(placed.withColumn("shard", F.least(shard, F.lit(shards - 1))), "shard-cut")
    first = cut.groupBy("shard").agg(F.min("row").alias("first_row"))  # at most ``shards`` rows
    return cut.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("row") - F.col("first_row")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
