"""T1 with enrichment (J1) and retraction (M2, M3): summaries kept current from a stream of raw changes.

Arriving rows are looked up in the mapping table by a stream-static join and normalised like a batch of new expenses; rows
that cannot be filed go to a rejects table.  A row may carry ``sign`` -1: it takes back an earlier row (an edit arrives as the
old row with -1 and the new one with 1; see ``deltas.change_feed``).  Every micro-batch is folded to signed cells
(sum and number of rows) and appended to a log; readers add the log up.  There is no running state: the work of a
batch is proportional to the batch, rows may come in any order, and a replayed epoch replaces its own files.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.domains import KINDS
from tillbook.operators.changes import enrichment, ledger_rows_of
from tillbook.operators.deltas import cells_schema, signed_cells
from tillbook.streaming.summary_stream import CellTable


class DeltaTable(CellTable):
    """A log of signed cells: a cell is the sum of its entries, and is there while rows are behind it."""

    VALUES = ("amt", "n")

    def _folded(self, cells) -> DataFrame:
        return cells.agg(F.sum("amt").alias("amt"), F.sum("n").alias("n")).where("n != 0")


class ChangeStream:
    """The tables that a change stream keeps under ``root``: ``cells`` and ``rejects``."""

    def __init__(self, root: str, arrivals: T.StructType, kinds: Sequence[str] = KINDS, by: Sequence[str] = (), compact_every: int = 50):
        self.root, self.arrivals, self.kinds, self.by = root.rstrip("/"), arrivals, list(kinds), list(by)
        self.cells = DeltaTable(os.path.join(self.root, "cells"), by, compact_every, cells_schema(by, arrivals))

    def take(self, batch: DataFrame, epoch_id: int) -> None:
        """One enriched micro-batch: its refused rows, then its signed cells.  Both replace what an earlier try of the epoch has left."""
        refused = batch.where(F.col("_reason").isNotNull()).select(*self.arrivals.fieldNames(), F.col("_reason").alias("reason"))
        (refused.withColumn("epoch", F.lit(int(epoch_id)).cast("long")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(f"{self.root}/rejects"))
        rows = ledger_rows_of(batch.where(F.col("_reason").isNull()), [*self.by, "sign"])
        self.cells.merge(signed_cells(rows, self.kinds, self.by), epoch_id)

    def rejects(self, spark: SparkSession) -> DataFrame:
        """The refused rows with their ``reason`` and ``epoch``."""
        schema = T.StructType([*self.arrivals.fields, T.StructField("reason", T.StringType()), T.StructField("epoch", T.LongType())])
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/rejects")
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        return spark.read.schema(schema).parquet(f"{self.root}/rejects") if there else spark.createDataFrame([], schema)


def run_change_stream(arrivals: DataFrame, mappings: DataFrame, root: str, kinds: Sequence[str] = KINDS, by: Sequence[str] = (),
                      trigger: dict | None = None, compact_every: int = 50) -> ChangeStream:
    """Process what has arrived (``availableNow`` by default) and return the kept tables.

    ``arrivals`` is a stream of raw changes (``enrich_expenses``'s columns, ``seq`` not needed; ``sign`` 1 where it is missing or null).
    A row that takes another back carries the categories that were filed, so a mapping changed meanwhile does not matter.
    The mapping table is read anew for every micro-batch.
    """
    signed = arrivals if "sign" in arrivals.columns else arrivals.withColumn("sign", F.lit(1))
    signed = signed.withColumn("sign", F.coalesce(F.col("sign").cast("int"), F.lit(1)))
    kept = ChangeStream(root, signed.schema, kinds, by, compact_every)
    query = (enrichment(signed, mappings, by).writeStream
             .option("checkpointLocation", os.path.join(root, "checkpoint"))
             .foreachBatch(kept.take)
             .trigger(**(trigger or {"availableNow": True}))
             .start())
    query.awaitTermination()
    return kept
