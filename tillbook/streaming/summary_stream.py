"""Keep the expense summaries current as expenses arrive.

A Structured Streaming job folds arriving ledger rows into running exact
totals (whole units) per (by, kind, category, year, month) -- state is bounded by
categories x months, not by rows.  Any date may arrive late, so there is no
watermark.  Each micro-batch (``update`` mode) carries the new totals of the
groups it touched; ``foreachBatch`` appends them to a cell log in the shared
checkpoint folder, and readers keep the latest total per cell.  The dense summary
with Total rows is then the ordinary batch operator over those cells, so the
streamed result equals the batch result over everything received.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.domains import KINDS
from tillbook.operators.summaries import _stack_kinds, summaries_from_stacked

CELL_KEYS = ("kind", "category", "year", "month")


def running_cells(ledger_stream: DataFrame, kinds: Sequence[str] = KINDS,
                  by: Sequence[str] = ()) -> DataFrame:
    """Streaming aggregation: total units per (by, kind, category, year, month)."""
    stacked = _stack_kinds(ledger_stream, kinds, by)
    return (stacked.groupBy(*by, *CELL_KEYS)
            .agg(F.sum("amt").alias("amt")))


class CellTable:
    """Append-only log of running cells, one partition per micro-batch, with a compacted base.

    In ``update`` mode each micro-batch carries the *current* total of every
    cell it touched, so the sink only appends those rows under
    ``log/epoch=<id>``: the work per batch is proportional to the batch, not to
    the state.  The partition is written with dynamic overwrite, so a
    replayed epoch (after a failure) replaces itself instead of duplicating.
    Readers take the latest total per cell (``max_by`` over the epoch, an
    aggregation that combines map-side).  Every ``compact_every`` batches the log up to that batch
    is folded into ``base/upto=<epoch>``; readers use the newest finished base and the log after it,
    so a later or replayed batch never meets the base, and what it replaces is then removed.
    """

    VALUES = ("amt",)

    def __init__(self, root: str, by: Sequence[str] = (), compact_every: int = 50, schema: T.StructType | None = None):
        self.root, self.by, self.compact_every = root.rstrip("/"), list(by), compact_every
        #: Of an empty table; without one the ``by`` columns are text.
        self.schema = schema or T.StructType.fromDDL(", ".join([*[f"`{c}` string" for c in by], "kind string, category string, year int, month int, amt long"]))

    def merge(self, batch: DataFrame, epoch_id: int) -> None:
        (batch.withColumn("epoch", F.lit(int(epoch_id)).cast("long"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("epoch").parquet(f"{self.root}/log"))
        if (int(epoch_id) + 1) % self.compact_every == 0:
            self.compact(batch.sparkSession, int(epoch_id))

    def _folders(self, spark: SparkSession, name: str, key: str, marker: str = "") -> dict:
        """number -> path of ``<root>/<name>/<key>=<number>`` (only those that hold ``marker``)."""
        hadoop = spark._jvm.org.apache.hadoop.fs
        pattern = hadoop.Path(f"{self.root}/{name}/{key}=*")
        fs = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
        found = {int(s.getPath().getName().split("=")[1]): s.getPath() for s in fs.globStatus(pattern) or []}
        return {n: p for n, p in found.items() if not marker or fs.exists(hadoop.Path(p, marker))}

    def read(self, spark: SparkSession) -> DataFrame:
        keys, values = [*self.by, *CELL_KEYS], self.VALUES
        base = self._folders(spark, "base", "upto", "_SUCCESS")
        upto = max(base, default=-1)
        frames = []
        if self._folders(spark, "log", "epoch"):
            frames.append(spark.read.parquet(f"{self.root}/log").where(F.col("epoch") > upto).select(*keys, *values, "epoch"))
        if base:
            frames.append(spark.read.parquet(base[upto].toString()).select(*keys, *values, F.lit(upto).cast("long").alias("epoch")))
        if not frames:  # nothing has arrived yet
            return spark.createDataFrame([], self.schema)
        log = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
        return self._folded(log.groupBy(*keys)).select(*keys, *values)

    def _folded(self, cells) -> DataFrame:
        """One row per cell: its latest total."""
        return cells.agg(F.max_by("amt", "epoch").alias("amt"))

    def compact(self, spark: SparkSession, upto: int) -> None:
        """Fold everything up to epoch ``upto`` into a new base, then remove what it replaces."""
        old = self._folders(spark, "base", "upto")
        self.read(spark).write.mode("overwrite").parquet(f"{self.root}/base/upto={int(upto)}")
        gone = [p for n, p in old.items() if n < upto] + [p for n, p in self._folders(spark, "log", "epoch").items() if n <= upto]
        for path in gone:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run_summary_stream(ledger_stream: DataFrame, root: str, kinds: Sequence[str] = KINDS,
                       by: Sequence[str] = (), trigger: dict | None = None,
                       on_start: Callable | None = None, compact_every: int = 50) -> CellTable:
    """Start the stream, process everything available, and return the table."""
    cells = running_cells(ledger_stream, kinds, by)
    table = CellTable(os.path.join(root, "cells"), by, compact_every, cells.schema)
    q = (cells.writeStream
         .outputMode("update")
         .option("checkpointLocation", os.path.join(root, "checkpoint"))
         .foreachBatch(table.merge)
         .trigger(**(trigger or {"availableNow": True}))
         .start())
    if on_start:
        on_start(q)
    q.awaitTermination()
    return table


def summary_from_cells(cells: DataFrame, kinds: Sequence[str] = KINDS,
                       by: Sequence[str] = ()) -> DataFrame:
    """A4 over the materialised running cells."""
    return summaries_from_stacked(cells, kinds, by)
