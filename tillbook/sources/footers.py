"""Footers of Parquet files, read in tasks and remembered by file.

The driver opens no file here: Spark lists the files, tasks read the footers of those that are not
remembered yet, and the table of footers tells which files were stored alike and how many rows they hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.session import stored

#: What tells one state of a file from another.
FILE = ["file", "length", "modified"]
FOOTERS = "file string, length long, modified timestamp, columns array<string>, rows long"


def _listed(spark: SparkSession, pattern: str, columns: list[Column], schema: str) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    try:
        found = reader.load(pattern)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return spark.createDataFrame([], schema)
        raise
    return found.select(*columns)


def listed_files(spark: SparkSession, pattern: str) -> DataFrame:
    """``(file, length, modified)`` of the Parquet files that a path pattern names, or that lie in folders it names.

    Listed by Spark (in a job of its own when folders are many); hidden files do not count and a pattern that
    matches nothing has no files.  The files' contents are not read.
    """
    columns = [F.col("path").alias("file"), F.col("length"), F.col("modificationTime").alias("modified")]
    return _listed(spark, pattern, columns, "file string, length long, modified timestamp")


def scan_names(spark: SparkSession, pattern: str) -> DataFrame:
    """``(file, _file)`` of the same files: their names as listed and as a scan's ``_metadata.file_path`` has them (URL-encoded)."""
    return _listed(spark, pattern, [F.col("path").alias("file"), F.col("_metadata.file_path").alias("_file")], "file string, _file string")


def _file_system(path: str):
    """The store of a path and the path in it; no store when only Spark can read it."""
    from pyarrow import fs
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    try:
        return fs.FileSystem.from_uri(quote(path, safe=":/@"))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None, path


def _footers_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds what each file's footer says: its columns with their stored types, and its rows."""
    import pyarrow.parquet as pq
    for batch in batches:
        columns, rows = [], []
        for path in batch.column(0).to_pylist():
            store, name = _file_system(path)
            if store is None:
                columns.append(None)
                rows.append(None)
                continue
            with store.open_input_file(name) as f:
                meta = pq.read_metadata(f)
            leaves = [meta.schema.column(i) for i in range(meta.num_columns)]
            columns.append([f"{c.path} {c.physical_type} {c.logical_type}" for c in leaves])
            rows.append(meta.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(columns, pa.list_(pa.string())), pa.array(rows, pa.int64())],
                                         names=[*FILE, "columns", "rows"])


def read_footers(files: DataFrame) -> DataFrame:
    """The footers of the listed files, one task opening the files it was dealt; ``columns`` and ``rows`` are null for
    files in a store that Python cannot open."""
    return files.select(*FILE).mapInArrow(_footers_of, FOOTERS)


class FooterIndex:
    """Footers remembered in a table under ``path``.

    A file is opened once; again only when its length or time of change differs.  Files that are
    gone, or have changed since, stay in the table but are never returned.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def remembered(self) -> DataFrame:
        try:
            known = self.spark.read.schema(FOOTERS).parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], FOOTERS)
        return known.dropDuplicates(FILE)  # two refreshes at a time may both add a file

    def footers(self, pattern: str) -> DataFrame:
        """The footers of the files that the pattern matches now, after adding those not remembered."""
        now = stored(listed_files(self.spark, pattern), "files-now")
        new = now.join(self.remembered(), FILE, "left_anti")
        if not new.isEmpty():
            read_footers(new).write.mode("append").parquet(self.path)
        return now.join(self.remembered(), FILE)


def footers(spark: SparkSession, pattern: str, index: FooterIndex | None = None) -> DataFrame:
    """The footers of the files a pattern matches, as ``FOOTERS``; with an index only of files it lacks are opened."""
    return index.footers(pattern) if index else stored(read_footers(listed_files(spark, pattern)), "footers")
