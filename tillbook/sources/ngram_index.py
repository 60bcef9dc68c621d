"""P1-P2 by a skipping index: which files of a ledger can hold a text, told by its character trigrams.

The index is a table (column, gram, file) of the distinct trigrams of each file's lower-cased texts, sorted by gram, so a
search reads a few row groups of it.  A file whose texts lack one trigram of the searched term cannot
hold the term; the others are read and searched as always, so results are those of a whole scan.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.operators.filters import search_ledger
from tillbook.session import stored
from tillbook.sources.io import _read_or_empty

GRAM = 3
SEARCHED = ("expense_name", "primary_category", "secondary_category")
ENTRIES = "column string, gram string, file string"


def _grams(text):
    """The distinct character trigrams of a lower-cased text; none for shorter and null texts."""
    low = F.lower(text)
    last = F.char_length(low) - GRAM + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(low, i, F.lit(GRAM)))))


def _name(path: str) -> str:
    """One spelling of a file's path: Spark lists local files with three slashes and names them in rows with one."""
    return re.sub("^file:/+", "file:/", unquote(path))


class NgramIndex:
    """The trigrams of the files of a ledger stored under ``data`` (Parquet, with or without partition folders), kept under ``root``."""

    def __init__(self, spark: SparkSession, data: str, root: str, schema: T.StructType, columns: Sequence[str] = SEARCHED):
        self.spark, self.data, self.root, self.schema, self.columns = spark, data, root.rstrip("/"), schema, list(columns)

    def _stored_files(self) -> dict[str, str]:
        """Name -> path of the files that the ledger has now; the driver lists them for every scan anyway."""
        frame = _read_or_empty(self.spark, self.schema, lambda: self.spark.read.schema(self.schema).parquet(self.data))
        return {_name(f): f for f in frame.inputFiles()}

    def _known(self) -> DataFrame:
        return _read_or_empty(self.spark, T.StructType.fromDDL("file string"), lambda: self.spark.read.schema("file string").parquet(f"{self.root}/files"))

    def _entries(self) -> DataFrame:
        return _read_or_empty(self.spark, T.StructType.fromDDL(ENTRIES), lambda: self.spark.read.schema(ENTRIES).parquet(f"{self.root}/grams"))

    def _rows(self, files: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).option("basePath", self.data).parquet(*files) if files else self.spark.createDataFrame([], self.schema)

    def refresh(self) -> int:
        """Index the files that have come since the last call; returns how many.  Files are written once and never changed.

        A file counts as indexed only when its trigrams are stored, so a refresh that fails is simply repeated
        (an entry may then be stored twice, which changes no search).
        """
        indexed = {r.file for r in self._known().toLocalIterator()}
        new = {name: path for name, path in self._stored_files().items() if name not in indexed}
        if not new:
            return 0
        rows = self._rows([unquote(p) for p in new.values()])
        path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        file = F.regexp_replace(path, "^file:/+", "file:/").alias("file")
        # spellings repeat: they are made distinct before they are cut into trigrams
        texts = rows.select(file, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lower(c).alias("text")) for c in self.columns]))).distinct()
        entries = texts.select("column", F.explode(_grams(F.col("text"))).alias("gram"), "file").distinct()
        # by gram and file: a gram that all files have is spread over several tasks
        entries.repartitionByRange("column", "gram", "file").sortWithinPartitions("column", "gram").write.mode("append").parquet(f"{self.root}/grams")
        self.spark.createDataFrame([(n,) for n in new], "file string").coalesce(1).write.mode("append").parquet(f"{self.root}/files")
        return len(new)

    def _holding(self, columns: Sequence[str], term: str) -> DataFrame | None:
        """The indexed files in which one of the columns has all trigrams of the term; None: the term has no trigram."""
        grams = [r.g for r in self.spark.range(1).select(F.explode(_grams(F.lit(term))).alias("g")).collect()]
        if not grams:
            return None
        hit = self._entries().where(F.col("column").isin(list(columns)) & F.col("gram").isin(grams))
        return hit.groupBy("column", "file").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).select("file").distinct()

    def files(self, name: str | None = None, category: str | None = None) -> list[str]:
        """The files that a search must read: those with all trigrams, and those that are not indexed yet."""
        now = self._stored_files()
        asked = [x for x in (self._holding(["expense_name"], name) if name else None,
                             self._holding(["primary_category", "secondary_category"], category) if category else None) if x is not None]
        if not asked:
            return sorted(map(unquote, now.values()))
        known = stored(self._known(), "indexed-files")
        possible = known
        for hit in asked:
            possible = possible.join(hit, "file", "left_semi")
        ruled_out = {r.file for r in known.join(possible, "file", "left_anti").toLocalIterator()}
        return sorted(unquote(path) for name, path in now.items() if name not in ruled_out)

    def search(self, name: str | None = None, category: str | None = None, amount_min: float | None = None, amount_max: float | None = None) -> DataFrame:
        """P1-P3 over the files that can hold the terms; rows as ``search_ledger`` gives them over all files."""
        return search_ledger(self._rows(self.files(name, category)), name, category, amount_min, amount_max)
