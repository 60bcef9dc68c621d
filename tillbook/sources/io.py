"""Sources and sinks: S1-S9, W1.

Canonical storage is one Hive-partitioned Parquet dataset per table
(``year=YYYY/month=M``) written with dynamic partition overwrite, so a
rebuild touches only the partitions it recomputes and readers get
partition pruning and predicate pushdown for free.

The application's own layout (``<root>/<year>/MM_detailed_expenses.parquet``
and ``<root>/<year>/<table>.parquet``) is read by path pattern; year and
month come from ``_metadata.file_path`` and files whose path does not parse
go to a rejects frame instead of failing the job.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.domains import DEFAULT_CURRENCY, INCOME_CATEGORIES, LEDGER_FILE_SUFFIX, MONTH_COLUMNS
from tillbook.operators.summaries import to_long
from tillbook.schemas import KNOWN_CATEGORIES_JSON, LEDGER, MAPPINGS_JSON, RECURRING
from tillbook.session import stored
from tillbook.sources.footers import FooterIndex, footers, scan_names

LEDGER_PARTITIONED = T.StructType(LEDGER.fields + [
    T.StructField("year", T.IntegerType()), T.StructField("month", T.IntegerType())])

# <root>/<year>/<MM>_detailed_expenses.parquet, optionally a directory of part files.
LEGACY_PATH_RE = r"/([^/]+)/([^/]+)" + LEDGER_FILE_SUFFIX.replace(".", r"\.") + r"(/[^/]+)?$"
YEAR_TABLE_RE = r"/([^/]+)/[^/]+\.parquet(/[^/]+)?$"


def _try_read(reader) -> DataFrame | None:
    """The frame, or None when the path (pattern) matches nothing."""
    try:
        return reader()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return None
        raise


def _read_or_empty(spark: SparkSession, schema: T.StructType, reader) -> DataFrame:
    df = _try_read(reader)
    return spark.createDataFrame([], schema) if df is None else df


# ---- S1, S6: canonical partitioned ledger ------------------------------------

def ledger_schema(by: Sequence[str] = (), by_type: T.DataType | None = None) -> T.StructType:
    """The stored ledger's schema: ``by`` columns, ``expense_id``, the ledger columns, year and month."""
    return T.StructType([*[T.StructField(c, by_type or T.LongType()) for c in by], T.StructField("expense_id", T.LongType()),
                         *LEDGER_PARTITIONED.fields])


def month_filter(months: Sequence[tuple[int, int]]) -> F.Column:
    """A partition filter for a bounded list of (year, month), by literals, so only their folders are read."""
    out = F.lit(False)
    for y in sorted({y for y, _ in months}):
        out = out | ((F.col("year") == int(y)) & F.col("month").isin(sorted({int(m) for yy, m in months if yy == y})))
    return out


def read_ledger(spark: SparkSession, root: str, year: int | None = None, month: int | None = None,
                schema: T.StructType = LEDGER_PARTITIONED, months: Sequence[tuple[int, int]] | None = None) -> DataFrame:
    """The ledger (or some months of it); a missing root is an empty table.

    ``year``/``month``/``months`` become partition filters, so only those folders are read.  ``schema`` names
    the stored columns (see ``ledger_schema`` for many ledgers with ids).
    """
    def load():
        df = spark.read.schema(schema).parquet(root)
        if months is not None:
            df = df.where(month_filter(months))
        if year is not None:
            df = df.where(F.col("year") == int(year))
        if month is not None:
            df = df.where(F.col("month") == int(month))
        return df
    return _read_or_empty(spark, schema, load)


def write_partitioned(df: DataFrame, root: str, partition_cols: Sequence[str] = ("year", "month"),
                      files_per_partition: int | None = None,
                      max_records_per_file: int = 5_000_000) -> None:
    """Overwrite only the partitions present in ``df`` (dynamic overwrite).

    By default there is no shuffle: each task writes its own files for the
    partitions it holds, capped at ``max_records_per_file`` rows, so a hot
    month (a third of all rows) is written by as many tasks as hold it.
    ``files_per_partition`` instead clusters each partition into that many
    hash buckets of the row (deterministic, so retries rewrite the same
    rows), spreading even one hot month over that many writers.
    """
    out = df
    if files_per_partition:
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(int(files_per_partition)))
        out = df.repartition(*[F.col(c) for c in partition_cols], salt)
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("maxRecordsPerFile", int(max_records_per_file))
     .partitionBy(*partition_cols).parquet(root))


def replace_months(df: DataFrame, root: str, months: Sequence[tuple[int, int]]) -> None:
    """The stored rows of the listed (year, month)s become those of ``df``; months without rows are emptied."""
    spark = df.sparkSession
    write_partitioned(df.where(month_filter(months)), root)
    left = {(r.year, r.month) for r in df.where(month_filter(months)).select("year", "month").distinct().toLocalIterator()}
    hadoop = spark._jvm.org.apache.hadoop.fs
    for y, m in set(months) - left:
        path = hadoop.Path(f"{root.rstrip('/')}/year={int(y)}/month={int(m)}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# ---- S2, S4, S5, W1: the application's own layout ---------------------------------

def parse_legacy_path(path_col: str = "_file") -> tuple:
    """(year, month, reason) columns from a legacy file path."""
    p = F.col(path_col)
    y_txt = F.regexp_extract(p, LEGACY_PATH_RE, 1)
    m_txt = F.regexp_extract(p, LEGACY_PATH_RE, 2)
    y = y_txt.try_cast("int")
    m = m_txt.try_cast("int")
    reason = (F.when(~p.rlike(LEGACY_PATH_RE), F.lit("file name does not match MM" + LEDGER_FILE_SUFFIX))
              .when(y.isNull(), F.lit("year directory is not a number"))
              .when(m.isNull(), F.lit("month prefix is not a number"))
              .when((m < 1) | (m > 12), F.lit("month out of range 1..12")))
    return y, m, reason


def upgrade_ledger(df: DataFrame) -> DataFrame:
    """Older files store ``expense_date`` as days since 1970 (bigint)."""
    if "expense_date" in df.columns and not isinstance(df.schema["expense_date"].dataType, T.DateType):
        dt = df.schema["expense_date"].dataType
        if isinstance(dt, (T.LongType, T.IntegerType)):
            df = df.withColumn("expense_date", F.date_from_unix_date(F.col("expense_date").cast("int")))
        else:
            df = df.withColumn("expense_date", F.col("expense_date").cast("date"))
    return df


def _driver_footer(spark: SparkSession, file: str) -> tuple[list[str], int]:
    """The stored columns and the rows of one file, for a store that only Spark's own file system reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(
        jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(file), conf))
    try:
        return [reader.getFooter().getFileMetaData().getSchema().toString()], int(reader.getRecordCount())
    finally:
        reader.close()


def _all_footers(spark: SparkSession, pattern: str, index: FooterIndex | None = None) -> DataFrame:
    """``(file, columns, rows)`` of the files of a path pattern; the driver reads the footers that Python in a task cannot open."""
    found = footers(spark, pattern, index).select("file", "columns", "rows")
    told = [(r.file, *_driver_footer(spark, r.file)) for r in found.where("columns IS NULL").select("file").toLocalIterator()]
    return found.where("columns IS NOT NULL").unionByName(spark.createDataFrame(told, found.schema)) if told else found


def _by_generation(spark: SparkSession, files: DataFrame) -> list[tuple[T.StructType, list[str]]]:
    """``(file, columns, ...)`` grouped by the stored schema.

    A legacy root is written by several generations of the application.  Footers (of a table that is a folder, every
    part file's: parts of a newer version may stand beside old ones) are read in tasks, and only of files that an index
    does not remember; each generation is then one scan.  Names of files come to the driver, which lists them for a scan anyway.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    for r in files.select("file", "columns").toLocalIterator():
        groups.setdefault(tuple(r.columns), []).append(r.file)
    return [(spark.read.parquet(min(paths)).schema, sorted(paths)) for _, paths in sorted(groups.items())]


def _generations(spark: SparkSession, pattern: str, index: FooterIndex | None = None) -> list[tuple[T.StructType, list[str]]]:
    """The files of a path pattern grouped by their stored schema."""
    return _by_generation(spark, _all_footers(spark, pattern, index))


def _scans(spark: SparkSession, generations: list[tuple[T.StructType, list[str]]]) -> list[DataFrame]:
    """One scan per file generation, with the files' paths and row numbers as ``_file`` and ``_row``."""
    return [spark.read.schema(schema).parquet(*paths)
            .select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
            for schema, paths in generations]


def _union(frames: list[DataFrame], empty: DataFrame) -> DataFrame:
    for f in frames:
        empty = empty.unionByName(f)
    return empty


def scan_legacy_ledger(spark: SparkSession, root: str, index: FooterIndex | None = None) -> tuple[DataFrame, DataFrame]:
    """S2 + S4 + S5 + W1: every ``<root>/<year>/MM_detailed_expenses.parquet``.

    Returns (ledger, rejects).  Ledger rows get ``year``, ``month`` from
    the path and a dense ``expense_id`` (0, 1, ... by month, file and the row's place in the file; see ``first_ids``),
    so ids exist before any filter.  Rows of unparsable paths are rejected
    with the path and a reason.  Files of several generations may be mixed: each generation is one scan,
    upgraded on its own; columns that it lacks are null.  ``index`` remembers footers between scans.

    What a path says is worked out once per file, and rows are counted by footers; each row then takes its file's year, month and
    first id by a broadcast join (the table of files is as long as the list that the driver holds for a scan), so no path is parsed per row.
    """
    schema = T.StructType([*LEDGER_PARTITIONED.fields, T.StructField("expense_id", T.LongType())])
    pattern = os.path.join(root, "*", "*" + LEDGER_FILE_SUFFIX)
    y, m, reason = parse_legacy_path("_file")
    files = stored(_all_footers(spark, pattern, index).join(scan_names(spark, pattern), "file")
                   .select("*", y.alias("year"), m.alias("month"), reason.alias("reason")), "layout-files")
    bad = files.where("reason IS NOT NULL AND rows > 0").select(F.col("_file").alias("file_path"), "reason", "rows")
    placed = files.where("reason IS NULL")
    good = [df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in LEDGER.fields], "_file", "_row")
            for df in map(upgrade_ledger, _scans(spark, _by_generation(spark, placed)))]
    if not good:
        return spark.createDataFrame([], schema), bad
    numbered = _union(good[1:], good[0]).join(F.broadcast(first_ids(placed)), "_file").withColumn("expense_id", F.col("first_id") + F.col("_row"))
    return numbered.select(*schema.fieldNames()), bad


def first_ids(sizes: DataFrame) -> DataFrame:
    """``(year, month, _file, first_id)`` from ``(year, month, _file, rows)``: how many rows lie in earlier months and in earlier files of the month.

    Row counts of whole files come from their footers; no column is read.  The prefix sums run over
    the files of a month, and over the months (as many as the ledger has months of history).
    """
    months = sizes.groupBy("year", "month").agg(F.sum("rows").alias("rows"))
    earlier = Window.orderBy("year", "month").rowsBetween(Window.unboundedPreceding, -1)
    before = months.select("year", "month", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    files = Window.partitionBy("year", "month").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    within = sizes.select("year", "month", "_file", F.coalesce(F.sum("rows").over(files), F.lit(0)).alias("within"))
    return within.join(before, ["year", "month"]).select("year", "month", "_file", (F.col("before") + F.col("within")).alias("first_id"))


def _write_layout(df: DataFrame, root: str, keys: list[str], folder_of) -> list[str]:
    """Write ``df`` with Spark's Parquet writer, one folder per key combination, under the layout's names.

    The rows go to a staging folder (``partitionBy``, explicit schema, job commit), so executors do all the
    writing and retries are safe.  Then the few finished folders take the place of the old ones by renames in the Hadoop
    file system, which move no data.  Folders that ``df`` has no rows for stay as they were.
    """
    spark = df.sparkSession
    staging = f"{root.rstrip('/')}/_staging-{uuid.uuid4().hex[:12]}"
    df.write.partitionBy(*keys).parquet(staging)
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(staging)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    moves = []
    for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path("/".join([staging, *[f"{k}=*" for k in keys]]))) or []:
        values = [part.split("=", 1)[1] for part in status.getPath().toString().split("/")[-len(keys):]]
        # a row without year or month has no place in the layout: int() raises before anything is moved
        moves.append((status.getPath(), jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{folder_of(*values)}")))
    for source, target in moves:
        fs.mkdirs(target.getParent())
        fs.delete(target, True)
        if not fs.rename(source, target):
            raise OSError(f"could not move {source} to {target}")
    fs.delete(base, True)
    return sorted(target.toString() for _, target in moves)


def write_legacy_layout(df: DataFrame, root: str) -> list[str]:
    """Write a ledger in the application's own layout, ``<root>/<year>/<MM>_detailed_expenses.parquet``
    (a folder of part files each).  Months in ``df`` replace what was stored for them; returns their paths."""
    return _write_layout(df, root, ["year", "month"], lambda y, m: f"{int(y)}/{int(m):02d}{LEDGER_FILE_SUFFIX}")


def write_year_tables(wide: DataFrame, root: str, filename: str) -> list[str]:
    """Write yearly tables in the application's layout, ``<root>/<year>/<filename>``; years in
    ``wide`` replace what was stored for them; returns their paths."""
    return _write_layout(wide, root, ["year"], lambda y: f"{int(y)}/{filename}")


def _year_frames(spark: SparkSession, root: str, filename: str, shape, index: FooterIndex | None = None) -> list[DataFrame]:
    """``shape`` applied to one scan per file generation, whose rows take the year of their file."""
    pattern = os.path.join(root, "*", filename)
    scans = _scans(spark, _generations(spark, pattern, index))
    if not scans:
        return []
    year = F.regexp_extract(F.col("_file"), YEAR_TABLE_RE, 1).try_cast("int")
    years = F.broadcast(stored(scan_names(spark, pattern).select("_file", year.alias("year")), "file-years"))
    return [shape(df.drop("year").join(years, "_file", "left")) for df in scans]


def read_year_table(spark: SparkSession, root: str, filename: str, ids: Sequence[str], value: str,
                    index: FooterIndex | None = None) -> DataFrame:
    """S3 + S4 + R2: a yearly wide table from every ``<root>/<year>/<filename>``,
    upgraded and turned long: ``(ids..., year, month, value)``.

    Each file generation is upgraded on its own: holdings/prices without ``link`` get ""; liquidity and
    credits without ``currency`` get the default; a leftover ``type``
    column is dropped.  A missing table is empty.
    """
    defaults = {"link": "", "currency": DEFAULT_CURRENCY}

    def shape(df: DataFrame) -> DataFrame:
        def one(c):
            return F.col(c).cast("string") if c in df.columns else F.lit(defaults.get(c)).cast("string")
        months = [(F.col(c) if c in df.columns else F.lit(None)).cast("double").alias(c) for c in MONTH_COLUMNS]
        return to_long(df.select(*[one(c).alias(c) for c in ids], "year", *months), [*ids, "year"], value=value)

    empty = spark.createDataFrame([], T.StructType(
        [T.StructField(c, T.StringType()) for c in ids] + [T.StructField("year", T.IntegerType()),
         T.StructField("month", T.IntegerType()), T.StructField(value, T.DoubleType())]))
    return _union(_year_frames(spark, root, filename, shape, index), empty)


def read_summary_table(spark: SparkSession, root: str, filename: str, kind: str) -> DataFrame:
    """S3 for the yearly summaries, whose month columns are named ``YYYY-MM``: ``(<kind>_category, year, month, amount)``."""
    cat = f"{kind}_category"

    def shape(df: DataFrame) -> DataFrame:
        months = [c for c in df.columns if re.fullmatch(r"[0-9]{4}-[0-9]{2}", c)]
        if not months:
            return df.select(F.col(cat), F.lit(None).cast("int").alias("year"), F.lit(None).cast("int").alias("month"),
                             F.lit(None).cast("double").alias("amount")).where(F.lit(False))
        cells = df.select(cat, *[F.col(f"`{c}`").cast("double").alias(c) for c in months]).unpivot([cat], months, "_label", "amount")
        # one generation's scan covers several years; a file has only its own year's columns
        return cells.select(cat, F.substring("_label", 1, 4).cast("int").alias("year"), F.substring("_label", 6, 2).cast("int").alias("month"), "amount")

    return _union(_year_frames(spark, root, filename, shape),
                  spark.createDataFrame([], f"{cat} string, year int, month int, amount double"))


def read_recurring(spark: SparkSession, root: str, filename: str = "recurring_expenses.parquet") -> DataFrame:
    """S3 for the recurring templates (long form): ``(year, <template columns>)``; missing columns are null."""
    schema = T.StructType([T.StructField("year", T.IntegerType()), *RECURRING.fields])

    def shape(df: DataFrame) -> DataFrame:
        return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])

    return _union(_year_frames(spark, root, filename, shape), spark.createDataFrame([], schema))


def read_cashflow(spark: SparkSession, root: str, years: Sequence[int], filename: str = "cashflow.parquet") -> DataFrame:
    """S3: the income table, ``(category, year, month, value)``: a wanted year without a file has zeros."""
    found = read_year_table(spark, root, filename, ["category"], "value")
    spark_years = spark.createDataFrame([(int(y),) for y in years], "year int")
    lacking = spark_years.join(found.select("year").distinct(), "year", "left_anti")
    zeros = lacking.select(F.explode(F.array(*[F.lit(c) for c in INCOME_CATEGORIES])).alias("category"), "year") \
        .select("category", "year", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"), F.lit(0.0).alias("value"))
    return found.unionByName(zeros)


# ---- S7 ---------------------------------------------------------------------------

def discover_years(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Years with data plus the current year, ascending."""
    cur = df.select(*by).distinct().withColumn("year", F.year(F.current_date())) if by else \
        df.sparkSession.range(1).select(F.year(F.current_date()).alias("year"))
    return (df.select(*by, "year").unionByName(cur).distinct().orderBy(*by, "year"))


def listed_months(spark: SparkSession, root: str) -> DataFrame:
    """``(year, month)`` of the partition folders of a ledger under ``root``; no file is opened.

    A month whose rows have all gone has no folder (``replace_months``), and there are as many folders as months of
    history, whatever the rows; rows without a year or month are in no month.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/year=*/month=*")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    names = [[p.split("=", 1)[1] for p in s.getPath().toString().split("/")[-2:]] for s in found]
    return spark.createDataFrame([(int(y), int(m)) for y, m in names if y.isdigit() and m.isdigit()], "year int, month int")


# ---- S8, S9: JSON configuration ------------------------------------------------------

def read_mappings_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON objects ``name -> {primary_category, secondary_category}``; the file name becomes ``source``.

    A file holds one object over several lines (the application's form, ``wholetext``) or one object per line (the
    form written here): a line that is not an object by itself sends its file, and no other, to the first reading.
    A missing path is an empty table."""
    lines = _try_read(lambda: spark.read.text(path))
    if lines is None:
        return spark.createDataFrame([], "source string, name_key string, primary_category string, "
                                         "secondary_category string")
    extra = [c for c in lines.columns if c != "value"]  # partition columns, if any
    text, file = F.trim("value"), F.col("_metadata.file_path")
    broken = lines.where(~(text.startswith("{") & text.endswith("}")) & (text != "")).select(file.alias("file")).distinct()
    whole = [unquote(r.file) for r in broken.toLocalIterator()]  # names of files, which the driver lists for every scan anyway
    raw = lines.select("value", *extra, F.col("_metadata.file_name").alias("source"), file.alias("file"))
    if whole:
        once = stored(broken, "files-read-whole")
        texts = spark.read.option("basePath", path).text(whole, wholetext=True)
        raw = raw.join(once, "file", "left_anti").drop("file").unionByName(
            texts.select("value", *extra, F.col("_metadata.file_name").alias("source")))
    parsed = raw.select(*extra, "source", F.explode(F.from_json("value", MAPPINGS_JSON)).alias("name_key", "m"))
    return parsed.select(*extra, "source", "name_key", "m.primary_category", "m.secondary_category")


def read_known_categories_json(spark: SparkSession, path: str) -> DataFrame:
    """``{"primary": [...], "secondary": [...]}`` -> ``(source, kind, category)``;
    a missing key is an empty list."""
    raw = _try_read(lambda: spark.read.text(path, wholetext=True))
    if raw is None:
        return spark.createDataFrame([], "source string, kind string, category string")
    extra = [c for c in raw.columns if c != "value"]
    parsed = raw.select(*extra, F.col("_metadata.file_name").alias("source"),
                        F.from_json("value", KNOWN_CATEGORIES_JSON).alias("j"))
    entries = F.array(
        F.struct(F.lit("primary").alias("kind"), F.coalesce("j.primary", F.array().cast("array<string>"))
                 .alias("names")),
        F.struct(F.lit("secondary").alias("kind"), F.coalesce("j.secondary", F.array().cast("array<string>"))
                 .alias("names")))
    return (parsed.select(*extra, "source", F.inline(entries))
            .select(*extra, "source", "kind", F.explode("names").alias("category")))


def mappings_to_json(mappings: DataFrame, by: Sequence[str], entries: int = 10_000) -> DataFrame:
    """S8 writer side: JSON object texts per ledger (``by``), keys sorted, of about ``entries`` entries each.

    The reader takes any number of objects per ledger, one per line, so no ledger is gathered whole: its
    names are dealt over as many objects as their number asks for.
    """
    if not by:
        raise ValueError("mappings_to_json needs `by`: JSON objects belong to a ledger")
    entry = F.struct(F.col("name_key").alias("key"),
                     F.struct("primary_category", "secondary_category").alias("value"))
    sizes = mappings.groupBy(*by).agg(F.ceil(F.count("*") / entries).cast("int").alias("_objects"))
    return (mappings.join(sizes, list(by)).groupBy(*by, F.pmod(F.xxhash64("name_key"), F.col("_objects").cast("long")).alias("_object"))
            .agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("value")).drop("_object"))
