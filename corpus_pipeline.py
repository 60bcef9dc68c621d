"""A cleaning pipeline over ``documents``: each stage calls one operator and works on all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.llm import decontaminate, quality, simhash, substring
from tillbook.llm.common import stored, table
from tillbook.llm.queries import encoded


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a quality score of at least the threshold."""
    scored = quality.classify(docs, table(spark, sf_dir, "labels"))
    return scored.where(F.col("score") >= quality.THRESHOLD).select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component: three-word shingles, at most two differing bits."""
    return simhash.one_of_each(docs, shingle=3, radius=2)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; texts with repeated passages keep the other words, joined by spaces.  Other texts stay as they are."""
    found = substring.dedup_substrings(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    columns = [(text if c == "text" else F.length(text).cast(t) if c == "n_chars" else F.col(f"row.`{c}`")).alias(c) for c, t in docs.dtypes]
    return found.select(*columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a word inside a benchmark passage."""
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row's text."""
    return encoded(docs)


STAGES = [("quality_classifier", quality_classifier), ("simhash_near_dedup", simhash_near_dedup), ("substring_dedup", substring_dedup),
          ("benchmark_decontamination", benchmark_decontamination), ("bpe_encoding", bpe_encoding)]

#: Kernel scores, SimHash components and token ids are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
