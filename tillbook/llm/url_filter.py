"""URL verdicts: host and path rules, then a blocked Bloom filter backed by an exact join (DataFrame functions only).

The filter is a table with one row of 256 bits per block.  A URL's hash picks
one block and eight bits in it, so a probe reads one row.  Rows that pass are
checked by an exact hash join with the list, which removes false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small

BITS_PER_KEY = 16
BLOCK_BITS = 256
WORDS = 4
#: (host, path, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]
UPPER, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lowered; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOW), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading www. or m., path without .html or trailing slashes; scheme, query and fragment go."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(\.html|/+)$", ""))


def fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    return ((host == rule[0]) | host.endswith("." + rule[0])) & path.startswith(rule[1])


def longest_rule(host: Column, path: Column, rules, value) -> Column:
    """``value(rule)`` of the longest fitting rule, null without one."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    return F.coalesce(*[F.when(fits(host, path, r), F.lit(value(r))) for r in ordered], F.lit(None).cast("string"))


def with_bits(df: DataFrame, key: str, blocks: int) -> DataFrame:
    """Adds the block number and the four 64-bit masks (two bits each) of a key."""
    spread = F.xxhash64(F.lit("bits"), F.col(key))

    def bit(i: int) -> Column:
        return F.shiftright(spread, 6 * i).bitwiseAND(F.lit(63)).cast("int")

    def one(i: int) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), bit(i))

    return df.withColumns({"block": F.pmod(F.xxhash64(F.col(key)), F.lit(blocks).cast("long"))}
                          | {f"m{w}": one(2 * w).bitwiseOR(one(2 * w + 1)) for w in range(WORDS)})


def build_filter(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    return with_bits(listed, key, blocks).groupBy("block").agg(*[F.bit_or(f"m{w}").alias(f"w{w}") for w in range(WORDS)])


def judge(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, canonical_url, listed for every row of ``pages``.

    ``listed`` has a column canonical_url (repeats and nulls are ignored).  A page without a fitting rule is blocked
    when its canonical URL is listed, else allowed.  A null url has empty host and path.  Equal urls get
    equal verdicts; other columns are not read; an empty list blocks nothing.
    """
    listed = listed.where(F.col("canonical_url").isNotNull() & (F.col("canonical_url") != "")).select("canonical_url").distinct()
    size = listed.count()
    blocks = max(1, -(-size * BITS_PER_KEY // BLOCK_BITS))
    bloom = build_filter(listed, "canonical_url", blocks)

    host, path = F.col("host"), F.col("path")
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parsed = parsed.withColumns({"rule": longest_rule(host, path, rules, lambda r: r[0] + r[1]),
                                 "by_rule": longest_rule(host, path, rules, lambda r: r[2]),
                                 "canonical_url": canonical(host, path)})
    # the filter has at most one row of 40 bytes per block: broadcast while that fits, else joined by block
    probed = with_bits(parsed, "canonical_url", blocks).join(small(bloom, blocks, 64), "block", "left")
    passes = F.lit(True)
    for w in range(WORDS):
        passes = passes & F.coalesce(F.col(f"w{w}").bitwiseAND(F.col(f"m{w}")) == F.col(f"m{w}"), F.lit(False))
    keep = ["page_id", "host", "path", "rule", "by_rule", "canonical_url"]
    probed = probed.select(*keep, passes.alias("possible"))
    misses = probed.where(~F.col("possible")).select(*keep, F.lit(False).alias("listed"))
    exact = listed.withColumn("listed", F.lit(True))
    hits = probed.where("possible").join(small(exact, size, 200), "canonical_url", "left") \
        .select(*keep, F.coalesce("listed", F.lit(False)).alias("listed"))
    return misses.unionByName(hits).select(
        "page_id", "host", "path", "rule",
        F.coalesce("by_rule", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        "canonical_url", "listed")


def listed_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The list used by the registered query: canonical URLs of pages on a ``spam`` host, and of pages that
    carry (in their path's number) a document labelled toxic."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    urls = pages.select(canonical(host, path).alias("canonical_url"), host.alias("host"),
                        F.regexp_extract(path, "/([0-9]+)", 1).try_cast("bigint").alias("number"))
    toxic = labels.where("toxic = 1").select(F.col("doc_id").cast("bigint").alias("number")).distinct()
    spam = urls.where(F.col("host").contains("spam")).select("canonical_url")
    return spam.unionByName(urls.join(toxic, "number", "left_semi").select("canonical_url"))
