"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are turned by fast pseudo-rotations (random signs and a Hadamard
transform, three times) and hashed to the nearest signed axis.  A query probes, in each of several
tables, the axes nearest to it, and everything in those buckets is ranked exactly.

Vectors are hashed by their directions, so what is found does not depend on the spread of their lengths:
no long vector moves the others to other buckets.  Lengths count again in the exact scores.

Bands of like lengths with no more vectors than a table has axes (the longest vectors, tiny tables) leave buckets of
one vector or none, so queries probe them to the end.  A query with fewer results than asked for meets all vectors of its dimension.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored

TABLES = 5
PROBES = 40
#: Axes joined into one bucket name; more of them make smaller buckets for larger tables.
AXES = 1
BLOCK_ROWS = 4096
#: A band of as many vectors, one for each signed axis of 128 dimensions, is probed to its end; larger ones are hashed.
SPARSE_BAND = 256
#: Ratio of the largest to the smallest length in a band.
BAND = 1.25


def hadamard(x: np.ndarray) -> np.ndarray:
    n, step = x.shape[1], 1
    while step < n:
        y = x.reshape(len(x), n // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        step *= 2
    return x / np.sqrt(n)


def lifted(x: np.ndarray) -> np.ndarray:
    """Directions (unit vectors) in a power-of-two dimension."""
    out = np.zeros((len(x), 1 << int(x.shape[1]).bit_length()))
    x = x / np.abs(x).max(1, keepdims=True)  # squares of very large or small numbers leave the range
    out[:, :x.shape[1]] = x / np.linalg.norm(x, axis=1, keepdims=True)
    return out


def axis_scores(x: np.ndarray, table: int, part: int) -> np.ndarray:
    """Scores of the 2 * width signed axes: entry 2 i is axis +i, entry 2 i + 1 axis -i."""
    rng = np.random.default_rng([11, table, part, x.shape[1]])
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], x.shape[1]))
    return np.stack([x, -x], axis=2).reshape(len(x), -1)


def buckets(x: np.ndarray, table: int, axes: int, probes: int) -> np.ndarray:
    """The ``probes`` best bucket numbers of each vector, best first."""
    n = 2 * x.shape[1]
    probes = min(probes, n**axes)
    names, scores = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for part in range(axes):
        s = axis_scores(x, table, part)
        best = np.argsort(-s, axis=1, kind="stable")[:, :probes]
        value = np.take_along_axis(s, best, 1)
        names = (names[:, :, None] * n + best[:, None, :]).reshape(len(x), -1)
        scores = (scores[:, :, None] + value[:, None, :]).reshape(len(x), -1)
        order = np.argsort(-scores, axis=1, kind="stable")[:, :probes]
        names, scores = np.take_along_axis(names, order, 1), np.take_along_axis(scores, order, 1)
    return names


def _matrix(col, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.flatten(), dtype=np.float64).reshape(-1, dim)


def _hash_batches(tables: int, axes: int, probes: int, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch["dim"])
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = lifted(_matrix(part["vector"], int(dim)))
                for table in range(tables):
                    names = buckets(x, table, axes, probes)
                    who = pa.array(np.repeat(np.arange(len(x)), names.shape[1]))
                    yield pa.RecordBatch.from_arrays(
                        [*[part[c].take(who) for c in columns], pa.array(np.full(names.size, table, np.int32)), pa.array(names.ravel())],
                        [*columns, "tbl", "bucket"])
    return run


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added coordinate by coordinate, so equal vectors score alike wherever they stand."""
    out = np.zeros((len(q), len(x)))
    for k in range(q.shape[1]):
        out += q[:, k, None] * x[None, :, k]
    return out


def _rank(keep: int):
    schema = pa.schema([("q1", pa.int64()), ("q2", pa.int32()), ("k1", pa.int64()), ("k2", pa.int32()), ("low", pa.int64()), ("score", pa.float64())])

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return schema.empty_table()
        dim = asked["dim"][0].as_py()
        x, low = _matrix(held["vector"], dim), np.asarray(held["low"])
        out = []
        for k in range(0, asked.num_rows, 512):
            part = asked.slice(k, 512)
            s = exact_scores(_matrix(part["vector"], dim), x)
            least = np.partition(s, -keep, axis=1)[:, -keep] if s.shape[1] > keep else s.min(1)
            row, col = np.nonzero(s >= least[:, None])
            order = np.lexsort((low[col], -s[row, col], row))
            row, col = row[order], col[order]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            row, col = row[nth < keep], col[nth < keep]
            out.append(pa.Table.from_arrays(
                [part["q1"].take(pa.array(row)), part["q2"].take(pa.array(row)), held["k1"].take(pa.array(col)), held["k2"].take(pa.array(col)),
                 pa.array(low[col]), pa.array(s[row, col])], schema=schema))
        return pa.concat_tables(out)
    return run


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector, dim, k1, k2, length): rows with an id and a non-zero vector of finite numbers; k1, k2 name the vector.

    ``length`` is the logarithm of the vector's norm.
    """
    v = F.col("vector")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    most = F.array_max(F.transform(v, F.abs))
    length = F.log("most") + F.log(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x / F.col("most")) * (x / F.col("most")))) / 2
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(fine, F.lit(False))).withColumn("most", most) \
        .select("vec_id", "vector", F.size(v).alias("dim"), F.xxhash64(v).alias("k1"), F.hash(v).alias("k2"), length.alias("length"))


def _met(probed: DataFrame, held: DataFrame, keep: int) -> DataFrame:
    """(q1, q2, k1, k2, low, score): for each query its ``keep`` best in each block of the buckets that it probes."""
    # a bucket is cut into blocks of bounded size; its queries go to each of them
    bucket = ["dim", "tbl", "bucket"]
    sizes = stored(held.groupBy(*bucket).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")), "bucket-blocks")
    loads = probed.groupBy(*bucket).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("asks"))
    plan = stored(sizes.join(loads, bucket), "bucket-plan")
    n = plan.count()
    key = [*bucket, "block", "ask"]
    left = probed.join(small(plan, n, 40), bucket).withColumns(
        {"block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "ask": F.pmod(F.xxhash64("q1", "q2"), F.col("asks").cast("long")).cast("int")})
    right = held.join(small(plan, n, 40), bucket).withColumns(
        {"block": F.pmod(F.xxhash64("k1", "k2"), F.col("blocks").cast("long")).cast("int"), "ask": F.explode(F.sequence(F.lit(0), F.col("asks") - 1))})
    return left.select("q1", "q2", "vector", *key).groupBy(*key).cogroup(right.select("k1", "k2", "low", "vector", *key).groupBy(*key)) \
        .applyInArrow(_rank(keep), "q1 long, q2 int, k1 long, k2 int, low long, score double")


def _whole(df: DataFrame, number) -> DataFrame:
    """Rows in a bucket of their own, beside those of the tables."""
    return df.withColumns({"tbl": F.lit(-1), "bucket": number.cast("long")})


def nearest(vectors: DataFrame, is_query, k: int = 20, tables: int = TABLES, probes: int = PROBES, axes: int = AXES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where ``is_query`` (over vec_id) holds its ``k`` best other rows.

    The measure is the inner product of the original vectors in double precision, ties to the smaller vec_id.  Rows without an id, and
    null, empty or zero vectors or those with null or non-finite numbers, take no part; vectors meet
    only those of their dimension; repeated rows count once and a row never finds its own id.  Equal
    vectors are hashed and scored once, by at most k + 1 of their ids, which is all that k results can show.
    All candidates are returned if there are fewer than ``k``.  Other columns are not read.
    """
    rows = stored(usable(vectors).dropDuplicates(["k1", "k2", "vec_id"]), "vectors")
    inside = Window.partitionBy("k1", "k2").orderBy("vec_id")
    members = rows.withColumn("nth", F.row_number().over(inside)).where(F.col("nth") <= k + 1)
    tops = stored(rows.groupBy("dim").agg(F.max("length").alias("top")), "vector-tops")
    band = F.floor((F.col("top") - F.col("length")) / math.log(BAND) + 1e-9).cast("int")
    kinds = members.where("nth = 1").join(small(tops, tops.count(), 16), "dim") \
        .select("k1", "k2", "dim", "vector", F.col("vec_id").alias("low"), band.alias("band"))
    kinds = stored(kinds, "vector-kinds")
    bands = stored(kinds.groupBy("dim", "band").agg(F.count("*").alias("n")), "vector-bands")
    n_bands = bands.count()
    dense = F.col("n") > min(SPARSE_BAND, BLOCK_ROWS)
    few = small(bands.where(~dense).select("dim", "band"), n_bands, 12)
    many = small(bands.where(dense).select("dim", "band"), n_bands, 12)
    hashed_dims = small(bands.where(dense).select("dim").distinct(), n_bands, 8)
    queries = rows.where(is_query).select("vec_id", F.col("k1").alias("q1"), F.col("k2").alias("q2"), "dim", "vector")
    asked = queries.groupBy("q1", "q2").agg(F.first("dim").alias("dim"), F.first("vector").alias("vector"))

    row = ["dim", "vector", "tbl", "bucket"]
    held = kinds.join(many, ["dim", "band"], "left_semi").select("k1", "k2", "low", "dim", "vector").mapInArrow(
        _hash_batches(tables, axes, 1, ["k1", "k2", "low", "dim", "vector"]),
        "k1 long, k2 int, low long, dim int, vector array<double>, tbl int, bucket long")
    held = held.unionByName(_whole(kinds.join(few, ["dim", "band"], "left_semi"), F.col("band")).select("k1", "k2", "low", *row))
    probed = asked.join(hashed_dims, "dim", "left_semi").select("q1", "q2", "dim", "vector").mapInArrow(
        _hash_batches(tables, axes, probes, ["q1", "q2", "dim", "vector"]),
        "q1 long, q2 int, dim int, vector array<double>, tbl int, bucket long")
    probed = probed.unionByName(_whole(asked.join(few, "dim"), F.col("band")).select("q1", "q2", *row))

    def results(found: DataFrame) -> DataFrame:
        best = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "low", "k1", "k2")
        kept = found.dropDuplicates(["q1", "q2", "k1", "k2"]).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
        each = queries.select(F.col("vec_id").alias("query_id"), "q1", "q2").join(kept.select("q1", "q2", "k1", "k2", "score"), ["q1", "q2"]) \
            .join(members.select("k1", "k2", "vec_id"), ["k1", "k2"]).where("vec_id != query_id")
        order = Window.partitionBy("query_id", "q1", "q2").orderBy(F.desc("score"), "vec_id")
        return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "q1", "q2")

    columns = ["query_id", "rank", "vec_id", "score"]
    first = results(_met(probed, held, k + 1))
    if not bands.where(dense).count():
        return first.select(*columns)
    first = stored(first, "first-results")
    # queries of hashed dimensions that got fewer than k go on to all vectors of their dimension
    full = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), "q1", "q2")
    short = queries.join(hashed_dims, "dim", "left_semi").join(full, ["vec_id", "q1", "q2"], "left_anti") \
        .groupBy("q1", "q2").agg(F.first("dim").alias("dim"), F.first("vector").alias("vector"))
    short = stored(short, "short-queries")
    n_short = short.count()
    if not n_short:
        return first.select(*columns)
    rest = kinds.join(small(short.select("dim").distinct(), n_short, 8), "dim", "left_semi")
    again = results(_met(_whole(short, F.lit(0)), _whole(rest, F.lit(0)), k + 1))
    return first.join(small(short.select("q1", "q2"), n_short, 16), ["q1", "q2"], "left_anti").select(*columns).unionByName(again.select(*columns))
