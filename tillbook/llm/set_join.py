"""N-gram Jaccard join: documents whose sets of word shingles are alike, by a size-aware heavy-light join.

Equal sets are handled once.  Sets that share too few of their first shingles (in hash order) with any other set are
ruled out first; what stays is counted exactly and its shingles are ordered from rare to common.

Light sets (up to a size chosen by cost) are joined by enumerating their subsets: two sets of sizes a and b that
are alike share c(a, b) shingles, so they have a subset of that size in common, and meet under its name.
Heavy sets are joined by scanning the inverted lists of their first shingles, from the rarest on.  Every list is
scanned twice: neighbours in it are compared first; then, in lists whose members do not yet hang together,
all pairs of different components whose sizes, places in the lists and parity sketches leave enough room for a link.
Links are checked on the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U, blocks, mix, powers, scan_words, shuffle_width, signed, small, stored, text_batches, text_key, unsigned
from .components import components

SHINGLE, PERCENT = 5, 80
#: Largest size that subsets may be enumerated for; the boundary is chosen below it.
LIGHT_MOST = 16
#: Entries of a bucket and of a task before they are sent on, in the first filter.
BUCKET_ROWS, HELD_ROWS = 1 << 20, 1 << 21
#: Members of a list that are compared in one place; longer lists are cut into parts.
LIST_ROWS = 4096
#: Pairs made at a time.
PAIRS = 1 << 18
_LANES = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F))
_SIGNS = 4
#: Bits of a set's parity sketch: sketches of two sets differ in no more bits than the sets differ in shingles.
SKETCH = 512


def fewest(size, percent):
    """Smallest size of a partner, which is also the fewest shingles shared with any partner."""
    return (percent * size + 99) // 100


def overlap(a, b, percent):
    """Fewest shared shingles of a link between sets of a and b shingles."""
    return (percent * (a + b) + 99 + percent) // (100 + percent)


def _extra(size):
    """Shingles beyond the first that the first filter asks for."""
    return np.maximum(1, size // 10)


def shingle_sets(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, row, size per row): each row's distinct shingles, in hash order."""
    w = scan_words(column, True)
    words = w.hashes()
    p, inv = powers(len(words) + 1)
    total = np.zeros(len(words) + 1, U)
    np.cumsum(mix(words + _LANES[0]) * p[:-1], out=total[1:])
    n = np.where(w.counts > 0, np.maximum(1, w.counts - length + 1), 0)
    row = np.repeat(np.arange(len(n)), n)
    start = np.repeat(w.first[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    size = np.minimum(w.counts, length)[row]
    h = mix((total[start + size] - total[start]) * inv[start] + size.astype(U))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, row, np.bincount(row, minlength=len(n))


def _digests(h: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit names of each non-empty set."""
    has = size > 0
    start = (np.cumsum(size) - size)[has]
    return [mix((np.add.reduceat(mix(h + lane), start) if len(start) else np.zeros(0, U)) + size[has].astype(U)) for lane in _LANES]


def _mark_batches(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                h, _, size = shingle_sets(part.column("text"), length)
                names = [np.zeros(len(size), U) for _ in _LANES]
                for name, x in zip(names, _digests(h, size), strict=True):
                    name[size > 0] = x
                keys = [pa.array(x.view(np.int64), mask=size == 0) for x in names]
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["text_key"], *keys, pa.array(size, pa.int64())], ["doc_id", "text_key", "k1", "k2", "n"])
    return run


def _pairs_out(values: np.ndarray, bucket: np.ndarray, name: str) -> pa.RecordBatch:
    """Rows of pairs of numbers, sorted by bucket, as one binary per bucket; columns bucket, entries, counts."""
    number, start = np.unique(bucket, return_index=True)
    raw = np.ascontiguousarray(values).view(np.uint8).ravel()
    data = pa.BinaryArray.from_buffers(pa.binary(), len(number), [None, pa.py_buffer((np.append(start, len(bucket)) * 16).astype(np.int32)), pa.py_buffer(raw)])
    none = pa.nulls(len(number), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), data if name == "entries" else none, data if name == "counts" else none],
                                      ["bucket", "entries", "counts"])


def _grouped(h: np.ndarray, k: np.ndarray):
    """Distinct (h, k) in order, the number of k of each h, and each row's place among them."""
    order = np.lexsort((k, h))
    h, k = h[order], k[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
    h, k = h[new], k[new]
    head = np.ones(len(h), bool)
    head[1:] = h[1:] != h[:-1]
    start = np.flatnonzero(head)
    n = np.diff(np.append(start, len(h)))
    return h, k, np.repeat(n, n), np.arange(len(h)) - np.repeat(start, n)


def _first_batches(length: int, percent: int, buckets: int):
    """(shingle, set) for the first shingles of each set; a task sends at most two sets on for a shingle and counts its own."""
    def flush(held):
        h, k, n, nth = _grouped(*(np.concatenate(x) for x in zip(*held, strict=True)))
        own, times = np.unique(k[n > 1], return_counts=True)
        for name, pairs, key in (("entries", np.stack([h, k], 1)[nth < 2], h[nth < 2]), ("counts", np.stack([own, times.astype(U)], 1), own)):
            bucket = (key % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            yield _pairs_out(pairs[order], bucket[order], name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for part in blocks(batch):
                h, row, size = shingle_sets(part.column("text"), length)
                if not len(h):
                    continue
                name = np.zeros(len(size), U)
                name[size > 0] = _digests(h, size)[0]
                nth = np.arange(len(h)) - (np.cumsum(size) - size)[row]
                on = nth < (size - fewest(size, percent) + _extra(size))[row]
                held.append((h[on], name[row[on]]))
                rows += on.sum()
                if rows > HELD_ROWS:
                    yield from flush(held)
                    held, rows = [], 0
        if held:
            yield from flush(held)
    return run


def _totals(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct first numbers of all pairs, and the sums of their second ones."""
    pairs = np.concatenate(held)
    name, at = np.unique(pairs[:, 0], return_inverse=True)
    return name, np.bincount(at, pairs[:, 1].astype(float), len(name)).astype(U)


def _shared_batches(buckets: int):
    """How many of its first shingles each set shares, as far as a task's buckets tell; a bucket's rows follow each other."""
    def shared(entries):
        pairs = np.frombuffer(b"".join(entries), U).reshape(-1, 2)
        _, k, n, _ = _grouped(pairs[:, 0], pairs[:, 1])
        own, times = np.unique(k[n > 1], return_counts=True)
        return np.stack([own, times.astype(U)], 1)

    def out(held):
        name, total = _totals(held)
        bucket = (name % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        return _pairs_out(np.stack([name, total], 1)[order], bucket[order], "counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, entries, held, rows = None, [], [], 0
        for batch in batches:
            for number, entry, count in zip(*(batch[c].to_pylist() for c in ("bucket", "entries", "counts")), strict=True):
                if number != bucket and entries:
                    held.append(shared(entries))
                    rows, entries = rows + len(held[-1]), []
                bucket = number
                if entry is not None:
                    entries.append(entry)
                else:
                    held.append(np.frombuffer(count, U).reshape(-1, 2))
                    rows += len(held[-1])
                if rows > HELD_ROWS:
                    yield out(held)
                    held, rows = [], 0
        if entries:
            held.append(shared(entries))
        if held:
            yield out(held)
    return run


def _total_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set, shingles shared): every set comes once; a bucket's rows follow each other."""
    bucket, held = None, []

    def out():
        name, total = _totals(held)
        return pa.RecordBatch.from_arrays([signed(name), signed(total)], ["k", "c"])

    for batch in batches:
        for number, count in zip(batch["bucket"].to_pylist(), batch["counts"].to_pylist(), strict=True):
            if number != bucket and held:
                yield out()
                held = []
            bucket = number
            held.append(np.frombuffer(count, U).reshape(-1, 2))
    if held:
        yield out()


def _set_batches(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                h, _, size = shingle_sets(part.column("text"), length)
                size = size[size > 0]
                if not len(size):
                    continue
                start = np.cumsum(size) - size
                names = [signed(x) for x in _digests(h, size)]
                signs = [signed(np.minimum.reduceat(mix(h ^ mix(np.full(1, i + 1, U))), start)) for i in range(_SIGNS)]
                data = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((np.append(start, len(h)) * 8).astype(np.int32)), pa.py_buffer(h.view(np.uint8))])
                at = np.repeat(np.arange(len(size)), size) * SKETCH + (mix(h ^ _LANES[0]) % U(SKETCH)).astype(np.int64)
                sketch = np.packbits((np.bincount(at, minlength=len(size) * SKETCH) & 1).astype(np.uint8))
                sketch = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((np.arange(len(size) + 1) * (SKETCH // 8)).astype(np.int32)), pa.py_buffer(sketch)])
                yield pa.RecordBatch.from_arrays([*names, pa.array(size, pa.int64()), data, sketch, *signs], ["k1", "k2", "size", "elements", "sketch", *[f"s{i}" for i in range(_SIGNS)]])
    return run


def _element_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = np.asarray(batch["size"])
        if batch.num_rows:
            h = np.frombuffer(b"".join(batch["elements"].to_pylist()), U)
            yield pa.RecordBatch.from_arrays([signed(h), pa.array(np.repeat(np.asarray(batch["id"]), n))], ["h", "id"])


def partners(size: int, most: int, percent: int) -> list[int]:
    """Sizes up to ``most`` of sets that may be alike with one of this size."""
    return [b for b in range(fewest(size, percent), most + 1) if fewest(b, percent) <= size]


def subset_cost(size: int, most: int, percent: int) -> int:
    return sum(comb(size, overlap(size, b, percent)) for b in partners(size, most, percent))


def boundary(sets: dict[int, int], scans: dict[int, int], percent: int, most: int = LIGHT_MOST) -> int:
    """The size up to which subsets cost least, given how many sets and how many list members to scan there are of each size."""
    def cost(x):
        light = sum(n * subset_cost(m, x, percent) for m, n in sets.items() if m <= x)
        # a light set is still posted for its heavy partners
        return light + sum(n for m, n in scans.items() if 100 * m >= percent * (x + 1))
    return min(range(most + 1), key=cost)


def _subset_batches(most: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch["size"])
            for m in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == m)
                ids = np.asarray(batch["id"])[at]
                h = np.frombuffer(b"".join(batch["elements"].take(pa.array(at)).to_pylist()), U).reshape(-1, m)
                for b in partners(m, most, percent):
                    c = overlap(m, b, percent)
                    if c > m:
                        continue
                    pick = np.array(list(combinations(range(m), c)))
                    key = np.zeros((len(h), len(pick)), U)
                    for k in range(c):  # the elements are in order, and so are those of a subset
                        key = mix(key * _LANES[1] + h[:, pick[:, k]])
                    key = mix(key + U(min(m, b) * 1000 + max(m, b))).ravel()
                    yield pa.RecordBatch.from_arrays([signed(key), pa.array(np.repeat(ids, len(pick))), pa.array(np.full(len(key), m <= b)), pa.array(np.full(len(key), m >= b))],
                                                     ["key", "id", "low", "high"])
    return run


def light_pairs(sets: DataFrame, most: int, percent: int) -> DataFrame:
    """(u, v): sets of at most ``most`` shingles under one subset name, each with the first of the other size."""
    named = sets.where(F.col("size") <= most).select("id", "size", "elements").mapInArrow(_subset_batches(most, percent), "key long, id long, low boolean, high boolean")
    firsts = named.groupBy("key").agg(F.min(F.when(F.col("low"), F.col("id"))).alias("first_low"), F.min(F.when(F.col("high"), F.col("id"))).alias("first_high"))
    other = F.when(F.col("low"), F.col("first_high")).otherwise(F.col("first_low"))
    met = named.join(firsts, "key").select("id", other.alias("other")).where("other IS NOT NULL AND id != other")
    return met.select(F.least("id", "other").alias("u"), F.greatest("id", "other").alias("v")).distinct()


def _room(a, b, i, j, light: int, percent: int) -> np.ndarray:
    """Can sets of a and b shingles, which share the ones at places i and j, be alike?  Two light sets meet elsewhere."""
    small_, large = np.minimum(a, b), np.maximum(a, b)
    return (100 * small_ >= percent * large) & (large > light) & (1 + np.minimum(a - i, b - j) - 1 >= overlap(a, b, percent))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that end with a whole group, and where the groups start in them."""
    held = None
    for batch in batches:
        whole = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks().to_batches()
        if not whole:
            continue
        batch = whole[0]
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for c in keys:
            x = np.asarray(batch[c])
            new[1:] |= x[1:] != x[:-1]
        start = np.flatnonzero(new)
        if len(start) > 1:
            yield batch.slice(0, start[-1]), start[:-1]
        held = batch.slice(start[-1])
    if held is not None and held.num_rows:
        yield held, np.zeros(1, np.int64)


def _out(ids, i, j) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])], 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])


def _neighbour_batches(light: int, percent: int):
    """Pairs of list members that follow each other, and of members of one signature in a binary tree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, start in _groups(batches, ["h", "part"]):
            ids, size, pos, sign = (np.asarray(batch[c]) for c in ("id", "size", "pos", "sign"))
            new = np.zeros(len(ids), bool)
            new[start] = True
            at = np.flatnonzero(~new)
            fresh = new.copy()
            fresh[1:] |= sign[1:] != sign[:-1]
            lead = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            nth = np.arange(len(ids)) - lead
            child = np.flatnonzero(nth > 2)
            i, j = np.concatenate([at, child]), np.concatenate([at - 1, lead[child] + (nth[child] - 1) // 2])
            on = _room(size[i], size[j], pos[i], pos[j], light, percent)
            if on.any():
                yield _out(ids, i[on], j[on])
    return run


def _rest_batches(light: int, percent: int):
    """Pairs of list members of different components, about PAIRS at a time; members are in order of size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, start in _groups(batches, ["h", "low", "high"]):
            ids, size, pos, comp, part, low, high = (np.asarray(batch[c]) for c in ("id", "size", "pos", "comp", "part", "low", "high"))
            sketch = np.frombuffer(b"".join(batch["sketch"].to_pylist()), U).reshape(len(ids), -1)
            end = np.repeat(np.append(start[1:], len(ids)), np.diff(np.append(start, len(ids))))
            # sizes go up inside a group, so the partners of a member follow it
            group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(ids))))
            top = int(size.max()) + 1
            reach = np.minimum(np.searchsorted(group * top + size, group * top + np.minimum(size * 100 // percent, top - 1), "right"), end)
            n = reach - np.arange(len(ids)) - 1
            edge = np.cumsum(n)
            at = 0
            while at < len(ids):
                to = max(at + 1, int(np.searchsorted(edge, (edge[at - 1] if at else 0) + PAIRS, "right")))
                own = n[at:to]
                i = np.repeat(np.arange(at, to), own)
                j = i + 1 + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
                on = (comp[i] != comp[j]) & ((low[i] == high[i]) | (part[i] != part[j]))
                i, j = i[on], j[on]
                on = _room(size[i], size[j], pos[i], pos[j], light, percent)
                i, j = i[on], j[on]
                apart = np.bitwise_count(sketch[i] ^ sketch[j]).sum(1, dtype=np.int64)
                on = (size[i] + size[j] - apart) // 2 >= overlap(size[i], size[j], percent)
                if on.any():
                    yield _out(ids, i[on], j[on])
                at = to
    return run


def _alike_batches(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch["a"], batch["b"], strict=True):
                a, b = np.frombuffer(a.as_buffer(), U), np.frombuffer(b.as_buffer(), U)
                both = len(np.intersect1d(a, b, True))
                good.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch["u"], batch["v"]], ["u", "v"]).filter(pa.array(good, pa.bool_()))
    return run


def alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets are alike."""
    own = sets.select("id", "elements")
    full = pairs.join(own.select(F.col("id").alias("u"), F.col("elements").alias("a")), "u") \
        .join(own.select(F.col("id").alias("v"), F.col("elements").alias("b")), "v")
    return full.select("u", "v", "a", "b").mapInArrow(_alike_batches(percent), "u long, v long")


def posted(sets: DataFrame, percent: int) -> DataFrame:
    """Members of the inverted lists: h, id, size, pos, sign, n for the first shingles of each set, from rare to common; n is the list's length."""
    rows = sets.select("id", "size", "elements").mapInArrow(_element_batches, "h long, id long")
    common = rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    by_set = Window.partitionBy("id")
    placed = rows.join(common, "h").select("h", "id", F.row_number().over(by_set.orderBy("df", "h")).alias("nth"), F.count("*").over(by_set).alias("known"))
    signs = F.array(*[f"s{i}" for i in range(_SIGNS)])
    placed = placed.join(sets.select("id", "size", signs.alias("signs")), "id") \
        .withColumn("pos", F.col("size") - F.col("known") + F.col("nth") - 1) \
        .where(F.col("pos") <= F.col("size") - F.floor((percent * F.col("size") + 99) / 100)) \
        .select("h", "id", "size", "pos", F.element_at("signs", (F.pmod("h", F.lit(_SIGNS)) + 1).cast("int")).alias("sign"))
    placed = stored(placed, "postings")
    return stored(placed.join(placed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "h"), "lists")


def _part(n: Column) -> Column:
    return F.pmod(F.xxhash64("id", "h"), F.ceil(n / LIST_ROWS))


def link_sets(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (u, v) that connect exactly the sets (id, size, elements, sketch, s0..s3) reachable over similarities of ``percent`` or more."""
    width = shuffle_width(sets.sparkSession)
    lists = posted(sets, percent)
    short = F.col("size") <= LIGHT_MOST
    light = boundary({r["size"]: r.n for r in sets.where(short).groupBy("size").agg(F.count("*").alias("n")).collect()},
                     {r["size"]: r.n for r in lists.where(short).groupBy("size").agg(F.sum("n").alias("n")).collect()}, percent)
    heavy = lists.where(F.col("size") >= fewest(light + 1, percent)).withColumn("part", _part(F.col("n")))
    near = heavy.repartition(width, "h", "part").sortWithinPartitions("h", "part", "sign", "size", "id") \
        .select("h", "part", "id", "size", "pos", "sign").mapInArrow(_neighbour_batches(light, percent), "u long, v long")
    if light:
        near = near.unionByName(light_pairs(sets, light, percent))
    tried = stored(near.distinct(), "near-pairs")
    links = stored(alike(tried, sets, percent), "near-links")

    roots = components(links)
    now = heavy.join(roots, heavy["id"] == roots["node"], "left").select("h", "id", "size", "pos", "part", "n", F.coalesce("root", "id").alias("comp"))
    mixed = now.groupBy("h").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least < most").select("h")
    parts = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / LIST_ROWS) - 1)
    dealt = now.join(mixed, "h").join(sets.select("id", "sketch"), "id").withColumn("other", F.explode(parts)) \
        .select("h", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "id", "size", "pos", "comp", "sketch")
    rest = dealt.repartition(width, "h", "low", "high").sortWithinPartitions("h", "low", "high", "size", "id") \
        .mapInArrow(_rest_batches(light, percent), "u long, v long").distinct()
    rest = stored(rest.join(tried, ["u", "v"], "left_anti"), "other-pairs")
    return links.unionByName(alike(rest, sets, percent))


def join_alike(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``.

    A row's set holds its distinct shingles of ``shingle`` lower-cased (A-Z) words, or its one shorter word sequence.  Rows link when
    their sets' Jaccard similarity is ``percent`` / 100 or more; component_id is the smallest doc_id that links reach, the row's own
    included.  Null, empty and wordless texts have no shingles and link with nothing.  Rows with a null doc_id take part; a component's id is
    null only when all its ids are.  Repeated rows and equal sets are compared once; an empty table gives no rows; other columns are not read.
    Shingles stand for themselves by 64-bit hashes, whole sets by 128 bits.
    """
    spark, width = docs.sparkSession, shuffle_width(docs.sparkSession)
    rows = text_batches(docs).select("doc_id", text_key().alias("text_key"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    marks = stored(rows.mapInArrow(_mark_batches(shingle), f"doc_id {kind}, text_key binary, k1 long, k2 long, n long"), "set-marks")
    kinds = stored(marks.where("n > 0").groupBy("k1", "k2").agg(
        F.min(F.struct("doc_id", "text_key")).alias("who"), F.min("doc_id").alias("low"), F.count("*").alias("copies"), F.first("n").alias("n")), "set-kinds")

    total = marks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    buckets = max(width, -(-total // (2 * BUCKET_ROWS)))
    packed = "bucket long, entries binary, counts binary"
    sent = rows.select("text").mapInArrow(_first_batches(shingle, percent, buckets), packed)
    counted = sent.repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(_shared_batches(buckets), packed)
    shared = counted.repartition(width, "bucket").sortWithinPartitions("bucket").mapInArrow(_total_batches, "k long, c long")
    need = F.greatest(F.lit(1), F.floor(F.floor((percent * F.col("n") + 99) / 100) / 10))
    kept = stored(kinds.join(shared, kinds.k1 == shared.k).where(F.col("c") >= need).select("who.doc_id", "who.text_key"), "kept-sets")
    some = small(kept, kept.count(), 64)
    texts = rows.join(some, rows["doc_id"].eqNullSafe(some["doc_id"]) & (rows["text_key"] == some["text_key"]), "left_semi").select("text")
    signs = ", ".join(f"s{i} long" for i in range(_SIGNS))
    sets = stored(texts.mapInArrow(_set_batches(shingle), f"k1 long, k2 long, size long, elements binary, sketch binary, {signs}").dropDuplicates(["k1", "k2"])
                  .withColumn("id", F.monotonically_increasing_id()), "sets")

    roots = components(link_sets(sets, percent))
    linked = stored(sets.select("id", "k1", "k2").join(roots, F.col("id") == F.col("node")).join(kinds, ["k1", "k2"]).select("k1", "k2", "root", "low"), "linked-sets")
    lowest = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    members = linked.join(lowest, "root").select("k1", "k2", "component_id")
    named = stored(kinds.join(members, ["k1", "k2"], "left").where("copies > 1 OR component_id IS NOT NULL")
                   .select("k1", "k2", F.coalesce("component_id", "low").alias("component_id")), "set-components")
    return marks.join(small(named, named.count(), 32), ["k1", "k2"], "left") \
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
