"""SimHash near-duplicates: fingerprints of word shingles, linked through sharded BK-trees.

Any two fingerprints within two bits agree on one of three blocks of bits, so
distinct fingerprints are dealt to one shard per block value.  Every shard
holds its own BK-trees (children keyed by the integer Hamming distance to the
parent) and a probe follows only the edges within the radius.  A shard is the
unit that travels: its trees meet only the fingerprints that can match them, so nothing that grows
with the corpus is broadcast.  Shards with more than ``SHARD_ROWS`` members are
split again on the bits left over, up to three times; beyond that a shard has several trees of that size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, blocks, scan_words, shuffle_width, signed, small, stored, text_batches, text_key, unsigned
from .components import components
from .xxh import xxh64

SHARD_ROWS = 4096
LEVELS = 3
PROBE_ROWS = 1 << 14
_LANES = U(0x0101010101010101)


def fingerprints(col: pa.Array, shingle: int = 3) -> np.ndarray:
    """64-bit SimHash of each text: majority bits of the XXH64 (seed 42) of its word shingles."""
    w = scan_words(col, lower=True)
    out = np.zeros(len(col), U)
    if not len(w):
        return out
    keep = np.zeros(len(w.buf), bool)
    depth = np.zeros(len(w.buf) + 1, np.int8)
    depth[w.starts] += 1
    np.subtract.at(depth, w.ends, 1)
    keep = np.cumsum(depth[:-1]) > 0
    gap = w.ends[w.ends < len(w.buf)]
    gap = gap[~keep[gap]]
    buf = w.buf.copy()
    buf[gap] = 0x20
    keep[gap] = True
    place = np.cumsum(keep) - 1
    starts = place[w.starts]
    ends = starts + (w.ends - w.starts)
    n = np.where(w.counts > shingle, w.counts - shingle + 1, np.minimum(w.counts, 1))  # shingles of each text
    heads = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(n)), n)
    lead = w.first[row] + np.arange(heads[-1]) - heads[row]
    last = np.minimum(lead + shingle, w.first[row + 1]) - 1
    h = xxh64(buf[keep], starts[lead], ends[last] - starts[lead])
    # bits are summed as eight byte lanes a word, at most 255 shingles at a time
    pieces = -(-n // 255)
    piece_row = np.repeat(np.arange(len(n)), pieces)
    nth = np.arange(len(piece_row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cuts = heads[piece_row] + 255 * nth
    full = np.flatnonzero(n)
    firsts = (np.cumsum(pieces) - pieces)[full]
    for s in range(8):
        lanes = np.add.reduceat((h >> U(s)) & _LANES, cuts).view(np.uint8).reshape(-1, 8)
        count = np.add.reduceat(lanes.astype(np.int64), firsts, axis=0)
        on = (2 * count > n[full, None]).astype(U)
        for k in range(8):
            out[full] |= on[:, k] << U(8 * k + s)
    return out


class BKForest:
    """BK-trees of many shards at once; every item is a node and its shard's first item is the root.

    All items of a level are placed together: items that meet at one node with
    one distance become that child's subtree, the first of them the child.
    """

    def __init__(self, items: np.ndarray, shard: np.ndarray):
        self.items = items
        _, head, inverse = np.unique(shard, return_index=True, return_inverse=True)
        self.root = head[inverse]
        at, active, keys, kids = self.root.copy(), np.flatnonzero(self.root != np.arange(len(items))), [], []
        while len(active):
            distance = np.bitwise_count(items[active] ^ items[at[active]]).astype(np.int64)
            edge = at[active] * 128 + distance
            names, first, inverse = np.unique(edge, return_index=True, return_inverse=True)
            keys.append(names)
            kids.append(active[first])
            at[active] = active[first][inverse]
            active = active[at[active] != active]
        keys, kids = np.concatenate([*keys, np.zeros(0, np.int64)]), np.concatenate([*kids, np.zeros(0, np.int64)])
        order = np.argsort(keys, kind="stable")
        self.keys, self.kids = keys[order].astype(np.int64), kids[order].astype(np.int64)

    def probe(self, values: np.ndarray, roots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(value index, node) of everything within the radius; only edges within it are followed."""
        found = []
        who, node = np.arange(len(values)), roots
        while len(who):
            distance = np.bitwise_count(values[who] ^ self.items[node]).astype(np.int64)
            hit = distance <= radius
            found.append((who[hit], node[hit]))
            low = np.searchsorted(self.keys, node * 128 + np.maximum(distance - radius, 0))
            n = np.searchsorted(self.keys, node * 128 + distance + radius, "right") - low
            child = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            who, node = np.repeat(who, n), self.kids[child]
        return np.concatenate([a for a, _ in found] or [np.zeros(0, int)]), np.concatenate([b for _, b in found] or [np.zeros(0, int)])


def _lowest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index connected with each of n items by the links a-b."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            break
    return label


def link_shards(items: np.ndarray, shard: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links (item, smallest linked item) inside every shard; items are sorted by shard."""
    change = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1])
    begin = np.repeat(change, np.diff(np.append(change, len(shard))))
    nth = np.arange(len(shard)) - begin
    trees = BKForest(items, begin * (1 << 20) + nth // SHARD_ROWS)
    left, right = [], []
    for tree in range(int(nth.max()) // SHARD_ROWS + 1):
        start = begin + tree * SHARD_ROWS
        ask = np.flatnonzero(nth >= tree * SHARD_ROWS)  # earlier items have met this tree's members from their own side
        for k in range(0, len(ask), PROBE_ROWS):
            part = ask[k:k + PROBE_ROWS]
            who, node = trees.probe(items[part], start[part], radius)
            who = part[who]
            left.append(who[who != node])
            right.append(node[who != node])
    label = _lowest(len(items), np.concatenate(left), np.concatenate(right))
    linked = np.flatnonzero(label != np.arange(len(items)))
    return items[linked], items[label[linked]]


def _link_batches(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_s, held_f = np.zeros(0, U), np.zeros(0, U)

        def out(s, f):
            if not len(s):
                return
            a, b = link_shards(f, s, radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([signed(a), signed(b)], ["u", "v"])

        for batch in batches:
            s, f = np.concatenate([held_s, unsigned(batch["shard"])]), np.concatenate([held_f, unsigned(batch["fp"])])
            whole = np.flatnonzero(s != s[-1])  # the last shard may go on in the next batch
            cut = whole[-1] + 1 if len(whole) else 0
            yield from out(s[:cut], f[:cut])
            held_s, held_f = s[cut:], f[cut:]
        yield from out(held_s, held_f)
    return run


def _split(mask: int, parts: int) -> list[int]:
    """A mask's bits in ``parts`` contiguous groups."""
    bits = [i for i in range(64) if mask >> i & 1]
    size = -(-len(bits) // parts)
    return [sum(1 << i for i in bits[k:k + size]) for k in range(0, len(bits), size)]


def _masks(radius: int) -> list[list[int]]:
    """Per level, the masks a shard may fix; entry i of a level is split into entries (radius+1)i ... of the next."""
    full, levels, now = (1 << 64) - 1, [], [0]
    for _ in range(LEVELS):
        now = [m | part for m in now for part in _split(full & ~m, radius + 1)]
        levels.append(now)
    return levels


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _deal(rows: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """(fp, way, shard) for the masks that follow each row's way."""
    ways = F.transform(F.sequence(F.lit(0), F.lit(radius)), lambda i: F.col("way") * (radius + 1) + i)
    table = F.array(*[F.lit(_long(m)) for m in masks])
    return rows.select("fp", F.explode(ways).alias("way")).select(
        "fp", "way", F.xxhash64("way", F.col("fp").bitwiseAND(F.element_at(table, F.col("way").cast("int") + 1))).alias("shard"))


def link_fingerprints(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links (u, v) that connect exactly the distinct fingerprints (column fp) reachable within ``radius`` bits."""
    width = shuffle_width(fps.sparkSession)
    rows, links = fps.withColumn("way", F.lit(0)), None
    for level, masks in enumerate(_masks(radius)):
        dealt = _deal(rows, masks, radius)
        hot = stored(dealt.groupBy("shard").count().where(F.col("count") > SHARD_ROWS).select("shard"), "hot-shards")
        n = hot.count() if level < LEVELS - 1 else 0
        calm = dealt.join(small(hot, n, 16), "shard", "left_anti") if n else dealt
        found = calm.repartition(width, "shard").sortWithinPartitions("shard", "fp").select("shard", "fp") \
            .mapInArrow(_link_batches(radius), "u long, v long")
        links = found if links is None else links.unionByName(found)
        if not n:
            return links
        rows = dealt.join(small(hot, n, 16), "shard", "left_semi").select("fp", "way")
    return links


def _fingerprint_batches(shingle: int, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in columns], signed(fingerprints(part.column("text"), shingle))], [*columns, "fp"])
    return run


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp (signed long), component_id, root, text_key for every row of ``docs``.

    component_id is the smallest doc_id that can be reached over links of at most ``radius`` differing bits.  Null and
    wordless texts have fingerprint zero, which links like any other.  Rows with a null doc_id
    take part; their component's id is null only when all its ids are (``root``, a fingerprint, tells components apart).  Equal texts and repeated rows share a
    fingerprint and are compared once.  An empty table gives no rows; other columns are not read.
    """
    rows = text_batches(docs).select("doc_id", text_key().alias("text_key"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    marked = stored(rows.mapInArrow(_fingerprint_batches(shingle, ["doc_id", "text_key"]),
                                    f"doc_id {kind}, text_key binary, fp long"), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    roots = components(link_fingerprints(distinct.select("fp"), radius))
    named = stored(distinct.join(roots, distinct.fp == roots.node, "left")
                   .select("fp", "low", F.coalesce("root", "fp").alias("root")), "fingerprint-roots")
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = named.select("fp", "root").join(lowest, "root").select("fp", "root", "component_id")
    return marked.join(classes, "fp", "left").select("doc_id", "fp", "component_id", "root", "text_key")


def one_of_each(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest doc_id (nulls last, then by text).

    Rows with the same doc_id and text count as one.  All columns are kept as they are.
    """
    found = stored(near_duplicates(docs, shingle, radius), "near-duplicates")
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("text_key").alias("c"))
    stay = found.groupBy("root").agg(F.min(order).alias("first"))
    stay = stay.select(F.col("first.b").alias("stay_id"), F.col("first.c").alias("stay_key"))
    # an anti join by row, not by component: a large group is spread over all tasks
    gone = stored(found.select("doc_id", "text_key").distinct().join(
        stay, F.col("doc_id").eqNullSafe(F.col("stay_id")) & (F.col("text_key") == F.col("stay_key")), "left_anti"), "near-duplicates-gone")
    again = stored(found.groupBy("doc_id", "text_key").count().where("count > 1").select("doc_id", "text_key"), "repeated-rows")

    def same(left: DataFrame, right: DataFrame):
        return left["doc_id"].eqNullSafe(right["doc_id"]) & (left[key] == right["text_key"])

    key = "text_key_" + "_".join(docs.columns)  # a name that no column has
    rows = docs.withColumn(key, text_key())
    kept = rows.join(small(gone, n, 64) if (n := gone.count()) else gone, same(rows, gone), "left_anti")
    if not (n := again.count()):
        return kept.drop(key)
    some = small(again, n, 64)
    return kept.join(some, same(kept, again), "left_anti").unionByName(
        kept.join(some, same(kept, again), "left_semi").dropDuplicates(["doc_id", key])).drop(key)
