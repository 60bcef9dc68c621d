"""Substring dedup by recompression: equal stretches of words get equal interior symbols.

Every round names maximal runs of one symbol, then pairs (left, right) under a
split of the alphabet into left and right symbols.  A name is a 64-bit hash of
what it stands for and a side is a bit of the name, so all tasks name alike without a dictionary.
Beside its words a symbol carries the span that forced it to be formed: any
other occurrence of those words forms the same symbol.  A symbol that the
corpus counts once therefore rules out every window around its span; windows
that no such symbol rules out are compared exactly by their word sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import BROADCAST_BYTES, U, blocks, mix, powers, scan_words, signed, small, stored, text_batches, text_key, unsigned
from .hashing import spark_xxhash64_pair

WINDOW = 20
ROUNDS = (4,)
#: Window rows held by a task before they are reduced and sent on.
HELD_ROWS = 4_000_000
NULL_DOC = (1 << 63) - 1
_PAIR, _RUN, _SIDE = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)


class Parse:
    """Symbols of one recompression level over a block: words [s, e), forced by words [lo, hi)."""

    def __init__(self, words: np.ndarray, row: np.ndarray):
        self.words, self.row = words, row
        n = len(words)
        self.sym = words
        self.s, self.e = np.arange(n), np.arange(1, n + 1)
        self.lo, self.hi = self.s, self.e

    def _runs(self) -> None:
        n = len(self.sym)
        row = self.row[self.s]
        head = np.concatenate([[True], (self.sym[1:] != self.sym[:-1]) | (row[1:] != row[:-1])])
        first = np.flatnonzero(head)
        last = np.append(first[1:], n) - 1
        k = last - first + 1
        sym = self.sym[first]
        s, e = self.s[first], self.e[last]
        # a neighbour can only continue the run if its nearest word is the run's own outer word
        lo, hi = np.minimum(self.lo[first], s - 1), np.maximum(self.hi[last], e + 1)
        before, after = np.maximum(s - 1, 0), np.minimum(e, len(self.words) - 1)
        unsure_left = (first > 0) & (row[first] == row[np.maximum(first - 1, 0)]) & (self.words[before] == self.words[e - 1])
        unsure_right = (last < n - 1) & (row[last] == row[np.minimum(last + 1, n - 1)]) & (self.words[after] == self.words[s])
        lo = np.where(unsure_left, np.minimum(lo, self.lo[np.maximum(first - 1, 0)]), lo)
        hi = np.where(unsure_left, np.maximum(hi, self.hi[np.maximum(first - 1, 0)]), hi)
        lo = np.where(unsure_right, np.minimum(lo, self.lo[np.minimum(last + 1, n - 1)]), lo)
        hi = np.where(unsure_right, np.maximum(hi, self.hi[np.minimum(last + 1, n - 1)]), hi)
        long = np.flatnonzero(k > 1)
        if len(long):  # members of a run force it only together with both ends
            lo[long] = np.minimum(lo[long], np.minimum.reduceat(self.lo, first)[long])
            hi[long] = np.maximum(hi[long], np.maximum.reduceat(self.hi, first)[long])
            sym = sym.copy()
            sym[long] = mix(sym[long] * _RUN + k[long].astype(U))
        self.sym, self.s, self.e, self.lo, self.hi = sym, s, e, lo, hi

    def _pairs(self, number: int) -> None:
        n = len(self.sym)
        row = self.row[self.s]
        left = (mix(self.sym + _SIDE * U(number + 1)) >> U(17)) & U(1) == 1
        joined = np.zeros(n, bool)  # joined[i]: i and i + 1 form a pair
        joined[:-1] = left[:-1] & ~left[1:] & (row[1:] == row[:-1])
        second = np.concatenate([[False], joined[:-1]])
        lo, hi = self.lo.copy(), self.hi.copy()
        i = np.flatnonzero(joined)
        lo[i] = np.minimum(lo[i], self.lo[i + 1])
        hi[i] = np.maximum(hi[i], self.hi[i + 1])
        # a single left symbol depends on what follows it, a single right one on what precedes it
        for lone, step in ((np.flatnonzero(left & ~joined), 1), (np.flatnonzero(~left & ~second), -1)):
            other = lone + step
            inside = (other >= 0) & (other < n)
            inside[inside] = row[other[inside]] == row[lone[inside]]
            a, b = lone[inside], other[inside]
            lo[a] = np.minimum(lo[a], self.lo[b])
            hi[a] = np.maximum(hi[a], self.hi[b])
            edge = lone[~inside]
            if step > 0:
                hi[edge] = np.maximum(hi[edge], self.e[edge] + 1)
            else:
                lo[edge] = np.minimum(lo[edge], self.s[edge] - 1)
        sym, e = self.sym.copy(), self.e.copy()
        sym[i] = mix(mix(self.sym[i] + _PAIR) * _PAIR + self.sym[i + 1])
        e[i] = self.e[i + 1]
        keep = ~second
        self.sym, self.s, self.e, self.lo, self.hi = sym[keep], self.s[keep], e[keep], lo[keep], hi[keep]

    def round(self, number: int) -> None:
        self._runs()
        self._pairs(number)


def levels(words: np.ndarray, row: np.ndarray, first: np.ndarray, rounds: tuple[int, ...], window: int):
    """(symbol, lo, hi) of the given rounds, of symbols whose span fits a window inside their text."""
    parse = Parse(words, row)
    for number in range(max(rounds)):
        parse.round(number)
        if number + 1 in rounds:
            text = parse.row[parse.s]
            on = (parse.hi - parse.lo <= window) & (parse.lo >= first[text]) & (parse.hi <= first[text + 1])
            yield mix(parse.sym[on] + U(number)), parse.lo[on], parse.hi[on]


def _member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


class SharedSymbols:
    """The symbols that occur at least twice: an exact sorted array while it fits ``limit`` bytes, else a Bloom filter of that size.

    A false positive only adds windows to the exact comparison, so both give one result.
    """

    def __init__(self, spark: SparkSession, symbols: DataFrame, limit: int):
        n = symbols.count()
        self.exact = 8 * n <= limit
        if self.exact:
            found = np.concatenate([unsigned(b["symbol"]) for b in symbols.toArrow().to_batches()] or [np.zeros(0, U)])
            self.value = spark.sparkContext.broadcast(np.sort(found))
        else:
            words = limit // 8
            bits = symbols.select(F.explode(F.array(*[F.xxhash64(F.lit(i), "symbol") for i in range(3)])).alias("h")) \
                .select(F.pmod("h", F.lit(words).cast("long")).alias("word"),
                        F.call_function("shiftleft", F.lit(1).cast("long"),
                                        F.shiftrightunsigned("h", 58).cast("int")).alias("bit")) \
                .groupBy("word").agg(F.bit_or("bit").alias("bits"))
            table = np.zeros(words, U)
            for b in bits.toArrow().to_batches():
                table[np.asarray(b["word"])] = unsigned(b["bits"])
            self.value = spark.sparkContext.broadcast(table)

    def test(self):
        """A function for tasks: which of these symbols are shared."""
        exact, value = self.exact, self.value

        def shared(x: np.ndarray) -> np.ndarray:
            table = value.value
            if exact:
                return _member(table, x)
            ok = np.ones(len(x), bool)
            for i in range(3):
                h = spark_xxhash64_pair(i, x)
                word = np.mod(h.view(np.int64), np.int64(len(table)))
                ok &= (table[word] >> (h >> U(58))) & U(1) == 1
            return ok
        return shared


def _symbol_batches(rounds, window):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                w = scan_words(part.column("text"))
                if not len(w):
                    continue
                for symbol, _, _ in levels(w.hashes(), w.row, w.first, rounds, window):
                    if len(symbol):
                        value, n = np.unique(symbol, return_counts=True)
                        yield pa.RecordBatch.from_arrays([signed(value), pa.array(np.minimum(n, 2), pa.int8())], ["symbol", "n"])
    return run


def possible_windows(words, row, first, shared, rounds, window) -> np.ndarray:
    """Starts of windows that hold no symbol which occurs once in the corpus."""
    n = len(words)
    out = np.zeros(n + 1, np.int64)
    for symbol, lo, hi in levels(words, row, first, rounds, window):
        lone = ~shared(symbol)
        out += np.bincount(np.maximum(hi[lone] - window, 0), minlength=n + 1)[:n + 1]
        out -= np.bincount(lo[lone] + 1, minlength=n + 1)[:n + 1]
    at = np.arange(n)
    return np.flatnonzero((np.cumsum(out[:n]) == 0) & (at + window <= first[row + 1]))


def window_names(words: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits that stand for the word sequence of each window."""
    p, inv = powers(len(words) + 1)
    out = []
    for salt in (U(0), _SIDE):
        total = np.zeros(len(words) + 1, U)
        np.cumsum(mix(words + salt) * p[:-1], out=total[1:])
        out.append(mix((total[starts + window] - total[starts]) * inv[starts]))
    return out[0], (out[1] >> U(32)).astype(np.uint32).view(np.int32)


_SCHEMA = "k1 long, k2 int, doc long, tag int, start int, starts array<int>"


def _window_batches(shared, rounds, window):
    def reduce(held):
        k1, k2, doc, tag, start = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((tag, start, doc, k2, k1))
        k1, k2, doc, tag, start = k1[order], k2[order], doc[order], tag[order], start[order]
        head = np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
        lead = np.flatnonzero(head)[np.cumsum(head) - 1]
        later = (doc != doc[lead]) | (start != start[lead])
        fresh = head | np.concatenate([[True], tag[1:] != tag[:-1]])
        send = np.flatnonzero(~later & fresh)
        nothing = pa.nulls(len(send), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([signed(k1[send]), pa.array(k2[send]), pa.array(doc[send]), pa.array(tag[send]), pa.array(start[send]), nothing],
                                         ["k1", "k2", "doc", "tag", "start", "starts"])
        gone = np.flatnonzero(later)
        if len(gone):
            gone = gone[np.lexsort((start[gone], tag[gone], doc[gone]))]
            d, t = doc[gone], tag[gone]
            new = np.concatenate([[0], np.flatnonzero((d[1:] != d[:-1]) | (t[1:] != t[:-1])) + 1])
            lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(gone)), pa.int32()), pa.array(start[gone]))
            none = pa.nulls(len(new), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none.cast(pa.int32()), pa.array(d[new]), pa.array(t[new]), none.cast(pa.int32()), lists],
                                             ["k1", "k2", "doc", "tag", "start", "starts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in blocks(batch):
                w = scan_words(part.column("text"))
                if not len(w):
                    continue
                words = w.hashes()
                starts = possible_windows(words, w.row, w.first, shared, rounds, window)
                if not len(starts):
                    continue
                k1, k2 = window_names(words, starts, window)
                row = w.row[starts]
                held.append((k1, k2, np.asarray(part["doc"])[row], np.asarray(part["tag"])[row], (starts - w.first[row]).astype(np.int32)))
                size += len(starts)
                if size > HELD_ROWS:
                    yield from reduce(held)
                    held, size = [], 0
        if held:
            yield from reduce(held)
    return run


def _range_batches(window):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, heads = [], [0]
            for starts in batch["starts"].to_pylist():
                at = np.unique(np.array(starts, np.int32))
                new = np.concatenate([[True], at[1:] > at[:-1] + window])
                last = np.append(np.flatnonzero(new)[1:], len(at)) - 1
                flat.append(np.stack([at[new], at[last] + window], 1).ravel())
                heads.append(heads[-1] + len(flat[-1]))
            values = pa.array(np.concatenate([*flat, np.zeros(0, np.int32)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch["doc"], batch["tag"], pa.ListArray.from_arrays(pa.array(heads, pa.int32()), values)], ["doc", "tag", "spans"])
    return run


def _keep_batches(window, kept_columns):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                w = scan_words(part.column("text"))
                gone = np.zeros(len(w) + 1, np.int64)
                copies = np.asarray(part["copy"]) & (w.counts >= window)
                for i in np.flatnonzero(copies):
                    gone[w.first[i]] += 1
                    gone[w.first[i + 1]] -= 1
                spans = part["spans"]
                for i in np.flatnonzero(np.asarray(spans.is_valid()) & ~copies):
                    at = np.asarray(spans[int(i)].values) + w.first[i]
                    np.add.at(gone, at[::2], 1)
                    np.subtract.at(gone, at[1::2], 1)
                kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                size = w.ends[kept] - w.starts[kept] + 1
                place = np.concatenate([[0], np.cumsum(size)])
                source = np.repeat(w.starts[kept] - place[:-1], size) + np.arange(place[-1])
                source[place[1:] - 1] = 0
                out = w.buf[source] if len(source) else np.zeros(0, np.uint8)
                out[place[1:] - 1] = 0x20
                first = np.searchsorted(kept, w.first)
                n = np.diff(first)
                raw = out.tobytes()
                texts = [raw[place[a]:max(place[a], place[b] - 1)].decode() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept_columns], pa.array(w.counts, pa.int64()), pa.array(w.counts - n, pa.int64()), pa.array(texts, pa.string())],
                                                 [*kept_columns, "n_words", "n_removed", "kept_text"])
    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW, rounds: tuple[int, ...] = ROUNDS, limit: int = BROADCAST_BYTES,
                     carry: list[str] | None = None) -> DataFrame:
    """row (the columns named by ``carry``, all by default; the text beside them), n_words, n_removed, kept_text for every row.

    A word goes when a window of ``window`` words over it has the same words as a window that starts earlier
    (smaller doc_id, or the same doc_id and an earlier start).  doc_id is a whole number; rows without one come
    last and count as one document.  Null, empty and short texts lose nothing (null gives an empty kept_text); repeated rows with one
    doc_id and one text get equal results; ``row`` keeps its columns whatever their names.
    Windows are named by 96-bit hashes of their word sequences.
    """
    spark = docs.sparkSession
    carry = carry or docs.columns
    rows = text_batches(docs).select(F.struct(*[docs[c] for c in carry if c != "text"]).alias("row"), docs["text"],
                       F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_DOC)).alias("doc"), text_key().alias("text_key"))
    rows = rows.withColumn("tag", F.conv(F.substring(F.hex("text_key"), 1, 7), 16, 10).cast("int"))
    repeats = stored(rows.groupBy("text_key").agg(F.min("doc").alias("low"), F.count("*").alias("n")).where("n > 1").select("text_key", "low"), "repeats")
    rows = rows.join(small(repeats, repeats.count(), 64), "text_key", "left") \
        .withColumn("copy", F.coalesce(F.col("doc") > F.col("low"), F.lit(False)))
    lead = rows.where("not copy").select("doc", "tag", "text")

    counted = lead.select("text").mapInArrow(_symbol_batches(rounds, window), "symbol long, n tinyint")
    twice = stored(counted.groupBy("symbol").agg(F.sum("n").alias("n")).where("n > 1").select("symbol"), "shared-symbols")
    shared = SharedSymbols(spark, twice, limit).test()

    found = stored(lead.mapInArrow(_window_batches(shared, rounds, window), _SCHEMA), "windows")
    names = found.where("k1 is not null").select("k1", "k2", "doc", "tag", "start")
    early = names.groupBy("k1", "k2").agg(F.min(F.struct("doc", "start")).alias("early"), F.count("*").alias("n")) \
        .where("n > 1").select("k1", "k2", "early")
    later = names.join(early, ["k1", "k2"]).where(F.struct("doc", "start") > F.col("early")) \
        .groupBy("doc", "tag").agg(F.collect_list("start").alias("starts"))
    local = found.where("starts is not null").select("doc", "tag", "starts")
    spans = later.unionByName(local).groupBy("doc", "tag").agg(F.flatten(F.collect_list("starts")).alias("starts")) \
        .mapInArrow(_range_batches(window), "doc long, tag int, spans array<int>")
    spans = stored(spans, "removed-spans")
    size = spans.agg(F.coalesce(F.sum(F.size("spans") * 4 + 64), F.lit(0)).alias("b")).first().b
    marked = rows.join(small(spans, 1, size), ["doc", "tag"], "left").select("row", "text", "copy", "spans")
    kept = ["row", "text"] if "text" in carry else ["row"]
    schema = StructType([*[marked.schema[c] for c in kept], StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_text", StringType())])
    return marked.mapInArrow(_keep_batches(window, kept), schema)
