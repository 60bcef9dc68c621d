"""Language-model scores from a log-frequency Bloom filter.

Counts are quantised to levels on a logarithmic scale and an n-gram of level q
is inserted q times, with its levels 1..q; a count is read back by probing
levels upwards until one is missing.  A level's bits lie in two words.  The filter is made of segments, each built in one task from the n-grams that
hash to it and sized to them; there are as many as keep each below ``SEGMENT_BYTES``.  Segments that together fit ``limit`` bytes
are broadcast; beyond that the distinct n-grams of each chunk of texts travel to their segment instead, whose
bits are sent once, with the same answers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, U, blocks, crc_fold, mix, scan_words, shuffle_width, signed, stored, text_batches, text_key, unsigned

BASE = 1.5
BITS = 12
#: An n-gram of a level has its bits in so many words of the filter, and so many bits in each: a word is read once for all of them.
WORDS, WORD_BITS = 2, 3
#: Weight of the bigram estimate in the linear interpolation with the unigram estimate.
LAMBDA = 0.2
#: Exact token counts (16 bytes each) are broadcast up to this size and joined beyond it.
COUNT_BYTES = 128 << 20
FILTER_BYTES = 192 << 20
SEGMENT_BYTES = 8 << 20
#: Text whose n-grams are asked for together, once each.
CHUNK_BYTES = 4 << 20
END, BEGIN = mix(np.array([1], U))[0], mix(np.array([2], U))[0]
_PAIR, _STEP = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


def level_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(BASE) + 1e-9).astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """Middle of the counts that share a level; 0 for level 0."""
    low, high = np.ceil(BASE ** (levels - 1.0) - 1e-9), np.ceil(BASE ** levels.astype(float) - 1e-9) - 1
    return np.where(levels > 0, (low + np.maximum(low, high)) / 2, 0.0)


def bigram(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(mix(left + _PAIR) * _PAIR + right)


def tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes with one end after each text, first token of each text)."""
    w = scan_words(part.column("text"), lower=True, delimiter=SPACE)
    first = w.first + np.arange(len(w.first))
    out = np.full(first[-1], END, U)
    out[np.arange(len(w)) + w.row] = w.hashes()
    return out, first


def histories(toks: np.ndarray, first: np.ndarray) -> np.ndarray:
    left = np.empty_like(toks)
    left[1:] = toks[:-1]
    left[first[:-1]] = BEGIN
    return left


def _places(h: np.ndarray, words) -> tuple[np.ndarray, list[np.ndarray]]:
    """From a hash: a word of a segment of ``words`` words, and the bits in it."""
    at = ((h >> U(32)) * words >> U(32)).astype(np.int64)
    return at, [h >> U(6 * k) & U(63) for k in range(WORD_BITS)]


def build_segment(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bits of one segment as 64-bit words, sized by what goes in."""
    level = level_of(counts)
    total = int(level.sum())
    words = max(1, -(-total * BITS // 64))
    bits = np.zeros(words * 64, np.uint8)
    for q in range(1, int(level.max(initial=0)) + 1):
        h = mix(grams[level >= q] + np.array([q], U) * _STEP)
        for _ in range(WORDS):
            at, inside = _places(h, U(words))
            for bit in inside:
                bits[at * 64 + bit.astype(np.int64)] = 1
            h = mix(h + _PAIR)
    return np.packbits(bits, bitorder="little").view(U)


def probe_segment(table: np.ndarray, begin: np.ndarray, words: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Levels read for n-grams whose segment starts at word ``begin`` and has ``words`` words."""
    level, alive, q = np.zeros(len(grams), np.int64), np.arange(len(grams)), 1
    words = words.astype(U)
    while len(alive):
        h = mix(grams[alive] + np.array([q], U) * _STEP)
        for k in range(WORDS):
            if k:
                h = mix(h + _PAIR)
            at, inside = _places(h, words[alive])
            mask = U(1) << inside[0]
            for bit in inside[1:]:
                mask |= U(1) << bit
            on = np.flatnonzero(table[begin[alive] + at] & mask == mask)
            alive, h = alive[on], h[on]
        level[alive] = q
        q += 1
    return level


class Segments:
    """Filter segments side by side in one array."""

    def __init__(self, words: np.ndarray, parts):
        """``words``: the size of each segment; ``parts``: (segment, its bytes) in any order."""
        self.count, self.words = len(words), words
        self.begin = np.concatenate([[0], np.cumsum(words)[:-1]])
        self.table = np.zeros(int(words.sum()), U)
        for seg, raw in parts:
            self.table[self.begin[seg]:self.begin[seg] + words[seg]] = np.frombuffer(raw, U)

    def levels(self, grams: np.ndarray) -> np.ndarray:
        seg = segment_of(grams, self.count)
        out = np.zeros(len(grams), np.int64)
        on = np.flatnonzero(self.words[seg])
        out[on] = probe_segment(self.table, self.begin[seg[on]], self.words[seg[on]], grams[on])
        return out


def segment_of(grams: np.ndarray, count: int) -> np.ndarray:
    return ((grams >> U(32)) % U(count)).astype(np.int64)


# --- corpus counts -----------------------------------------------------------------------------------------------

def _count_batches(kind: str, segments: int):
    hold = 8_000_000

    def out(held):
        value, inverse = np.unique(np.concatenate([a for a, _ in held]), return_inverse=True)
        n = np.bincount(inverse, weights=np.concatenate([b for _, b in held])).astype(np.int64)
        for k in range(0, len(value), 1 << 20):
            part = value[k:k + (1 << 20)]
            yield pa.RecordBatch.from_arrays([pa.array(segment_of(part, segments), pa.int32()), signed(part), pa.array(n[k:k + (1 << 20)])], ["seg", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in blocks(batch):
                grams, first = tokens(part)
                if kind == "bigram":
                    grams = bigram(histories(grams, first), grams)
                held.append(np.unique(grams, return_counts=True))
                size += len(held[-1][0])
                if size > hold:
                    yield from out(held)
                    held, size = [], 0
        if held:
            yield from out(held)
    return run


def _build_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by segment: each segment is built when its last row has come."""
    held, now = [], None

    def out():
        words = build_segment(np.concatenate([g for g, _ in held]), np.concatenate([n for _, n in held]))
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([words.tobytes()], pa.binary())], ["seg", "bits"])

    for batch in batches:
        seg, gram, n = np.asarray(batch["seg"]), unsigned(batch["gram"]), np.asarray(batch["n"])
        cuts = np.concatenate([[0], np.flatnonzero(seg[1:] != seg[:-1]) + 1, [len(seg)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if seg[a] != now and held:
                yield out()
                held = []
            now = int(seg[a])
            held.append((gram[a:b], n[a:b]))
    if held:
        yield out()


class Model:
    """A trained model: exact token counts and the filter's segments as tables in the shared folder."""

    def __init__(self, counts: DataFrame, n: int, v: int, bits: DataFrame, segments: int, filter_bytes: int):
        self.counts, self.n, self.v, self.bits, self.segments, self.filter_bytes = counts, n, v, bits, segments, filter_bytes


def train(docs: DataFrame, segments: int | None = None) -> Model:
    """Count the tokens and bigrams of whole texts (null: empty) and build the filter."""
    spark = docs.sparkSession
    width = shuffle_width(spark)
    texts = text_batches(docs).select("text")
    schema = "seg int, gram long, n long"

    def counted(kind, segments=1):
        return texts.mapInArrow(_count_batches(kind, segments), schema)

    counts = stored(counted("token").groupBy("gram").agg(F.sum("n").alias("n")), "token-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # a level is at most its count, and tokens, begins and bigrams are at most n each: the whole filter is at most this large
    most = 3 * total.n * BITS // 8
    segments = segments or max(4 * width, -(-most // SEGMENT_BYTES))
    ends = counts.where(F.col("gram") == int(np.array([END]).view(np.int64)[0])).select(
        F.lit(int(np.array([BEGIN]).view(np.int64)[0])).alias("gram"), "n")  # each training text has one begin
    seg = F.pmod(F.shiftrightunsigned("gram", 32), F.lit(segments).cast("long")).cast("int")
    single = counts.unionByName(ends).select(seg.alias("seg"), "gram", "n")
    grams = single.unionByName(counted("bigram", segments)).repartition(width, "seg").groupBy("seg", "gram").agg(F.sum("n").alias("n"))
    bits = stored(grams.sortWithinPartitions("seg").mapInArrow(_build_batches, "seg int, bits binary"), "lm-filter")
    size = bits.agg(F.coalesce(F.sum(F.octet_length("bits")), F.lit(0)).alias("b")).first().b
    return Model(counts, total.n, total.v, bits, segments, size)


# --- scoring -----------------------------------------------------------------------------------------------------

def text_scores(toks, first, level_of_gram, n: int, v: int, weight: float, distinct=None) -> np.ndarray:
    """log10 probability of each text: weight * c(hw)/c(h) + (1 - weight) * (c(w)+1)/(n+v+1)."""
    value, inverse = distinct or np.unique(toks, return_inverse=True)
    c = count_of(level_of_gram(np.append(value, BEGIN)))
    own, before = c[inverse], np.empty(len(toks))
    before[1:] = own[:-1]
    before[first[:-1]] = c[-1]  # nothing but a begin stands before a text
    pair, at = np.unique(bigram(histories(toks, first), toks), return_inverse=True)
    seen = np.minimum(count_of(level_of_gram(pair))[at], before)
    unigram = (own + 1) / (n + v + 1)
    p = np.where(before > 0, weight * seen / np.maximum(before, 1) + (1 - weight) * unigram, unigram)
    return np.add.reduceat(np.log10(p), first[:-1]) if len(first) > 1 else np.zeros(0)


def base_scores(toks, first, gram, number, n: int, v: int, distinct=None) -> tuple[np.ndarray, np.ndarray]:
    """(n_known, base_score) of each text from sorted tokens and their counts."""
    value, inverse = distinct or np.unique(toks, return_inverse=True)
    c = np.zeros(len(value))
    if len(gram):
        at = np.minimum(np.searchsorted(gram, value), len(gram) - 1)
        c = np.where(gram[at] == value, number[at], 0)
    c = c[inverse]
    logs = np.log10(c + 1.0)
    return np.add.reduceat((c > 0).astype(np.int64), first[:-1]), np.add.reduceat(logs, first[:-1]) - np.diff(first) * math.log10(n + v + 1)


def _score_batches(columns, counts, segs, n, v, weight):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                toks, first = tokens(part)
                distinct = np.unique(toks, return_inverse=True)
                arrays = [part.column(c) for c in columns]
                names = [*columns, "n_tokens"]
                arrays.append(pa.array(np.diff(first), pa.int64()))
                if counts is not None:
                    arrays += map(pa.array, base_scores(toks, first, *counts.value, n, v, distinct))
                    names += ["n_known", "base_score"]
                if segs is not None:
                    arrays.append(pa.array(text_scores(toks, first, segs.value.levels, n, v, weight, distinct)))
                    names.append("score")
                yield pa.RecordBatch.from_arrays(arrays, names)
    return run


def _chunks(rows: DataFrame) -> DataFrame:
    """(chunk, text_key, text): the distinct texts, dealt into chunks; stored, so that a second reading finds the same texts in them."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, limit=CHUNK_BYTES):
                # named after its first text; should two chunks have one name, they count as one
                name = int.from_bytes(part["text_key"][0].as_py()[:8], "big", signed=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, name)), part["text_key"], part["text"]], ["chunk", "text_key", "text"])
    texts = rows.groupBy("text_key").agg(F.first("text").alias("text"))
    return stored(texts.mapInArrow(deal, "chunk long, text_key binary, text string"), "lm-chunks")


def _joined_counts(texts: DataFrame, model: Model) -> DataFrame:
    """(text_key, n_known, base_score) by joining the distinct tokens of each chunk of texts with the counts."""
    n, v = model.n, model.v

    def ask(part: pa.Table) -> pa.Table:
        grams = np.unique(tokens(part)[0])
        return pa.table({"chunk": pa.array(np.full(len(grams), part["chunk"][0].as_py())), "gram": signed(grams)})

    def score(part: pa.Table, got: pa.Table) -> pa.Table:
        gram, number = unsigned(got["gram"]), np.asarray(got["n"])
        order = np.argsort(gram)
        known, base = base_scores(*tokens(part), gram[order], number[order], n, v)
        return pa.table({"text_key": part["text_key"], "n_known": pa.array(known), "base_score": pa.array(base)})

    got = texts.groupBy("chunk").applyInArrow(ask, "chunk long, gram long").join(model.counts, "gram").select("chunk", "gram", "n")
    return texts.groupBy("chunk").cogroup(got.groupBy("chunk")).applyInArrow(score, "text_key binary, n_known long, base_score double")


def _chunk_grams(part, count: int):
    """(tokens, first, distinct n-grams, their order by segment, segments in that order); any order of the texts gives the same n-grams."""
    toks, first = tokens(part)
    left = histories(toks, first)
    grams = np.unique(np.concatenate([toks, left, bigram(left, toks)]))
    seg = segment_of(grams, count)
    order = np.argsort(seg, kind="stable")
    return toks, first, grams, order, seg[order]


def _binaries(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The bytes of ``values`` between each two of ``cuts``."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(((cuts - cuts[0]) * values.itemsize).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def _answer_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by segment, its bits first: one segment is held and all its requests are answered from it."""
    now, table = None, np.zeros(0, U)
    for batch in batches:
        seg, is_bits = np.asarray(batch["seg"]), np.asarray(batch["bits"].is_valid())
        raw = batch["grams"].fill_null(b"")
        size = np.asarray(pc.binary_length(raw)).astype(np.int64) // 8
        grams = np.frombuffer(b"".join(raw.to_pylist()), U)
        at = np.concatenate([[0], np.cumsum(size)])
        cuts = np.concatenate([[0], np.flatnonzero(seg[1:] != seg[:-1]) + 1, [len(seg)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if seg[a] != now:
                now, table = seg[a], np.zeros(0, U)
            if is_bits[a]:
                table = np.frombuffer(batch["bits"][int(a)].as_py(), U)
                a += 1
            g = grams[at[a]:at[b]]
            level = probe_segment(table, np.zeros(len(g), np.int64), np.full(len(g), len(table)), g) if len(table) else np.zeros(len(g), np.int64)
            if b > a:
                yield pa.RecordBatch.from_arrays([batch["chunk"].slice(a, b - a), batch["seg"].slice(a, b - a), _binaries(level.astype(np.uint8), at[a:b + 1])],
                                                 ["chunk", "seg", "levels"])


def _routed_scores(texts: DataFrame, model: Model, weight: float) -> DataFrame:
    """(text_key, score): distinct n-grams of each chunk of texts go to their segment and their levels come back."""
    width, count, n, v = shuffle_width(texts.sparkSession), model.segments, model.n, model.v

    def ask(part: pa.Table) -> pa.Table:
        _, _, grams, order, seg = _chunk_grams(part, count)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(seg)) + 1, [len(grams)]])
        return pa.table({"seg": pa.array(seg[cuts[:-1]], pa.int32()), "chunk": pa.array(np.full(len(cuts) - 1, part["chunk"][0].as_py())),
                         "grams": _binaries(grams[order], cuts)})

    def score(part: pa.Table, got: pa.Table) -> pa.Table:
        toks, first, grams, order, _ = _chunk_grams(part, count)
        by_seg = got.take(pa.array(np.argsort(np.asarray(got["seg"]))))
        level = np.zeros(len(grams), np.int64)
        level[order] = np.frombuffer(b"".join(by_seg["levels"].to_pylist()), np.uint8)
        scores = text_scores(toks, first, lambda g: level[np.searchsorted(grams, g)], n, v, weight)
        return pa.table({"text_key": part["text_key"], "score": pa.array(scores, pa.float64())})

    asked = texts.groupBy("chunk").applyInArrow(ask, "seg int, chunk long, grams binary")
    both = asked.withColumn("bits", F.lit(None).cast("binary")).unionByName(
        model.bits.select("seg", F.lit(None).cast("long").alias("chunk"), F.lit(None).cast("binary").alias("grams"), "bits"))
    answers = both.repartition(width, "seg").sortWithinPartitions("seg", F.col("bits").isNull()) \
        .mapInArrow(_answer_batches, "chunk long, seg int, levels binary")
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, "text_key binary, score double")


def _sorted_counts(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    batches = counts.toArrow().to_batches()
    gram = np.concatenate([unsigned(b["gram"]) for b in batches] or [np.zeros(0, U)])
    n = np.concatenate([np.asarray(b["n"]) for b in batches] or [np.zeros(0, np.int64)])
    del batches
    order = np.argsort(gram)
    return gram[order], n[order]


def score(docs: DataFrame, model: Model, weight: float = LAMBDA, filter_limit: int = FILTER_BYTES, count_limit: int = COUNT_BYTES) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    Tokens are lower-cased (A-Z) words and one end; a null or empty text is one end.  ``score`` is the log10 probability
    by linear interpolation of the filter's bigram and add-one unigram estimates, base_score the exact add-one unigram
    score.  With nothing to train on every token is unknown.  Repeated rows get equal scores; other columns are not read.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = text_batches(docs).select("doc_id", text_key().alias("text_key"), "text")
    counts = segs = None
    if 16 * model.v <= count_limit:
        counts = spark.sparkContext.broadcast(_sorted_counts(model.counts))
    if model.filter_bytes <= filter_limit:
        words = np.zeros(model.segments, np.int64)
        for r in model.bits.select("seg", F.octet_length("bits").alias("b")).toLocalIterator():
            words[r.seg] = r.b // 8
        segs = spark.sparkContext.broadcast(Segments(words, ((r.seg, r.bits) for r in model.bits.toLocalIterator())))
    schema = f"doc_id {kind}, text_key binary, n_tokens long"
    schema += ", n_known long, base_score double" if counts else ""
    schema += ", score double" if segs else ""
    out = rows.mapInArrow(_score_batches(["doc_id", "text_key"], counts, segs, model.n, model.v, weight), schema)
    texts = None if counts and segs else _chunks(rows)
    if not counts:
        out = out.join(_joined_counts(texts, model), "text_key", "left")
    if not segs:
        out = out.join(_routed_scores(texts, model, weight), "text_key", "left")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")


def score_held_out(docs: DataFrame, folds: int = 7, held: int = 2, **limits) -> DataFrame:
    """Train on the rows whose crc32 fold is not ``held`` and score all rows; adds held_out."""
    fold = crc_fold("doc_id", folds)
    model = train(docs.where(fold != held))
    return score(docs, model, **limits).withColumn("held_out", fold == held)
