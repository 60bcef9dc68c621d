"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Cosines of random projections approximate a Gaussian kernel over the
standardised statistics.  Each partition sums its part of the normal equations; the sums
are added up in Spark and one small system is solved.  An isotonic curve, fitted on
training rows that the ridge did not see, turns raw scores into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import SPACE, U, blocks, crc_fold, mix, scan_words, small, text_batches, text_buffer

FEATURES = 384
GAMMA = 0.35  # width of the kernel over statistics with unit variance, per statistic
RIDGE = 1e-3
BINS = 2000
SUMS = 16  # partial sums that reach the driver
THRESHOLD = 0.7

_CLASS = np.zeros((6, 256), bool)
_CLASS[0, 0x41:0x5B] = True  # A-Z
_CLASS[1, 0x30:0x3A] = True  # digits
_CLASS[2, [ord(c) for c in ".,;:?'\"()-"]] = True
_CLASS[3, [ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = True
_CLASS[4, 0x80:] = True
_CLASS[5] = SPACE


def _per_row(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, weights=values, minlength=n)[:n]


def statistics(col: pa.Array) -> np.ndarray:
    """One row of statistics per text; all come from whole texts, zero where a text has nothing to measure."""
    n = len(col)
    buf, offsets = text_buffer(col)
    size = np.diff(offsets).astype(float)
    classes = []
    for kind in _CLASS:
        at = np.concatenate([[0], np.cumsum(kind[buf], dtype=np.int32)])
        classes.append((at[offsets[1:]] - at[offsets[:-1]]) / np.maximum(size, 1))

    w = scan_words(col)
    words = w.counts.astype(float)
    per = np.maximum(words, 1)
    length = (w.ends - w.starts).astype(float)
    mean = _per_row(length, w.row, n) / per
    spread = np.sqrt(np.maximum(_per_row(length**2, w.row, n) / per - mean**2, 0))
    h = scan_words(col, lower=True).hashes() if len(w) else np.zeros(0, U)
    same = np.zeros(len(w))
    same[1:] = (h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1])
    order = np.argsort(mix(w.row.astype(U) + U(1)) ^ h) if len(w) else np.zeros(0, int)
    hr, rr = h[order], w.row[order]
    new = np.concatenate([[True], (hr[1:] != hr[:-1]) | (rr[1:] != rr[:-1])])[:len(hr)]
    kinds = _per_row(new.astype(float), rr, n)
    heads = np.flatnonzero(new)
    times = np.diff(np.append(heads, len(hr))).astype(float)
    most, entropy = np.zeros(n), np.zeros(n)
    np.maximum.at(most, rr[heads], times)
    share = times / per[rr[heads]]
    entropy = -_per_row(share * np.log(share), rr[heads], n)
    first_byte = buf[w.starts] if len(w) else np.zeros(0, np.uint8)
    last_byte = buf[w.ends - 1] if len(w) else np.zeros(0, np.uint8)
    symbol_end = _per_row(_CLASS[3][last_byte].astype(float), w.row, n) / per
    stop_end = _per_row((last_byte == ord(".")).astype(float), w.row, n) / per
    capital = _per_row(_CLASS[0][first_byte].astype(float), w.row, n) / per
    lone = _per_row((length == 1).astype(float), w.row, n) / per
    long = _per_row((length > 18).astype(float), w.row, n) / per

    newline = np.zeros(256, bool)
    newline[0x0A] = True
    newline[0x0D] = True
    lines = scan_words(col, delimiter=newline)
    n_lines = np.maximum(lines.counts.astype(float), 1)
    lh = lines.hashes() if len(lines) else np.zeros(0, U)
    lorder = np.argsort(mix(lines.row.astype(U) + U(1)) ^ lh) if len(lines) else np.zeros(0, int)
    lhr, lrr = lh[lorder], lines.row[lorder]
    fresh = np.concatenate([[True], (lhr[1:] != lhr[:-1]) | (lrr[1:] != lrr[:-1])])[:len(lhr)]
    line_repeat = 1 - _per_row(fresh.astype(float), lrr, n) / n_lines
    line_repeat[lines.counts == 0] = 0
    return np.stack([np.log1p(size), np.log1p(words), *classes, mean, spread, _per_row(same, w.row, n) / per,
                     kinds / per, kinds / np.maximum(per, 1)**0.8, most / per, entropy / np.log(per + 1), symbol_end, stop_end, capital, lone, long,
                     np.log1p(n_lines), np.log1p(words / n_lines), line_repeat], axis=1)


def statistics_count() -> int:
    return statistics(pa.array(["a"])).shape[1]


class Kernel:
    """Standardisation and random Fourier features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, np.where(scale > 1e-9, scale, 1.0)
        self.turn = rng.normal(scale=np.sqrt(2 * GAMMA / len(mean)), size=(len(mean), features))
        self.shift = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.sqrt(2 / len(self.shift)) * np.cos(z @ self.turn + self.shift), z / 10, np.ones((len(x), 1))], axis=1)


class Classifier:
    """A fitted model: raw ridge score, then the isotonic curve (constant between its steps)."""

    def __init__(self, kernel: Kernel | None, weights, edges, values):
        self.kernel, self.weights, self.edges, self.values = kernel, weights, edges, values

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.kernel(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.kernel is None:
            return np.ones(len(x))
        return np.interp(self.raw(x), self.edges, self.values)


def _summed(df: DataFrame, make, width: int) -> np.ndarray:
    """Sum of make(statistics, label) -> vector over all rows: per partition, then in SUMS tasks, then here."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for piece in blocks(batch):
                total += make(statistics(piece.column("text")), np.asarray(piece["quality"]).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for v in batch["v"]:
                total += np.frombuffer(v.as_py(), float)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    sums = df.mapInArrow(part, "v binary").repartition(SUMS).mapInArrow(add, "v binary")
    return sum((np.frombuffer(r.v, float) for r in sums.toLocalIterator()), np.zeros(width))


def isotonic(hits: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Non-decreasing rates that fit hits/totals best, by merging neighbours that are out of order."""
    stack: list[list[float]] = []
    for a, b in zip(hits, totals, strict=True):
        stack.append([a, b, 1])
        while len(stack) > 1 and stack[-2][0] * stack[-1][1] >= stack[-1][0] * stack[-2][1]:
            a1, b1, k = stack.pop()
            stack[-1] = [stack[-1][0] + a1, stack[-1][1] + b1, stack[-1][2] + k]
    return np.concatenate([np.full(int(k), a / b) for a, b, k in stack] or [np.zeros(0)])


def fit(labelled: DataFrame, features: int = FEATURES, ridge: float = RIDGE) -> Classifier:
    """Fit on rows (text, quality 0/1, calibrate boolean): the ridge on the others, the curve on those with calibrate.

    All given rows count; without rows of both labels the model scores every text 1.
    """
    learn, tune = labelled.where("not calibrate").select("text", "quality"), labelled.where("calibrate").select("text", "quality")
    d = statistics_count()
    moments = _summed(learn, lambda x, y: np.concatenate([[len(x), y.sum()], x.sum(0), (x**2).sum(0)]), 2 + 2 * d)
    n, ones = moments[:2]
    if not 0 < ones < n:
        return Classifier(None, None, None, None)
    mean = moments[2:2 + d] / n
    kernel = Kernel(mean, np.sqrt(np.maximum(moments[2 + d:] / n - mean**2, 0)), features)
    width = features + d + 1
    # both labels weigh the same, however rare one is
    weight = np.array([n / (2 * (n - ones)), n / (2 * ones)])

    def equations(x, y):
        z, k = kernel(x), weight[y.astype(int)]
        return np.concatenate([((z * k[:, None]).T @ z).ravel(), z.T @ (k * y)])

    sums = _summed(learn, equations, width * width + width)
    a, b = sums[:width * width].reshape(width, width), sums[width * width:]
    weights = np.linalg.solve(a + ridge * n * np.eye(width) / features, b)
    model = Classifier(kernel, weights, None, None)
    edges = np.linspace(-0.5, 1.5, BINS + 1)

    def binned(x, y):
        at = np.clip(np.searchsorted(edges, model.raw(x)) - 1, 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS)])

    counts = _summed(tune, binned, 2 * BINS)
    used = np.flatnonzero(counts[:BINS])
    if not len(used):
        return Classifier(kernel, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    rates = isotonic(counts[BINS:][used], counts[:BINS][used])
    return Classifier(kernel, weights, (edges[used] + edges[used + 1]) / 2, np.clip(rates, 0, 1))


def labelled_rows(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Training rows: labelled documents outside the held-out fold; one of the other folds calibrates.

    A document with several labels counts once for each; null and other labels than 0 and 1 are left out.
    """
    fold = crc_fold("doc_id", folds)
    marks = labels.where("quality in (0, 1) and doc_id is not null").where(fold != held).select("doc_id", "quality").distinct()
    return text_batches(docs).select("doc_id", "text").join(small(marks, marks.count(), 32), "doc_id") \
        .select("text", "quality", (fold == (held + 1) % folds).alias("calibrate"))


def score(docs: DataFrame, model: Classifier, carry: list[str] | None = None) -> DataFrame:
    """The columns named by ``carry`` (all by default; the text beside them) in a struct ``row``, and score (0 to 1; higher: label 1 likelier) for every row.

    Only the text is read; a null text counts as empty and equal texts have equal scores.
    """
    carry = carry or docs.columns
    rows = text_batches(docs.select(F.struct(*[docs[c] for c in carry if c != "text"]).alias("row"), docs["text"]))
    kept = ["row", "text"] if "text" in carry else ["row"]
    schema = StructType([*[rows.schema[c] for c in kept], StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(model.score(statistics(part.column("text"))))], [*kept, "score"])
    return rows.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Fit on the labelled rows outside the held-out fold and score every row of ``docs``; see ``score``."""
    return score(docs, fit(labelled_rows(docs, labels, folds, held)))
