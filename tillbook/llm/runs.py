"""Periodic runs of words: stretches in which the same few words come again and again.

A run of period p and at least ``times`` * p words covers a point of the grid of every p: the multiples of its
shortest length less p.  Each grid point x is compared with x + p; how far the match goes on to the right and to
the left comes from longest common extensions.  Most pairs are settled by a few words.  For texts in which one is
not, the suffixes at the places of a difference cover are sorted, and an extension is found by comparing fewer
than ``MODULUS`` words to reach a pair of sorted suffixes, then one range minimum over their common prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import U, blocks, scan_words, text_batches

LEAST, TIMES = 6, 4
#: Every difference modulo MODULUS is the difference of two members of COVER.
MODULUS, COVER = 31, np.array([0, 1, 3, 8, 12, 18])
#: Pairs compared at a time.
PAIRS = 1 << 20

_WHERE = np.full(MODULUS, -1)
_WHERE[COVER] = np.arange(len(COVER))


def _shifts() -> np.ndarray:
    """shift[i, j]: the fewest steps that bring places i and j (modulo MODULUS) both onto the cover."""
    step = np.arange(MODULUS)
    on = _WHERE[(step[:, None] + step) % MODULUS] >= 0  # on[i, d]: i + d is in the cover
    return (on[:, None, :] & on[None, :, :]).argmax(2)


SHIFT = _shifts()


class Extensions:
    """Longest common extensions to the right in a sequence of small whole numbers whose last one is unique."""

    def __init__(self, ids: np.ndarray):
        n, size = len(ids), len(COVER)
        self.ids = np.concatenate([ids, ids.max() + 1 + np.arange(2 * MODULUS)]).astype(np.int32)
        self.place = (np.arange(-(-n // MODULUS))[:, None] * MODULUS + COVER).ravel()
        m = len(self.place)
        order = np.arange(m)
        for k in range(MODULUS - 1, -1, -1):
            order = order[np.argsort(self.ids[self.place[order] + k], kind="stable")]
        rank, ranks = self._name(order, self._few(self.place[order[:-1]], self.place[order[1:]]) < MODULUS), []
        while True:
            ranks.append(rank)
            if rank.max() == m - 1:
                break
            ahead = np.zeros(m, np.int64)
            step = size << len(ranks) - 1
            ahead[:max(0, m - step)] = rank[step:] + 1
            key = rank.astype(np.int64) * (m + 1) + ahead
            order = np.argsort(key, kind="stable")
            rank = self._name(order, key[order[1:]] != key[order[:-1]])
        self.rank = rank
        order = np.argsort(rank)
        a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(m - 1, np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            inside = np.flatnonzero(np.maximum(a, b) < m)
            same = inside[ranks[level][a[inside]] == ranks[level][b[inside]]]
            common[same] += MODULUS << level
            a[same] += size << level
            b[same] += size << level
        common += self._few(self.place[order[:-1]] + common, self.place[order[1:]] + common)
        self.lowest = [common]
        while 2 << len(self.lowest) - 1 <= len(common):
            last, half = self.lowest[-1], 1 << len(self.lowest) - 1
            self.lowest.append(np.minimum(last[:-half], last[half:]))

    @staticmethod
    def _name(order: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        rank = np.zeros(len(order), np.int64)
        rank[order[1:]] = np.cumsum(fresh)
        return rank

    def _few(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Equal words from x and y on, MODULUS at most."""
        return matched(self.ids, x, y, 1, MODULUS)

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Number of equal words from places x and y on (x < y)."""
        shift = SHIFT[x % MODULUS, y % MODULUS]
        length = matched(self.ids, x, y, 1, shift)
        far = np.flatnonzero(length == shift)
        i, j = (self.rank[p // MODULUS * len(COVER) + _WHERE[p % MODULUS]] for p in (x[far] + shift[far], y[far] + shift[far]))
        low, high = np.minimum(i, j), np.maximum(i, j)
        level = np.frexp((high - low).astype(float))[1] - 1
        for k in np.unique(level):
            on = level == k
            table = self.lowest[k]
            length[far[on]] += np.minimum(table[low[on]], table[high[on] - (1 << k)])
        return length


def matched(seq: np.ndarray, x: np.ndarray, y: np.ndarray, step: int, most) -> np.ndarray:
    """How many words from x and y on, in direction ``step``, are equal: at most ``most`` (a number or one per pair)."""
    most = np.broadcast_to(most, len(x))
    out = np.zeros(len(x), np.int64)
    live = np.flatnonzero(most > 0)
    k = 0
    while len(live):
        live = live[seq[x[live] + k * step] == seq[y[live] + k * step]]
        k += 1
        out[live] = k
        live = live[most[live] > k]
    return out


def grid_pairs(first: np.ndarray, counts: np.ndarray, least: int, times: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, x, period) of all grid points, about PAIRS at a time; first and counts: place and number of each text's words."""
    most = np.where(counts >= least, counts // times, 0)
    edge = np.concatenate([[0], np.cumsum(most)])
    at = 0
    while at < edge[-1]:
        to = min(at + PAIRS, edge[-1])
        text = np.searchsorted(edge, np.arange(at, to), "right") - 1
        period = np.arange(at, to) - edge[text] + 1
        step = np.maximum(least, times * period) - period
        points = -(-(counts[text] - period) // step)
        total = np.cumsum(points)
        keep = max(1, int(np.searchsorted(total, PAIRS, "right")))
        text, period, step, points = text[:keep], period[:keep], step[:keep], points[:keep]
        nth = np.arange(points.sum()) - np.repeat(np.cumsum(points) - points, points)
        yield np.repeat(text, points), np.repeat(first[text], points) + nth * np.repeat(step, points), np.repeat(period, points)
        at += keep


def _smallest(text, start, end, period):
    """One row per stretch, with its smallest period."""
    order = np.lexsort((period, end, start, text))
    text, start, end, period = text[order], start[order], end[order], period[order]
    head = np.ones(len(text), bool)
    head[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return text[head], start[head], end[head], period[head]


def _found(seq, first, counts, least, times, right, left):
    """Runs that ``right`` and ``left`` extensions give, and the texts for which one of them is not known."""
    none = np.zeros(0, np.int64)
    rows, unsure = [(none,) * 4], np.zeros(len(counts), bool)
    for text, x, period in grid_pairs(first, counts, least, times):
        on = np.flatnonzero(seq[x] == seq[x + period])
        text, x, period = text[on], x[on], period[on]
        ahead, sure_ahead = right(x, x + period)
        back, sure_back = left(x - 1, x + period - 1)
        unsure[text[~(sure_ahead & sure_back)]] = True
        run = np.flatnonzero(ahead + back + period >= np.maximum(least, times * period))
        rows.append(_smallest(text[run], x[run] - back[run], x[run] + period[run] + ahead[run], period[run]))
    return _smallest(*(np.concatenate(c) for c in zip(*rows, strict=True))), unsure


def _with_ends(words: np.ndarray, counts: np.ndarray, first: np.ndarray):
    """The words of all texts between single numbers that stand nowhere else, and the place of each text's first word."""
    texts = len(counts)
    seq = np.empty(counts.sum() + texts + 1, U)
    place = np.concatenate([[0], np.cumsum(counts + 1)])
    seq[place] = np.arange(texts + 1, dtype=U)
    size = np.repeat(np.cumsum(counts) - counts, counts)
    nth = np.arange(counts.sum()) - size
    seq[np.repeat(place[:-1] + 1, counts) + nth] = words[np.repeat(first, counts) + nth]
    return seq, place[:-1] + 1


def periodic_runs(words: np.ndarray, first: np.ndarray, counts: np.ndarray, least: int = LEAST, times: int = TIMES):
    """(text, start, end, period), in this order, of all runs; start and end are word numbers inside the text."""
    seq, place = _with_ends(words, counts, first)

    def few(step):
        def extend(x, y):
            length = matched(seq, x, y, step, MODULUS)
            return length, length < MODULUS
        return extend

    runs, unsure = _found(seq, place, counts, least, times, few(1), few(-1))
    keep = ~unsure[runs[0]]
    out = [(runs[0][keep], runs[1][keep] - place[runs[0][keep]], runs[2][keep] - place[runs[0][keep]], runs[3][keep])]
    some = np.flatnonzero(unsure)
    if len(some):
        seq, place = _with_ends(words, counts[some], first[some])
        ids = np.unique(seq, return_inverse=True)[1]
        right, reverse, last = Extensions(ids), Extensions(ids[::-1]), len(ids) - 1

        def known(extension):
            return lambda x, y: (extension(x, y), np.ones(len(x), bool))

        (text, start, end, period), _ = _found(seq, place, counts[some], least, times, known(right),
                                               known(lambda x, y: reverse(last - y, last - x)))
        out.append((some[text], start - place[text], end - place[text], period))
    text, start, end, period = (np.concatenate(c) for c in zip(*out, strict=True))
    order = np.lexsort((period, start, text))
    return text[order], start[order], end[order], period[order]


def _run_batches(least: int, times: int, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                w = scan_words(part.column("text"))
                text, start, end, period = periodic_runs(w.hashes(), w.first[:-1], w.counts, least, times)
                gone = np.zeros(len(w) + 1, np.int64)
                np.add.at(gone, w.first[text] + start + period, 1)
                np.subtract.at(gone, w.first[text] + end, 1)
                kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
                size = w.ends[kept] - w.starts[kept] + 1
                place = np.concatenate([[0], np.cumsum(size)])
                source = np.repeat(w.starts[kept] - place[:-1], size) + np.arange(place[-1])
                source[place[1:] - 1] = 0
                joined = w.buf[source] if len(source) else np.zeros(0, np.uint8)
                joined[place[1:] - 1] = 0x20
                first = np.searchsorted(kept, w.first)
                raw = joined.tobytes()
                texts = [raw[place[a]:max(place[a], place[b] - 1)].decode() for a, b in zip(first[:-1], first[1:], strict=True)]
                heads = np.searchsorted(text, np.arange(part.num_rows + 1))
                parts = [pa.array(x, pa.int64()) for x in (start, end - start, period)]
                runs = pa.ListArray.from_arrays(pa.array(heads, pa.int32()), pa.StructArray.from_arrays(parts, ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in carry], pa.array(w.counts, pa.int64()), runs, pa.array(texts, pa.string())],
                                                 [*carry, "n_words", "runs", "collapsed"])
    return run


RUN = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, carry: list[str] | None = None) -> DataFrame:
    """row (the columns named by ``carry``, all by default; without the text), n_words, runs, collapsed for every row.

    ``runs`` lists the maximal stretches whose words come again after ``period`` words (their smallest period), with at
    least ``least`` words and ``times`` periods, by start, then period; words are numbered from 0.  ``collapsed`` joins by one
    space the words that no run holds beyond its first period.  Words are compared by 64-bit hashes, exactly as written.
    Null, empty and wordless texts have no words, no runs and an empty ``collapsed``; repeated rows get equal results; an empty table
    gives no rows; ``row`` keeps its columns whatever their names.  A text is handled in one piece (a few hundred bytes of
    memory for each of its words at most), a block of short ones together.
    """
    carry = [c for c in (carry or docs.columns) if c != "text"]
    rows = text_batches(docs).select(F.struct(*[docs[c] for c in carry]).alias("row"), docs["text"])
    schema = StructType([rows.schema["row"], StructField("n_words", LongType()), StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())])
    return rows.mapInArrow(_run_batches(least, times, ["row"]), schema)
