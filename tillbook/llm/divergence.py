"""Source divergence audit: how far the sources of a language part from each other in their terms.

The first pass counts exactly in how many documents of its language each term occurs and keeps those of enough
documents.  The kept terms of a language are dealt to shards by hash; every shard gets a minimal perfect hash (levels of
bits, a key's slot is the rank of its bit) with the terms themselves beside it, so that a word is taken for a term
only when its bytes are the stored ones.  The second pass looks up the slots of all words and adds them
into one dense row of slots per shard and (language, source) group.  The shards are broadcast while they fit ``limit`` bytes; beyond, the counts of each task's terms travel to their
shard, which leads its partition.  Both ways use the same hashes and give the same counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, U, blocks, mix, scan_words, shuffle_width, signed, small, stored, text_batches, text_buffer, unsigned

#: Documents of its language that a kept term occurs in, and best terms that are told of each group.
LEAST_DOCS, BEST = 3, 200
#: Shares are told in billionths: three steps of a thousand.
UNIT_STEPS = 3
#: Terms of a shard: few enough that the shard's counts of all sources stay below CELLS, between FEWEST and MOST.
MOST, FEWEST, CELLS = 8192, 64, 1 << 22
#: Text of a block, and counts that a task holds before it sends them on.
TERM_BLOCK, HELD_ROWS = 2 << 20, 1 << 21
#: More than a shard has slots.
SLOTS = 1 << 32
#: Bits of a level for each key that it may place.
SPREAD = 2

LETTER_GAPS = np.ones(256, bool)
LETTER_GAPS[0x80:] = False
LETTER_GAPS[0x41:0x5B] = False
LETTER_GAPS[0x61:0x7B] = False


class PerfectHash:
    """Slots 0..n-1 of n terms, from their 64-bit hashes; ``find`` checks the stored bytes."""

    def __init__(self, bits: np.ndarray, levels: list[int], offsets: np.ndarray, raw: np.ndarray):
        self.bits, self.levels, self.offsets, self.raw = bits, levels, offsets, raw
        self.rank = np.concatenate([[0], np.cumsum(bits)])
        #: Terms that share all 64 bits with another have no bit: they are the last slots, compared one by one.
        self.rest = {raw[offsets[k]:offsets[k + 1]].tobytes(): k for k in range(self.rank[-1], len(offsets) - 1)}

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + mix(np.full(1, level + 1, U))) % U(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, terms: list[bytes]) -> "PerfectHash":
        unique, n = np.unique(keys, return_counts=True)
        left, bits, levels = unique[n == 1], [np.zeros(0, bool)], []
        while len(left):
            size = SPREAD * len(left) + 1
            at = cls._place(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(alone)
            levels.append(size)
            left = left[~alone[at]]
        empty = cls(np.concatenate(bits), levels, np.zeros(1, np.int64), np.zeros(0, np.uint8))
        slot = empty.slots(keys)
        slot[np.isin(keys, unique[n > 1])] = -1
        rest = np.flatnonzero(slot < 0)
        slot[rest] = len(keys) - len(rest) + np.arange(len(rest))
        order = np.argsort(slot)
        offsets = np.concatenate([[0], np.cumsum([len(terms[i]) for i in order])]).astype(np.int64)
        return cls(empty.bits, levels, offsets, np.frombuffer(b"".join(terms[i] for i in order), np.uint8))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where the levels hold none; a foreign key may get any slot."""
        out, live, start = np.full(len(keys), -1), np.arange(len(keys)), 0
        for level, size in enumerate(self.levels):
            at = start + self._place(keys[live], level, size)
            hit = self.bits[at]
            out[live[hit]] = self.rank[at[hit]]
            live, start = live[~hit], start + size
        return out

    def find(self, keys: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The slot of each word buf[start:end] with these hashes; -1 for words that are no term."""
        slot = self.slots(keys)
        has = np.flatnonzero(slot >= 0)
        size = ends[has] - starts[has]
        has = has[size == np.diff(self.offsets)[slot[has]]]
        size = ends[has] - starts[has]
        place = np.cumsum(size) - size
        nth = np.arange(size.sum()) - np.repeat(place, size)
        equal = buf[np.repeat(starts[has], size) + nth] == self.raw[np.repeat(self.offsets[slot[has]], size) + nth]
        sound = np.logical_and.reduceat(equal, place) if len(has) else np.zeros(0, bool)
        out = np.full(len(keys), -1)
        out[has[sound]] = slot[has[sound]]
        if self.rest:
            for k in np.flatnonzero(out < 0):
                out[k] = self.rest.get(buf[starts[k]:ends[k]].tobytes(), -1)
        return out

    def terms(self) -> list[bytes]:
        raw = self.raw.tobytes()
        return [raw[a:b] for a, b in zip(self.offsets[:-1], self.offsets[1:], strict=True)]

    def row(self) -> tuple[bytes, bytes]:
        """(hash, keys): the form in which shards are stored and sent."""
        head = np.array([len(self.levels), *self.levels], "<i8")
        return head.tobytes() + np.packbits(self.bits).tobytes(), self.offsets.astype("<i8").tobytes() + self.raw.tobytes()

    @classmethod
    def of(cls, hash_: bytes, keys: bytes, n: int) -> "PerfectHash":
        depth = int(np.frombuffer(hash_, "<i8", 1)[0])
        levels = np.frombuffer(hash_, "<i8", depth, 8).tolist()
        bits = np.unpackbits(np.frombuffer(hash_, np.uint8, offset=8 + 8 * depth), count=sum(levels)).astype(bool)
        return cls(bits, levels, np.frombuffer(keys, "<i8", n + 1), np.frombuffer(keys, np.uint8, offset=8 * (n + 1)))


def _labels(part: pa.RecordBatch, names: list[str]) -> tuple[np.ndarray, list[tuple[str, ...]]]:
    """A number per row for its values of these columns, and the values behind the numbers."""
    values = list(zip(*(part.column(c).to_pylist() for c in names), strict=True))
    seen: dict[tuple[str, ...], int] = {}
    code = np.array([seen.setdefault(v, len(seen)) for v in values], np.int64)
    return code, list(seen)


def _strings(w, at: np.ndarray) -> pa.Array:
    """The words at these places as an Arrow column."""
    size = w.ends[at] - w.starts[at]
    offsets = np.concatenate([[0], np.cumsum(size)])
    raw = w.buf[np.repeat(w.starts[at] - offsets[:-1], size) + np.arange(offsets[-1])] if len(at) else np.zeros(0, np.uint8)
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw)))


def _term_blocks(batch: pa.RecordBatch, names: list[str]):
    """(words, term number per word, first word of each term, hash per term, group per word, groups) of each block."""
    for part in blocks(batch, limit=TERM_BLOCK):
        w = scan_words(part.column("text"), True, LETTER_GAPS)
        if not len(w):
            continue
        keys, lead, term = np.unique(w.hashes(), return_index=True, return_inverse=True)
        code, groups = _labels(part, names)
        yield w, term, lead, keys, code, groups


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for w, term, lead, keys, code, groups in _term_blocks(batch, ["lang"]):
            once = np.unique(w.row * len(keys) + term)
            pair, n = np.unique(code[once // len(keys)] * len(keys) + once % len(keys), return_counts=True)
            at = pair % len(keys)
            lang = pa.array([g[0] for g in groups]).take(pa.array(pair // len(keys)))
            yield pa.RecordBatch.from_arrays([lang, _strings(w, lead[at]), signed(keys[at]), pa.array(n, pa.int64())], ["lang", "term", "h", "n"])


def _shard(table: pa.Table) -> pa.Table:
    terms = [t.encode() for t in table["term"].to_pylist() if t is not None]
    keys = unsigned(table["h"].drop_null())
    hash_, stored_keys = PerfectHash.build(keys, terms).row()
    return pa.table({"lang": table["lang"][:1], "shard": table["shard"][:1], "n": pa.array([len(terms)], pa.int32()),
                     "hash": pa.array([hash_], pa.binary()), "keys": pa.array([stored_keys], pa.binary())})


_SHARD = "lang string, shard long, n int, hash binary, keys binary"
_MET = "lang string, shard long, sources array<string>, slots array<array<int>>, counts array<array<long>>"
_COUNTS = "lang string, shard long, source string, slots array<int>, counts array<long>"


class Held:
    """Counts of a task by (lang, shard): numbers of source and slot, sent on as one row per shard."""

    def __init__(self):
        self.sources: dict[str, int] = {}
        self.parts: list[tuple[str, int, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, lang: str, shard: int, source: np.ndarray, slot: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((lang, shard, source * SLOTS + slot, n))
        self.size += len(n)

    def number(self, source: str) -> int:
        return self.sources.setdefault(source, len(self.sources))

    def rows(self) -> Iterator[pa.RecordBatch]:
        """Batches of lang, shard, source, slots, counts: lists with an entry for each count, sources by name."""
        names = pa.array(list(self.sources), pa.string())
        by: dict[tuple[str, int], list] = {}
        for lang, shard, at, n in self.parts:
            by.setdefault((lang, shard), []).append((at, n))
        for (lang, shard), parts in by.items():
            at, place = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
            n = np.bincount(place, np.concatenate([x for _, x in parts]).astype(float)).astype(np.int64)
            number, first = np.unique(at // SLOTS, return_index=True)
            edge = pa.array(np.append(first, len(at)), pa.int32())
            wrap = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang], pa.string()), pa.array([shard], pa.int64()), wrap(names.take(pa.array(number))),
                 wrap(pa.ListArray.from_arrays(edge, pa.array(at % SLOTS, pa.int32()))), wrap(pa.ListArray.from_arrays(edge, pa.array(n)))],
                ["lang", "shard", "sources", "slots", "counts"])
        self.__init__()


def _recount(shards):
    """Slot counts of a task's groups by broadcast shards."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {lang: [PerfectHash.of(*x) for x in rows] for lang, rows in shards.value.items()}
        held = Held()
        for batch in batches:
            for w, term, lead, keys, code, groups in _term_blocks(batch, ["lang", "source"]):
                pair, n = np.unique(code[w.row] * len(keys) + term, return_counts=True)
                group, word = pair // len(keys), pair % len(keys)
                langs = [g[0] for g in groups]
                number = np.array([held.number(g[1]) for g in groups])
                for lang in dict.fromkeys(langs[g] for g in np.unique(group)):
                    own = np.flatnonzero(np.array([x == lang for x in langs])[group])
                    home = np.mod(keys[word[own]].view(np.int64), len(tables[lang]))
                    order = np.argsort(home, kind="stable")
                    own, home = own[order], home[order]
                    shard, first = np.unique(home, return_index=True)
                    for k, part in zip(shard.tolist(), np.split(own, first[1:]), strict=True):
                        at, place = np.unique(word[part], return_inverse=True)
                        slot = tables[lang][k].find(keys[at], w.buf, w.starts[lead[at]], w.ends[lead[at]])[place]
                        on = slot >= 0
                        held.add(lang, k, number[group[part[on]]], slot[on], n[part[on]])
                if held.size > HELD_ROWS:
                    yield from held.rows()
        yield from held.rows()
    return run


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of every block with their counts by group, for the way without a broadcast."""
    for batch in batches:
        for w, term, lead, keys, code, groups in _term_blocks(batch, ["lang", "source"]):
            pair, n = np.unique(code[w.row] * len(keys) + term, return_counts=True)
            at, group = pair % len(keys), pa.array(pair // len(keys))
            lang, source = (pa.array([g[i] for g in groups]).take(group) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([lang, source, signed(keys[at]), _strings(w, lead[at]), pa.array(n, pa.int64())],
                                             ["lang", "source", "h", "term", "n"])


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of asked terms; rows come by (lang, shard), the shard's hash first."""
    shard, held = None, Held()
    for batch in batches:
        if not batch.num_rows:
            continue
        code, groups = _labels(batch, ["lang", "shard", "source"])
        edge = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1], [True]]))
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            lang, number, source = groups[code[a]]
            part = batch.slice(a, b - a)
            if source is None:  # the shard's own row
                shard = PerfectHash.of(part["hash"][0].as_py(), part["keys"][0].as_py(), part["n"][0].as_py())
                continue
            buf, offsets = text_buffer(part["term"])
            slot = shard.find(unsigned(part["h"]), buf, offsets[:-1], offsets[1:])
            on = slot >= 0
            held.add(lang, number, np.full(on.sum(), held.number(source)), slot[on], np.asarray(part["n"])[on])
        if held.size > HELD_ROWS:
            yield from held.rows()
    yield from held.rows()


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of dense slots per source and shard; the rows of a (lang, shard) follow each other."""
    key, dense = None, {}

    def out():
        slots = [np.flatnonzero(x) for x in dense.values()]
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]] * len(dense), pa.string()), pa.array([key[1]] * len(dense), pa.int64()), pa.array(list(dense), pa.string()),
             pa.array([x.astype(np.int32) for x in slots], pa.list_(pa.int32())), pa.array([x[at] for x, at in zip(dense.values(), slots, strict=True)], pa.list_(pa.int64()))],
            ["lang", "shard", "source", "slots", "counts"])

    for batch in batches:
        for i, at in enumerate(zip(batch["lang"].to_pylist(), batch["shard"].to_pylist(), strict=True)):
            if at != key:
                if dense:
                    yield out()
                key, dense = at, {}
            sources, slots, counts = (batch[c][i].values for c in ("sources", "slots", "counts"))
            for source, slot, n in zip(sources.to_pylist(), slots, counts, strict=True):
                slot = np.asarray(slot.values)
                row = dense.setdefault(source, np.zeros(0, np.int64))
                if slot[-1] >= len(row):  # slots come in order
                    row = dense[source] = np.concatenate([row, np.zeros(slot[-1] + 1 - len(row), np.int64)])
                row[slot] += np.asarray(n.values)
    if dense:
        yield out()


def probabilities(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * (counts + 1) / total), exactly: long division by steps of a thousand."""
    whole, left = np.divmod(counts + 1, total)
    for _ in range(UNIT_STEPS):
        digit, left = np.divmod(left * 1000, total)
        whole = whole * 1000 + digit
    return whole + 1


def _dense(table: pa.Table, sources: int, n: int) -> np.ndarray:
    counts = np.zeros((sources, n), np.int64)
    for i, (slots, values) in enumerate(zip(table["slots"], table["counts"], strict=True)):
        if slots.is_valid:
            counts[i, np.asarray(slots.values)] = np.asarray(values.values)
    return counts


def _compare(best: int):
    """Sums of all pairs of sources and the best terms of each source, over the slots of one shard."""
    def run(table: pa.Table) -> pa.Table:
        lang, n = table["lang"][0].as_py(), table["n"][0].as_py()
        sources = table["source"].to_pylist()
        counts = _dense(table, len(sources), n)
        smooth = np.asarray(table["smooth"])
        p = probabilities(counts, smooth[:, None])
        names, items, parts, values = [], [], [], []
        for i, source in enumerate(sources):
            f = ((p[i] - p) ** 2 // p).sum(1)
            others = [j for j in range(len(sources)) if j != i]
            names += [source] * len(others)
            items += [sources[j] for j in others]
            parts += ["pair"] * len(others)
            values += f[others].tolist()
        if n:
            q = probabilities(counts.sum(0), np.asarray(table["lang_smooth"])[:1])
            lead = int(np.flatnonzero(np.asarray(table["hash"].is_valid()))[0])
            terms = PerfectHash.of(table["hash"][lead].as_py(), table["keys"][lead].as_py(), n).terms()
            rank = np.empty(n, np.int64)
            rank[sorted(range(n), key=terms.__getitem__)] = np.arange(n)
            for i, source in enumerate(sources):
                on = np.flatnonzero((counts[i] > 0) & (p[i] > q))
                f = (p[i, on] - q[on]) ** 2 // q[on]
                first = np.lexsort((rank[on], -f))[:best]
                names += [source] * len(first)
                items += [terms[k].decode() for k in on[first]]
                parts += ["term"] * len(first)
                values += f[first].tolist()
        return pa.table({"lang": pa.array([lang] * len(names), pa.string()), "source": pa.array(names, pa.string()), "part": pa.array(parts, pa.string()),
                         "item": pa.array(items, pa.string()), "value": pa.array(values, pa.int64())})
    return run


def vocabulary(rows: DataFrame, groups: DataFrame, least_docs: int) -> DataFrame:
    """The shards of all languages: lang, shard, n, hash, keys; a language without kept terms has one empty shard."""
    counted = rows.select("lang", "text").mapInArrow(_document_counts, "lang string, term string, h long, n long")
    kept = stored(counted.groupBy("lang", "term").agg(F.first("h").alias("h"), F.sum("n").alias("n"))
                  .where(F.col("n") >= least_docs).select("lang", "term", "h"), "kept-terms")
    sources = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    width = F.greatest(F.lit(FEWEST), F.least(F.lit(MOST), (F.lit(CELLS) / F.col("sources")).cast("int")))
    langs = stored(sources.join(terms, "lang", "left").select("lang", F.greatest(F.lit(1), F.ceil(F.coalesce("terms", F.lit(0)) * 1.1 / width)).alias("shards")), "languages")
    size = langs.agg(F.coalesce(F.sum(F.octet_length("lang") + 16), F.lit(0)).alias("b")).first().b
    dealt = kept.join(small(langs, 1, size), "lang").select("lang", F.pmod("h", "shards").alias("shard"), "term", "h")
    every = langs.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"),
                         F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("h"))
    return stored(dealt.unionByName(every).groupBy("lang", "shard").applyInArrow(_shard, _SHARD), "term-shards")


def recount(rows: DataFrame, shards: DataFrame, limit: int) -> DataFrame:
    """lang, shard, source, slots, counts: how often each kept term occurs in each group (slots that were met)."""
    spark, width = rows.sparkSession, shuffle_width(rows.sparkSession)
    size = shards.agg(F.coalesce(F.sum(F.octet_length("hash") + F.octet_length("keys") + F.octet_length("lang") + 64), F.lit(0)).alias("b")).first().b
    if size <= limit:
        sent: dict[str, list] = {}
        for batch in shards.orderBy("lang", "shard").toArrow().to_batches():
            for r in batch.to_pylist():
                sent.setdefault(r["lang"], []).append((r["hash"], r["keys"], r["n"]))
        met = rows.mapInArrow(_recount(spark.sparkContext.broadcast(sent)), _MET)
    else:
        many = shards.groupBy("lang").agg(F.count("*").alias("shards"))
        asked = rows.mapInArrow(_asked, "lang string, source string, h long, term string, n long").join(many, "lang") \
            .select("lang", F.pmod("h", "shards").alias("shard"), "source", "h", "term", "n", F.lit(None).cast("binary").alias("hash"), F.lit(None).cast("binary").alias("keys"))
        none = {c: F.lit(None).cast(t) for c, t in (("source", "string"), ("h", "long"), ("term", "string"))}
        own = shards.select("lang", "shard", *[c.alias(k) for k, c in none.items()], F.col("n").cast("long").alias("n"), "hash", "keys")
        met = own.unionByName(asked).repartition(width, "lang", "shard").sortWithinPartitions("lang", "shard", F.asc_nulls_first("source")) \
            .mapInArrow(_answered, _MET)
    return met.repartition(width, "lang", "shard").sortWithinPartitions("lang", "shard").mapInArrow(_summed, _COUNTS)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, best: int = BEST, limit: int = BROADCAST_BYTES) -> DataFrame:
    """lang, source, part, item, value, rank: how far each (lang, source) group parts from the others of its language.

    Part ``pair``: item is every other source of the language, value the sum of f over its kept terms; part ``term``: the ``best``
    terms that the group uses more than its language, value f = floor((p - q)**2 / q), p the group's and q the other's share of the
    kept terms' occurrences, smoothed by one, in billionths.  Kept are the terms of at least ``least_docs`` rows of the language.
    Ranks go by value, then by the item's bytes.  Null lang, source and text count as empty; repeated rows count each; a group
    without terms has zero counts; a language without kept terms has pairs of value 0; a source that is alone in its language has none;
    an empty table gives no rows; other columns are not read.  Words are grouped by 64-bit hashes inside a block and compared
    with the kept terms by their bytes.
    """
    rows = text_batches(docs).select(*[F.coalesce(docs[c], F.lit("")).alias(c) for c in ("lang", "source", "text")])
    groups = stored(rows.groupBy("lang", "source").agg(F.count("*").alias("rows")).select("lang", "source"), "groups")
    shards = vocabulary(rows, groups, least_docs)
    counts = stored(recount(rows, shards, limit), "slot-counts")
    total = counts.groupBy("lang", "source").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)).alias("total"))
    kinds = shards.groupBy("lang").agg(F.sum("n").cast("long").alias("kept"))
    by_lang = total.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    smooth = stored(groups.join(total, ["lang", "source"], "left").join(kinds, "lang").join(by_lang, "lang", "left")
                    .select("lang", "source", (F.coalesce("total", F.lit(0)) + F.col("kept")).alias("smooth"),
                            (F.coalesce("lang_total", F.lit(0)) + F.col("kept")).alias("lang_smooth")), "group-totals")
    wide = smooth.join(shards.select("lang", "shard"), "lang").join(counts, ["lang", "shard", "source"], "left") \
        .join(shards.select("lang", "shard", "n"), ["lang", "shard"])
    # a shard's hash and terms ride on its first source only
    first = smooth.groupBy("lang").agg(F.min("source").alias("source"))
    keyed = shards.join(first, "lang").select("lang", "shard", "source", "hash", "keys")
    full = wide.join(keyed, ["lang", "shard", "source"], "left")
    blocks_ = full.select("lang", "shard", "source", "n", "smooth", "lang_smooth", "slots", "counts", "hash", "keys")
    found = stored(blocks_.groupBy("lang", "shard").applyInArrow(_compare(best), "lang string, source string, part string, item string, value long"), "divergences")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)
