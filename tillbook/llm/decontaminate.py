"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of postings (term, text key, positions).  Every window of
a test item names its rarest terms; their posting lists, shifted by the
terms' offsets in the item, are intersected from the rarest on, and only texts
where they meet (on one diagonal, or within the slop of a proximity match) are
compared with the item word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NON_ALNUM, U, blocks, mix, scan_words, signed, small, stored, text_batches, text_key

WINDOW = 10
LISTS = 2  # rarest terms of a window whose lists are intersected
#: Most distinct test terms (8 bytes each) sent to the tasks; beyond it the index holds every term.
MAX_TERMS = 4_000_000
#: Words of the items that a text is compared with in one row.
PART_WORDS = 10_000


def term_hashes(text: str | None) -> np.ndarray:
    return scan_words(pa.array([text or ""]), True, NON_ALNUM).hashes()


def _member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x


def item_table(items: DataFrame) -> DataFrame:
    """(item, item_id, terms): one row per test item with words; item is its row's own key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                w = scan_words(part.column("text"), True, NON_ALNUM)
                terms = pa.ListArray.from_arrays(pa.array(w.first, pa.int32()), signed(w.hashes()))
                yield pa.RecordBatch.from_arrays([part.column("item_id"), terms], ["item_id", "terms"])
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").distinct()
    out = rows.mapInArrow(run, "item_id string, terms array<long>").where(F.size("terms") > 0)
    return out.select(F.xxhash64("item_id", "terms").alias("item"), "item_id", "terms").distinct()


def count_terms(docs: DataFrame, terms: np.ndarray | None) -> DataFrame:
    """(term, n) over all texts, for the given sorted terms (all when None)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                h = scan_words(part.column("text"), True, NON_ALNUM).hashes()
                if terms is not None:
                    h = h[_member(terms, h)]
                if len(h):
                    value, n = np.unique(h, return_counts=True)
                    yield pa.RecordBatch.from_arrays([signed(value), pa.array(n, pa.int64())], ["term", "n"])
    return text_batches(docs).select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def positional_index(docs: DataFrame, terms: np.ndarray | None) -> DataFrame:
    """Postings (term, text_key, positions) of the given sorted terms (all when None), once per distinct text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                w = scan_words(part.column("text"), True, NON_ALNUM)
                h = w.hashes()
                on = np.flatnonzero(_member(terms, h)) if terms is not None else np.arange(len(h))
                if not len(on):
                    continue
                on = on[np.lexsort((on, h[on], w.row[on]))]
                row, value = w.row[on], h[on]
                new = np.concatenate([[0], np.flatnonzero((row[1:] != row[:-1]) | (value[1:] != value[:-1])) + 1])
                position = pa.array((on - w.first[row]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [signed(value[new]), part.column("text_key").take(pa.array(row[new])),
                     pa.ListArray.from_arrays(pa.array(np.append(new, len(on)), pa.int32()), position)],
                    ["term", "text_key", "positions"])
    rows = docs.select(text_key().alias("text_key"), "text")
    return rows.mapInArrow(run, "term long, text_key binary, positions array<int>") \
        .groupBy("term", "text_key").agg(F.first("positions").alias("positions"))


def _patterns(terms: list[int], counts: dict[int, int], window: int, lists: int) -> list[list[dict]]:
    """The distinct patterns of an item's windows: the rarest terms, rarest first, and their places beside each other."""
    width = min(window, len(terms))
    out = set()
    for s in range(len(terms) - width + 1):
        picked = sorted(range(s, s + width), key=lambda i: (counts.get(terms[i], 0), terms[i], i))[:lists]
        out.add(tuple((terms[i], i - min(picked)) for i in picked))
    return [[{"term": t, "place": p} for t, p in pattern] for pattern in sorted(out)]


def plan_windows(items: DataFrame, counts: DataFrame, window: int, lists: int) -> DataFrame:
    """(item, patterns): for the windows of an item their rarest terms and the places of those beside each other."""
    seen = items.select("item", F.posexplode("terms").alias("at", "term")).join(counts, "term", "left") \
        .groupBy("item").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n")))).alias("ns"))
    pattern = pa.list_(pa.struct([("term", pa.int64()), ("place", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            plans = [_patterns(r["terms"], {t: x["n"] for t, x in zip(r["terms"], r["ns"], strict=True)}, window, lists) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(plans, pa.list_(pattern))], ["item", "patterns"])
    return items.select("item", "terms").distinct().join(seen, "item") \
        .mapInArrow(run, "item long, patterns array<array<struct<term:long,place:int>>>")


def _meet(lists: dict[int, np.ndarray], pattern: list[dict], slop: int) -> bool:
    """Whether the lists of a pattern, shifted by their places, hold numbers at most ``slop`` apart."""
    if any(x["term"] not in lists for x in pattern):
        return False
    near = lists[pattern[0]["term"]] - pattern[0]["place"]
    for x in pattern[1:]:
        other = lists[x["term"]] - x["place"]
        near = near[np.searchsorted(other, near + slop, "right") > np.searchsorted(other, near - slop)]
    return len(near) > 0


def proximity_matches(index: DataFrame, planned: DataFrame, slop: int) -> DataFrame:
    """(text_key, item): texts in which the offset-adjusted lists of some window's rarest terms meet, from the rarest
    on, with at most ``slop`` words between them (slop 0: on one diagonal).

    A text's lists for an item come together as they are stored, so the work follows the text's length, however
    often a term is repeated in the text and in the item.
    """
    terms_of = F.transform("patterns", lambda p: F.array_distinct(p["term"]))
    wanted = planned.select("item", F.array_min(F.transform(terms_of, F.size)).alias("least"), F.explode(F.array_distinct(F.flatten(terms_of))).alias("term"))
    lists = index.join(wanted, "term").groupBy("text_key", "item").agg(
        F.collect_list(F.struct("term", "positions")).alias("lists"), F.first("least").alias("least"))
    # patterns with a term that the text lacks leave before positions are looked at
    whole = F.filter("patterns", lambda p: F.forall(p, lambda x: F.array_contains(F.col("lists.term"), x["term"])))
    met = lists.where(F.size("lists") >= F.col("least")).join(planned, "item").select("text_key", "item", "lists", whole.alias("patterns")).where("size(patterns) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, first, values = _parts(batch.column("lists"), "term", "positions")
            keep = []
            for i, patterns in enumerate(batch.column("patterns").to_pylist()):
                places = {int(names[k]): values[k] for k in range(first[i], first[i + 1])}
                keep.append(any(_meet(places, p, slop) for p in patterns))
            yield batch.select(["text_key", "item"]).filter(pa.array(keep, pa.bool_()))
    return text_batches(met).mapInArrow(run, "text_key binary, item long")


def _parts(column: pa.ListArray, name: str, values: str) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """A column of lists of (number, numbers): the numbers, where each row's begin, and the lists behind them."""
    offsets = np.asarray(column.offsets).astype(np.int64)
    inside = column.values
    lists = inside.field(name), inside.field(values)
    at, flat = np.asarray(lists[1].offsets).astype(np.int64), np.asarray(lists[1].values).astype(np.int64)
    return np.asarray(lists[0]), offsets, [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _names(words: np.ndarray, width: int) -> np.ndarray:
    """One number for each ``width`` consecutive words."""
    out = np.zeros(max(0, len(words) - width + 1), U)
    for k in range(width):
        out = mix(out + words[k:k + len(out)])
    return out


def _occurrences(own: np.ndarray, names: np.ndarray, terms: np.ndarray, width: int) -> np.ndarray:
    """Places of a text at which some window of the item occurs: windows of one name are compared word by word."""
    name, at = np.unique(_names(terms, width), return_index=True)
    slot = np.minimum(np.searchsorted(name, names), len(name) - 1)
    place = np.flatnonzero(name[slot] == names)
    same = np.ones(len(place), bool)
    for k in range(width):
        same &= own[place + k] == terms[at[slot[place]] + k]
    return place[same]


def _near(own: np.ndarray, terms: np.ndarray, width: int, slop: int) -> bool:
    """Whether all words of some window of the item stand in its order within ``width + slop`` words of the text."""
    order = np.argsort(own, kind="stable")
    value = own[order]
    lists = {t: order[np.searchsorted(value, t):np.searchsorted(value, t, "right")] for t in np.unique(terms)}
    for s in range(len(terms) - width + 1):
        first = last = lists[terms[s]]
        for t in terms[s + 1:s + width]:
            k = np.searchsorted(lists[t], last, "right")  # the next place of the word leaves most room for the rest
            on = k < len(lists[t])
            first, last = first[on], lists[t][k[on]]
            first, last = first[last - first < width + slop], last[last - first < width + slop]
        if len(first):
            return True
    return False


def _verify(window: int, slop: int):
    """Compares each candidate text with its items word by word: the spans that windows cover, and the items met."""
    schema = pa.schema([("text_key", pa.binary()), ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
                        ("items", pa.list_(pa.string())), ("near_items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                w = scan_words(part.column("text"), True, NON_ALNUM)
                words = w.hashes()
                out = []
                for i, key in enumerate(part.column("text_key").to_pylist()):
                    own = words[w.first[i]:w.first[i + 1]]
                    hit, ids, near, names = np.zeros(len(own) + 1, np.int64), set(), set(), {}
                    for x in part.column("found")[i]:
                        terms = np.asarray(x["terms"].values).astype(np.int64).view(U)
                        width = min(window, len(terms))
                        if width not in names:
                            names[width] = _names(own, width)
                        place = _occurrences(own, names[width], terms, width)
                        if len(place):
                            np.add.at(hit, place, 1)
                            np.add.at(hit, place + width, -1)
                            ids.update(x["ids"].as_py())
                        if slop and (len(place) or _near(own, terms, width, slop)):
                            near.update(x["ids"].as_py())
                    inside = np.concatenate([[False], np.cumsum(hit) > 0])
                    spans = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)
                    out.append({"text_key": key, "spans": [{"a": a, "b": b} for a, b in spans.tolist()], "items": sorted(ids), "near_items": sorted(near)})
                yield pa.RecordBatch.from_pylist(out, schema)
    return run


def candidates(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, lists: int = LISTS, slop: int = 0) -> tuple[DataFrame, int]:
    """((text_key, part, found), number of rows): for each text with a meeting its items and their words, in parts of bounded size."""
    items = stored(item_table(benchmark), "bench-items")
    every = items.select(F.explode("terms").alias("term")).distinct()
    n_terms = every.count()
    terms = np.sort(np.array([r.term for r in every.toLocalIterator()], np.int64).view(U)) if n_terms <= MAX_TERMS else None
    counts = stored(count_terms(docs, terms), "bench-term-counts")
    planned = stored(plan_windows(items, counts, window, lists), "bench-windows")
    rare = planned.select(F.explode(F.flatten("patterns")["term"]).alias("term")).distinct()
    picked = np.sort(np.array([r.term for r in rare.toLocalIterator()], np.int64).view(U)) if terms is not None else None
    index = positional_index(docs, picked)
    named = items.groupBy("item").agg(F.first("terms").alias("terms"), F.collect_set("item_id").alias("ids"))
    # the items are dealt to parts of about PART_WORDS words, so a text that meets many items is compared in several rows
    words = items.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("n")).first().n
    part = F.pmod("item", F.lit(1 + words // PART_WORDS)).alias("part")
    found = proximity_matches(index, planned, slop).join(named, "item").groupBy("text_key", part).agg(F.collect_list(F.struct("terms", "ids")).alias("found"))
    found = stored(found, "bench-candidates")
    return found, found.count()


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0) -> tuple[DataFrame, int]:
    """((text_key, n_hit, items, near_items), number of rows): the distinct texts with a hit word or, if ``slop`` > 0, a near item."""
    found, n = candidates(docs, benchmark, window, slop=slop)
    rows = docs.select(text_key().alias("text_key"), "text")
    # the candidate texts alone travel: keys are broadcast while they fit, and texts are then compared once with each part of their items
    texts = rows.join(small(found.select("text_key").distinct(), n, 64), "text_key", "left_semi").groupBy("text_key").agg(F.first("text").alias("text"))
    met = texts.join(found.drop("part"), "text_key").mapInArrow(
        _verify(window, slop), "text_key binary, spans array<struct<a:int,b:int>>, items array<string>, near_items array<string>") \
        .where("size(spans) > 0 or size(near_items) > 0").groupBy("text_key").agg(
            F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
            F.array_distinct(F.flatten(F.collect_list("near_items"))).alias("near_items"))
    # words under sorted spans: each span adds what lies beyond the furthest end so far
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), lambda x, s: F.struct(
        F.greatest(x["end"], s["b"]).alias("end"), (x["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(x["end"], s["a"]))).alias("n")))
    hit = stored(met.select("text_key", covered["n"].alias("n_hit"), F.array_sort("items").alias("items"), F.array_sort("near_items").alias("near_items")), "bench-hits")
    return hit, hit.count()


def clean_rows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` whose text has no hit word, with all their columns."""
    hit, n = contaminated_texts(docs, benchmark, window)
    key = "text_key_" + "_".join(docs.columns)  # a name that no column has
    return docs.withColumn(key, text_key()).join(small(hit.select(F.col("text_key").alias(key)), n, 64), key, "left_anti").drop(key)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, items (sorted ids) for every row of ``docs``, and near_items if ``slop`` > 0.

    A word is hit when it lies in an occurrence of ``window`` consecutive words of an item (all words of an item that
    has fewer).  An item is near when all words of one of its windows stand in the item's order within ``window + slop``
    words of the text (all its words and ``slop`` more, if it has fewer); exact matches are near as well.  Null and empty texts have no words; items without words match nothing; a null item_id counts as the
    empty string; equal texts are judged once and repeated rows get equal results; an empty benchmark
    hits nothing; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_key().alias("text_key"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                w = scan_words(part.column("text"), True, NON_ALNUM)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(w.counts, pa.int64())],
                                                 ["doc_id", "text_key", "n_words"])
    every = rows.mapInArrow(count, f"doc_id {kind}, text_key binary, n_words long")
    hit, n = contaminated_texts(docs, benchmark, window, slop)
    lists = ["items", "near_items"] if slop else ["items"]
    return every.join(small(hit, n, 128), "text_key", "left").select(
        "doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in lists])


def items_digest(items) -> object:
    return F.sha2(F.array_join(F.array_sort(items), ","), 256)
