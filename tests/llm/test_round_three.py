"""Periodic runs, source divergence and the n-gram Jaccard join against plain Python."""

import random
from collections import Counter

import brute
import numpy as np
import pytest
from conftest import words

from tillbook.llm import divergence, queries, runs, set_join
from tillbook.llm.common import U, mix


def bag(items):
    return Counter(map(repr, items))


def test_extensions_match_plain_comparison():
    rng = np.random.default_rng(4)
    for kinds, n in ((1, 700), (2, 900), (3, 400), (50, 300), (2, 5)):
        seq = rng.integers(0, kinds, n)
        if n > 500:
            seq[n // 2:] = seq[:n - n // 2]
        ids = np.append(seq, kinds)
        extend = runs.Extensions(ids)
        x = rng.integers(0, n, 300)
        y = rng.integers(0, n + 1, 300)
        x, y = np.minimum(x, y)[x != y], np.maximum(x, y)[x != y]
        want = [next(k for k in range(n + 2) if b + k > n or ids[a + k] != ids[b + k]) for a, b in zip(x, y)]
        assert extend(x, y).tolist() == want


def test_difference_cover_reaches_every_pair():
    i, j = np.meshgrid(np.arange(runs.MODULUS), np.arange(runs.MODULUS))
    for k in (i, j):
        assert np.isin((k + runs.SHIFT[i, j]) % runs.MODULUS, runs.COVER).all()


def test_runs_of_random_texts():
    rng = random.Random(8)
    for _ in range(150):
        texts = []
        for _ in range(rng.randrange(1, 5)):
            n, kinds = rng.choice([0, 1, 5, 6, 7, 8, 40, 250]), rng.choice([1, 2, 3, 9])
            w = [rng.randrange(kinds) for _ in range(n)]
            if n and rng.random() < 0.6:
                a, p = rng.randrange(n), rng.randrange(1, max(2, n // 3))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        counts = np.array([len(w) for w in texts])
        hashes = mix(np.array([x for w in texts for x in w], U) + U(9))
        least, times = rng.choice([(6, 4), (6, 4), (2, 2), (10, 3)])
        text, start, end, period = runs.periodic_runs(hashes, np.cumsum(counts) - counts, counts, least, times)
        want = [(i, s, s + n, p) for i, w in enumerate(texts) for s, n, p in brute.periodic_runs(w, least, times)[0]]
        got = list(zip(text.tolist(), start.tolist(), end.tolist(), period.tolist()))
        assert got == sorted(want, key=lambda r: (r[0], r[1], r[3]))


@pytest.mark.parametrize("pairs", [None, 50])
def test_periodic_runs(spark, docs, rows, none, pairs):
    more = [(1000 + i, ("x y " * 7 + "x ") * (i % 3) + " ".join(f"w{k % (i + 1)}" for k in range(90))) for i in range(60)]
    more += [(2000, "na " * 30000), (2001, "a b c " * 20 + "d " + "a b c " * 20), (2002, "z z z z z"), (2003, "z z z z z z")]
    table = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    got = queries.run_digests(queries.echoed(table)).collect()
    assert bag(tuple(r) for r in got) == bag(brute.run_digest(*r) for r in rows + more)
    assert sum(r.n_runs > 0 for r in got) > 50
    assert queries.run_digests(queries.echoed(none)).collect() == []
    if pairs:
        counts = np.array([400, 0, 90])
        seq = mix(np.arange(490, dtype=U) % U(3))
        whole = runs.periodic_runs(seq, np.cumsum(counts) - counts, counts)
        keep, runs.PAIRS = runs.PAIRS, pairs
        parts = runs.periodic_runs(seq, np.cumsum(counts) - counts, counts)
        runs.PAIRS = keep
        assert [x.tolist() for x in whole] == [x.tolist() for x in parts]


def test_runs_keep_the_columns_of_a_row(docs):
    found = runs.find_runs(docs)
    assert found.columns == ["row", "n_words", "runs", "collapsed"]
    assert found.select("row.*").columns == [c for c in docs.columns if c != "text"]
    row = found.where("row.n_words = 'n_words' AND size(runs) > 0").orderBy("row.doc_id").first()
    assert row.runs[0].length >= 6 and row.n_words > len(row.collapsed.split(" "))


def test_perfect_hash_is_minimal_and_checks_its_keys():
    terms = [f"term{i}".encode() for i in range(3000)] + [b"", "\u00e9t\u00e9".encode()]
    keys = mix(np.arange(1, len(terms) + 1, dtype=U))
    keys[7] = keys[1234] = keys[99]  # three terms with the same 64 bits
    table = divergence.PerfectHash.of(*divergence.PerfectHash.build(keys, terms).row(), len(terms))
    raw = np.frombuffer(b"".join(terms), np.uint8)
    ends = np.cumsum([len(t) for t in terms])
    starts = ends - [len(t) for t in terms]
    slot = table.find(keys, raw, starts, ends)
    assert sorted(slot.tolist()) == list(range(len(terms)))
    assert [table.terms()[k] for k in slot] == terms
    foreign = np.frombuffer(b"other", np.uint8)
    assert (table.find(keys, foreign, np.zeros(len(keys), int), np.full(len(keys), 5)) == -1).all()
    empty = divergence.PerfectHash.of(*divergence.PerfectHash.build(keys[:0], []).row(), 0)
    assert empty.find(keys[:5], raw, starts[:5], ends[:5]).tolist() == [-1] * 5


def test_probabilities_are_exact():
    counts = np.array([0, 1, 7, 10**12, 3 * 10**14])
    total = 3 * 10**14 + 11
    assert divergence.probabilities(counts, np.array(total)).tolist() == [1 + 10**9 * (c + 1) // total for c in counts.tolist()]


@pytest.mark.parametrize("limit", [divergence.BROADCAST_BYTES, 0])
def test_source_divergence(spark, docs, none, rows, limit, monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in ("wa", "\u00e9t\u00e9", "Zo") for b in "abcdefghijklmnopqrstuvw"]
    table = [(rng.choice(["en", "fr", None, "", "xx"]), rng.choice(["s0", "s1", "s1", "s1", None]),
              " ".join(rng.choices(vocabulary, range(1, len(vocabulary) + 1), k=rng.randrange(30)))) for _ in range(300)]
    table += [("one", "alone", "a b c"), ("none", "p", "x"), ("none", "q", None), ("none", "r", "1 2"), ("en", "silent", ""), *table[:4]]
    if limit:
        monkeypatch.setattr(divergence, "CELLS", 300)  # many shards
    frame = spark.createDataFrame(table, "lang string, source string, text string").repartition(4)
    got = [tuple(r) for r in divergence.audit(frame, best=9, limit=limit).collect()]
    assert bag(got) == bag(brute.divergences(table, best=9))
    clash = divergence.audit(docs, limit=limit).collect()
    assert bag(tuple(r) for r in clash) == bag(brute.divergences([(None, "s", t) for _, t in rows]))
    assert divergence.audit(none, limit=limit).collect() == []


def make_sets():
    """Chains of near copies, light sets that differ in one word, passages that unlike rows share, and copies."""
    rng = random.Random(2)
    out, passage = [], words(rng, 40)
    for _ in range(12):
        base = words(rng, rng.randrange(20, 90)).split(" ")
        for _ in range(rng.randrange(1, 12)):
            base = list(base)
            base[rng.randrange(len(base))] = f"new{rng.randrange(999)}"
            out.append(" ".join(base))
            if rng.random() < 0.4:
                out.append(" ".join(base[rng.randrange(3):]))
    for n in range(1, 21):
        line = [f"{n}w{k}" for k in range(n)]
        out += [" ".join(line), " ".join([*line, "end"]), " ".join(["start", *line]), " ".join(line[1:]), " ".join(line).upper()]
    out += [words(rng, rng.randrange(3, 30)) + " " + passage + " " + words(rng, rng.randrange(3, 30)) for _ in range(25)]
    return [(7 * i + 3, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("light, part", [(None, None), (0, 8), (16, 8), (9, None)])
def test_ngram_jaccard_join(spark, docs, none, rows, light, part, monkeypatch):
    more = make_sets()
    table = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True).repartition(6)
    if light is not None:
        monkeypatch.setattr(set_join, "boundary", lambda *_: light)
    if part:
        monkeypatch.setattr(set_join, "LIST_ROWS", part)
    got = [tuple(r) for r in set_join.join_alike(table).collect()]
    assert bag(got) == bag(brute.alike_sets(rows + more))
    if light is None:
        assert set_join.join_alike(none).collect() == []


def test_boundary_follows_cost():
    assert set_join.boundary({8: 1000}, {8: 10}, 80) < 8
    assert set_join.boundary({8: 1000}, {8: 10**9}, 80) >= 10
    assert set_join.subset_cost(5, 5, 80) == 1 + 0 + 5


def test_filter_cuts_keep_a_link_across_tasks(spark):
    """Sets of one shingle list in many tasks: each task sends two of them and counts the others itself."""
    base = [f"b{k}" for k in range(30)]
    table = [(i, " ".join(base[:k] + [f"e{i}"] + base[k + 1:])) for i, k in enumerate([0, 29] * 40)]
    frame = spark.createDataFrame(table, "doc_id long, text string").repartition(16)
    assert bag(tuple(r) for r in set_join.join_alike(frame).collect()) == bag(brute.alike_sets(table))


def test_contract_columns(spark):
    sf = "/root/testdata/sf0.001"
    want = {"op11_periodic_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
            "op12_source_divergence": "lang string, source string, part string, item string, value bigint, rank int",
            "op13_ngram_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint"}
    for name, columns in want.items():
        assert ", ".join(f"{c} {t}" for c, t in queries.QUERIES[name](spark, sf).dtypes) == columns


def test_whole_small_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    table = [(r.doc_id, r.text) for r in docs.collect()]
    got = {name: bag(tuple(r) for r in queries.QUERIES[name](spark, sf).collect()) for name in ("op11_periodic_runs", "op13_ngram_jaccard_join")}
    assert got["op11_periodic_runs"] == bag(brute.run_digest(*r) for r in table)
    assert got["op13_ngram_jaccard_join"] == bag(brute.alike_sets(table))
