import math
import random
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tillbook.llm import bpe, decontaminate, lm_score, quality, simhash, substring, token_count
from tillbook.llm.common import NON_ALNUM, crc_fold, scan_words
from tillbook.llm.hashing import spark_xxhash64_pair
from tillbook.llm.xxh import xxh64

MODEL = public_tokenizers.path("piece_bpe_32k.model")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def bag(items):
    return Counter(map(repr, items))


def test_scan_words_matches_patterns(rows):
    texts = [t for _, t in rows] + ["A-b9\x7fZ é\x0bq"]
    for lower, table, pattern in ((False, None, brute.WORD), (True, NON_ALNUM, brute.ALNUM)):
        w = scan_words(pa.array(texts), lower, *([table] if table is not None else []))
        got = [bytes(w.buf[a:b]).decode() for a, b in zip(w.starts, w.ends)]
        want = [pattern.findall((t or "").translate(brute.LOWER) if lower else t or "") for t in texts]
        assert got == [x for ws in want for x in ws]
        assert w.counts.tolist() == [len(ws) for ws in want]
        same = {}
        for word, h in zip(got, w.hashes().tolist()):
            assert same.setdefault(word, h) == h
        assert len(set(same.values())) == len(same)


def test_xxh64_and_spark_hash_twins(spark):
    data = np.random.default_rng(1).integers(0, 256, 3000, dtype=np.uint8)
    starts = np.arange(0, 700)
    lengths = np.arange(0, 700)
    got = xxh64(data, starts, lengths)
    assert got.tolist() == [xxhash.xxh64_intdigest(data[s:s + n].tobytes(), 42) for s, n in zip(starts, lengths)]
    hashed = [r.h for r in spark.range(5).select(F.xxhash64(F.lit(2), F.col("id") * -77).alias("h")).collect()]
    assert hashed == spark_xxhash64_pair(2, (np.arange(5) * -77).view(np.uint64)).view(np.int64).tolist()


@pytest.mark.parametrize("limits", [{}, {"filter_limit": 0, "count_limit": 0}])
def test_lm_scores(docs, rows, limits):
    got = lm_score.score_held_out(docs, **limits).collect()
    want = brute.lm_base(rows)
    assert bag((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == \
        bag((i, a, b, c, round(d, 6)) for (i, _), (a, b, c, d) in zip(rows, want))
    assert all(r.score < 0 and r.held_out == (brute.fold(r.doc_id, 7) == 2) for r in got)
    if limits:
        plain = lm_score.score_held_out(docs).collect()
        assert bag((r.doc_id, round(r.score, 6)) for r in got) == bag((r.doc_id, round(r.score, 6)) for r in plain)


def test_lm_filter_reads_counts_back():
    grams = np.arange(1, 2001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.arange(1, 2001)
    seg = lm_score.build_segment(grams, counts)
    level = lm_score.probe_segment(seg, np.zeros(2000, np.int64), np.full(2000, len(seg)), grams)
    assert (level >= lm_score.level_of(counts)).all() and (level > lm_score.level_of(counts)).mean() < 0.02
    ratio = lm_score.count_of(lm_score.level_of(counts)) / counts
    assert ratio.min() > 1 / lm_score.BASE and ratio.max() < lm_score.BASE
    other = np.arange(1, 20001, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    false = lm_score.probe_segment(seg, np.zeros(20000, np.int64), np.full(20000, len(seg)), other)
    assert (false > 0).mean() < 0.02


def test_lm_segments_follow_the_corpus_and_are_sent_once(docs, monkeypatch):
    plain = {r.doc_id: r.score for r in lm_score.score(docs, lm_score.train(docs)).collect()}
    monkeypatch.setattr(lm_score, "SEGMENT_BYTES", 1 << 10)
    model = lm_score.train(docs)
    sizes = [len(r.bits) for r in model.bits.collect()]
    assert model.segments == -(-3 * model.n * lm_score.BITS // 8 // 1024) > 32 and max(sizes) <= 1.5 * 1024
    routed = lm_score.score(docs, model, filter_limit=0)
    whole = lm_score.score(docs, model)
    assert bag((r.doc_id, round(r.score, 6)) for r in routed.collect()) == bag((r.doc_id, round(r.score, 6)) for r in whole.collect())
    assert len(plain) == len({r.doc_id for r in whole.collect()})
    # no join carries bits: each segment's array is one row beside its requests
    plan = routed._jdf.queryExecution().optimizedPlan().toString()
    assert "bits" in plan and "= seg#" not in plan


def test_lm_answers_hold_a_segment_over_batches():
    grams = lm_score.mix(np.arange(1, 400, dtype=np.uint64))
    seg = lm_score.build_segment(grams[:200], np.arange(1, 201))
    schema = pa.schema([("seg", pa.int32()), ("chunk", pa.int64()), ("grams", pa.binary()), ("bits", pa.binary())])
    batches = [[(3, None, None, seg.tobytes()), (3, 1, grams[:50].tobytes(), None)], [(3, 2, grams[50:399].tobytes(), None), (4, 1, grams[:5].tobytes(), None)]]
    out = [x for b in lm_score._answer_batches(pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema) for rows in batches) for x in b.to_pylist()]
    assert [(x["chunk"], x["seg"]) for x in out] == [(1, 3), (2, 3), (1, 4)]
    want = lm_score.probe_segment(seg, np.zeros(399, np.int64), np.full(399, len(seg)), grams)
    assert out[0]["levels"] + out[1]["levels"] == want.astype(np.uint8).tobytes() and out[2]["levels"] == bytes(5)


def test_lm_score_is_a_distribution_over_known_words(spark):
    model = lm_score.train(spark.createDataFrame([(1, "a b a b a c"), (2, "b a")], "doc_id long, text string"))
    texts = spark.createDataFrame([(i, w) for i, w in enumerate(["a c a", "a b a", "c a c"])], "doc_id long, text string")
    got = lm_score.score(texts, model).collect()
    assert sum(10 ** r.score for r in got) < 1
    assert max(got, key=lambda r: r.score).doc_id == 1


def test_token_counts(docs, rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = token_count.count_tokens(docs, MODEL, limit=100).collect()
    want = [(i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 100) for i, t in rows]
    assert bag((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == bag(want)


def test_token_counts_of_odd_texts():
    import random

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    proof = token_count.WholeTokens(MODEL)
    assert proof.splits and len(proof.alone) > 10000
    rng = random.Random(1)
    parts = ["a", "the", " ", "  ", "▁", "\n", "\t", "é", "<s>", "</s>", "<unk>", "<0x0A>", "　", "\u200b", "日本", "🙂", "x" * 30, ".", "'s", "\x00", "\r"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(2000)]
    got = [sum(len(sp.encode(w)) for w in token_count.pre_tokens(t)) for t in texts]
    assert got == [len(sp.encode(t)) for t in texts]


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_bpe_round_trip(spark, docs, rows, limit):
    import random

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(2)
    parts = ["a", "The", " ", "  ", "\n", "\t", "é", "<|endoftext|>", "'re", "'", "s", "ll", "　", "\u00a0", "日本", "🙂", "x" * 30, "!!", "123", " 9", "\u0301", "\x00"]
    odd = ["".join(rng.choices(parts, k=rng.randrange(900))) for _ in range(20)]
    odd += [a[5:] + b for a, b in zip(odd, odd[1:])]
    long = " ".join(rng.choices(["lorem", "ipsum,", "dolor", "sit.\n", "été"], k=3000))
    odd += [long + " x", "y" + long, long[100:] + "<|endoftext|>"]
    every = rows + [(1000 + i, t) for i, t in enumerate(odd)]
    got = bpe.encode(spark.createDataFrame(every, "doc_id long, text string").repartition(4), VOCABULARY, limit=limit).collect()
    want = [(i, tok.encode(t or "", add_special_tokens=False).ids) for i, t in every]
    assert bag((r.doc_id, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in got) == \
        bag((i, len(ids), ids, tok.decode(ids, skip_special_tokens=False)) for i, ids in want)


def test_bpe_chunks_are_content_defined():
    text = " ".join(f"word{i * 7919 % 1000}" for i in range(4000)).encode()
    def cuts(raw):
        ends = bpe.chunk_cuts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        return {len(raw) - e for e in ends.tolist()}
    a, b = cuts(text), cuts(b"some other beginning " + text)
    assert len(a) > 20 and len(a & b) >= len(a) - 1


def test_quality(spark, docs, none):
    import random

    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        junk = i % 4 == 0
        text = " ".join("".join(rng.choices("etaoin shrdlu", k=6)) for _ in range(60))
        rows.append((i, text.upper().replace(" ", " ### ") if junk else text + "."))
        labels.append((i, int(not junk), 0))
    labels += [(0, None, 0), (None, 1, 0), (1, 1, 0), (99999, 0, 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.classify(d, marks).select("row.doc_id", "score", (crc_fold("row.doc_id", 4) == 2).alias("held")).collect()
    held = [r for r in got if r.held]
    assert len(got) == 400 and held
    assert sum((r.score >= quality.THRESHOLD) == (r.doc_id % 4 != 0) for r in held) >= 0.95 * len(held)
    edge = quality.classify(docs, marks).collect()
    assert len(edge) == docs.count() and all(0 <= r.score <= 1 for r in edge)
    assert {*edge[0].row.asDict(), "text"} == set(docs.columns)
    assert quality.classify(none, marks).count() == 0
    assert {r.score for r in quality.classify(docs, marks.limit(0)).collect()} == {1.0}


def test_quality_isotonic():
    rates = quality.isotonic(np.array([1.0, 0, 3, 2, 4]), np.array([4.0, 4, 4, 4, 4]))
    assert rates.tolist() == [0.125, 0.125, 0.625, 0.625, 1.0]


def test_simhash(docs, rows):
    got = simhash.near_duplicates(docs).collect()
    fps = [brute.fingerprint(t) for _, t in rows]
    label = brute.near_components(fps)
    low = {}
    for (i, _), k in zip(rows, label):
        if i is not None:
            low[k] = min(low.get(k, i), i)
    assert bag((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == bag((i, f, low.get(k)) for (i, _), f, k in zip(rows, fps, label))


def test_simhash_links_planted_fingerprints(spark, monkeypatch):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 120, dtype=np.uint64)
    near = [base ^ (np.uint64(1) << rng.integers(0, 64, 120).astype(np.uint64)) for _ in range(4)]
    crowd = np.uint64(12345) ^ (rng.integers(0, 2**12, 300).astype(np.uint64) << np.uint64(30))  # shares two of the three blocks
    x = np.unique(np.concatenate([base, *near, crowd]))
    label = brute.near_components([int(v) for v in x])
    for size in (4096, 60):
        monkeypatch.setattr(simhash, "SHARD_ROWS", size)
        a, b = simhash.link_shards(x, np.zeros(len(x), np.uint64), 2)
        low = dict(zip(a.tolist(), b.tolist()))
        assert [low.get(int(v), int(v)) for v in x] == [int(x[k]) for k in label]
        fps = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
        roots = {r.node: r.root for r in simhash.components(simhash.link_fingerprints(fps)).collect()}
        groups = {}
        for v, k in zip(x.view(np.int64).tolist(), label):
            groups.setdefault(k, set()).add(roots.get(v, v))
        assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_one_of_each(docs, rows):
    kept = simhash.one_of_each(docs).select("doc_id", "text").collect()
    fps = [brute.fingerprint(t) for _, t in rows]
    assert len(kept) == len(set(brute.near_components(fps)))
    first = {}
    for (i, _), k in zip(rows, brute.near_components(fps)):
        if i is not None:
            first[k] = min(first.get(k, i), i)
    assert {r.doc_id for r in kept} - {None} == set(first.values())


@pytest.mark.parametrize("limit", [1 << 26, 4096])
def test_substring_dedup(docs, rows, limit):
    got = substring.dedup_substrings(docs, limit=limit).collect()
    want = brute.substrings(rows)
    assert bag((r.row.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == bag((i, *w) for (i, _), w in zip(rows, want))
    assert sum(w[1] for w in want) > 500 and {*got[0].row.asDict(), "text"} == set(docs.columns)


def test_recompression_names_equal_stretches_alike():
    rng = np.random.default_rng(4)
    body = rng.integers(1, 50, 40).astype(np.uint64)
    for _ in range(30):
        seq = [np.concatenate([rng.integers(1, 50, rng.integers(0, 9)).astype(np.uint64), body, rng.integers(1, 50, 5).astype(np.uint64)]) for _ in range(2)]
        spans = []
        for s in seq:
            at = next(i for i in range(len(s)) if (s[i:i + 40] == body).all())
            (sym, lo, hi), = substring.levels(s, np.zeros(len(s), int), np.array([0, len(s)]), (4,), 40)
            inside = (lo >= at) & (hi <= at + 40)
            spans.append(sorted(zip(sym[inside].tolist(), (lo[inside] - at).tolist(), (hi[inside] - at).tolist())))
        assert spans[0] == spans[1]


def test_decontamination(spark, docs, rows):
    texts = [t for _, t in rows if t]
    items = [(1, " ".join(brute.WORD.findall(texts[5])[:14])), (2, "one"), (10, texts[-1]), (10, "nothing of this kind appears here at all my friend ok"),
             (3, None), (4, ""), (None, texts[9]), (5, texts[5]), (5, texts[5]), (6, "na " * 12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(docs, bench).collect()
    want = brute.benchmark_hits(rows, items)
    assert bag((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got) == bag((i, *w) for (i, _), w in zip(rows, want))
    clean = decontaminate.clean_rows(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not w[1] for w in want)
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_with_a_full_index(docs, rows, spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_TERMS", 0)
    items = [(1, rows[5][1]), (2, "one")]
    got = decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert bag((r.doc_id, r.n_hit) for r in got) == bag((i, w[1]) for (i, _), w in zip(rows, brute.benchmark_hits(rows, items)))


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "q w red fox jumps far away"), (2, "red quick brown fox jumps"), (3, "fox red jumps")], "doc_id long, text string")
    items = decontaminate.item_table(spark.createDataFrame([(7, "red fox jumps")], "item_id long, text string"))
    planned = decontaminate.plan_windows(items, decontaminate.count_terms(docs, None), 10, 2)
    index = decontaminate.positional_index(docs, None)
    assert decontaminate.proximity_matches(index, planned, 0).count() >= 1
    assert decontaminate.proximity_matches(index, planned, 0).count() <= decontaminate.proximity_matches(index, planned, 2).count()


def test_near_items_against_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(0, 30))) for _ in range(60)]
    items = [(i, " ".join(rng.choice("abcd") for _ in range(n))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 6, 7])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")

    def near(text, item, window, slop):
        words, terms = text.split(), item.split()
        width = min(window, len(terms))
        for s in range(len(terms) - width + 1):
            for a in range(len(words)):
                span = iter(words[a:a + width + slop])
                if words[a] == terms[s] and all(t in span for t in terms[s:s + width]):
                    return True
        return False
    for slop in (1, 3):
        got = decontaminate.decontaminate(docs, bench, window=5, slop=slop).collect()
        assert bag((r.doc_id, tuple(r.near_items)) for r in got) == \
            bag((i, tuple(sorted(str(k) for k, item in items if near(t, item, 5, slop)))) for i, t in enumerate(texts))
        assert all(set(r["items"]) <= set(r.near_items) for r in got)


def test_repeats_of_one_word_and_parts_of_items(spark, monkeypatch):
    """Long runs of a word or of a pair of words in text and item: the work follows the lengths, not their product."""
    monkeypatch.setattr(decontaminate, "PART_WORDS", 300)
    texts = ["na " * 20000, "a b " * 8000, "c " + "b a " * 5 + "c", None, "x " + "na " * 9 + "y"]
    items = [(1, "na " * 1000), (2, "a b " * 400), (3, "b"), (4, "na " * 9 + "y")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), slop=2).collect()}
    assert [got[i].n_hit for i in range(5)] == [20000, 16000, 10, 0, 10]
    assert [got[i]["items"] for i in range(5)] == [["1"], ["2", "3"], ["2", "3"], [], ["4"]]
    assert got[0].near_items == ["1"] and got[1].near_items == ["2", "3"]


def test_empty_tables(none, spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert lm_score.score_held_out(none).count() == 0
    assert token_count.count_tokens(none, MODEL).count() == 0
    assert bpe.encode(none, VOCABULARY).count() == 0
    assert simhash.near_duplicates(none).count() == 0 and simhash.one_of_each(none).count() == 0
    assert substring.dedup_substrings(none).count() == 0
    assert decontaminate.decontaminate(none, bench).count() == 0


def test_lm_without_training_rows(spark):
    held = next(i for i in range(100) if brute.fold(i, 7) == 2)
    r = lm_score.score_held_out(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and math.isfinite(r.score)
