import brute
import numpy as np
import public_tokenizers

import __spark_entry__ as entry
import corpus_pipeline as P
from tillbook.llm import quality
from tillbook.llm.common import table

SF = "/root/testdata/sf0.001"


def test_registered():
    names = list(entry.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert 4 <= len(P.STAGES) <= 5


def test_pipeline_against_brute_force(spark):
    from tokenizers import Tokenizer

    docs = table(spark, SF, "documents")
    good = P.quality_classifier(spark, docs, SF)
    assert good.columns == docs.columns
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    marks = [labels[r.doc_id] for r in good.select("doc_id").collect() if r.doc_id in labels]
    assert marks and np.mean(marks) > 0.97
    rows = sorted((r.doc_id, r.text) for r in good.select("doc_id", "text").collect())

    label = brute.near_components([brute.fingerprint(t) for _, t in rows])
    rows = [r for k, r in enumerate(rows) if label[k] == k]
    single = P.simhash_near_dedup(spark, good, SF)
    assert single.columns == docs.columns and sorted(r.doc_id for r in single.select("doc_id").collect()) == [i for i, _ in rows]

    rows = [(i, kept if gone else t) for (i, t), (_, gone, kept) in zip(rows, brute.substrings(rows))]
    cut = P.substring_dedup(spark, single, SF)
    assert dict(cut.dtypes) == dict(docs.dtypes) and cut.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in cut.select("doc_id", "text").collect()) == rows

    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    rows = [r for r, (_, hit, _) in zip(rows, brute.benchmark_hits(rows, items)) if not hit]
    clean = P.benchmark_decontamination(spark, cut, SF)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.select("doc_id").collect()) == [i for i, _ in rows]

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in rows:
        ids = tok.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(tok.decode(ids, skip_special_tokens=False))))
    assert sorted(tuple(r) for r in P.run(spark, SF).collect()) == want


def test_stages_take_odd_rows(spark, docs, none):
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, none, SF).count() == 0
    assert P.STAGES[-1][1](spark, none, SF).count() == 0
    assert quality.THRESHOLD == 0.7
