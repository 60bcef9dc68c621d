import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: Columns whose names the operators use inside.
CLASH = "row score n_words spans shard text_key starts fp copy tag c1 gram bucket found"
DDL = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{c} string" for c in CLASH.split())


def words(rng, n):
    return " ".join(rng.choice(["alpha", "Beta", "gamma,", "été", "x", "the", "of", "日本"]) + str(rng.randrange(400)) for _ in range(n))


def make_rows():
    """Copies, near copies, shared passages, runs of one word, nulls, empty, very long and repeated rows."""
    rng = random.Random(5)
    base = [words(rng, rng.randrange(1, 160)) for _ in range(60)]
    passage = words(rng, 60)
    texts = list(base)
    texts += [b + " tail" for b in base[:8]] + base[:6] + base[:2]
    texts += [words(rng, 15) + "\n" + passage + " " + words(rng, 9) for _ in range(8)]
    texts += ["na " * 75, "na " * 50 + "ba", "a b " * 40, "a  b\ta b " * 20, "", None, " \n\t ", "one", words(rng, 4000), "y" * 5000, passage[:200]]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rows += [rows[0], rows[70], (None, base[3]), (None, None), (None, passage), (9, words(rng, 30))]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None, *[c for c in CLASH.split()]) for i, t in rows], DDL).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DDL)
