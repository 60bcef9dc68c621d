"""Plain Python versions of the operators, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def fold(doc_id, n):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def lm_base(rows, folds=7, held=2):
    """Per row: (n_tokens, n_known, train_tokens, base_score)."""
    toks = [WORD.findall((t or "").translate(LOWER)) + [None] for _, t in rows]
    c = Counter()
    for (i, _), w in zip(rows, toks):
        if fold(i, folds) != held:
            c.update(w)
    n, v = sum(c.values()), len(c)
    return [(len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for w in toks]


def fingerprint(text, k=3):
    w = WORD.findall((text or "").translate(LOWER))
    grams = [" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_components(fps, radius=2):
    """Per item the smallest index reachable over links of at most ``radius`` bits."""
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= radius and label[j] < label[i]:
                    label[i] = label[j]
                    changed = True
    return label


def substrings(rows, window=20):
    """Per row: (n_words, n_removed, kept text); a null doc_id comes last."""
    key = [(i is None, i or 0) for i, _ in rows]
    words = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for k, w in zip(key, words):
        for s in range(len(w) - window + 1):
            g = tuple(w[s:s + window])
            first[g] = min(first.get(g, (k, s)), (k, s))
    out = []
    for k, w in zip(key, words):
        gone = {i for s in range(len(w) - window + 1) if first[tuple(w[s:s + window])] < (k, s) for i in range(s, s + window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def benchmark_hits(rows, items, window=10):
    """Per row: (n_words, n_hit, sorted item ids)."""
    grams = {}
    for item, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[s:s + n]), set()).add("" if item is None else str(item))
    out = []
    for _, text in rows:
        w, hit, ids = ALNUM.findall((text or "").translate(LOWER)), set(), set()
        for n in {len(g) for g in grams}:
            for s in range(len(w) - n + 1):
                if found := grams.get(tuple(w[s:s + n])):
                    hit.update(range(s, s + n))
                    ids |= found
        out.append((len(w), len(hit), sorted(ids)))
    return out


def echoed(doc_id, text):
    """The words of a text; in one of ten they repeat themselves from some word on."""
    w = WORD.findall(text or "")
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def periodic_runs(w, least=6, times=4):
    """(start, length, period) of each run, and the words that no run holds beyond its first period."""
    found = {}
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i + p - s >= max(least, times * p) and i > s:
                found.setdefault((s, i + p), p)
            i += 1
    runs = sorted((s, e - s, p) for (s, e), p in found.items())
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return runs, [x for i, x in enumerate(w) if i not in gone]


def run_digest(doc_id, text):
    runs, kept = periodic_runs(echoed(doc_id, text))
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(kept)))


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def divergences(rows, least_docs=3, best=200):
    """(lang, source, part, item, value, rank) of all groups; rows are (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    words = [TERM.findall(t.translate(LOWER)) for _, _, t in rows]
    docs, counts = Counter(), {}
    for (lang, source, _), w in zip(rows, words):
        docs.update((lang, t) for t in set(w))
        counts.setdefault((lang, source), Counter()).update(w)
    out = []
    for lang in {g for g, _ in counts}:
        terms = sorted(t for (g, t), n in docs.items() if g == lang and n >= least_docs)
        own = {s: c for (g, s), c in counts.items() if g == lang}

        def shares(c):
            n = sum(c[t] for t in terms) + len(terms)
            return {t: 1 + 10**9 * (c[t] + 1) // n for t in terms}
        p, q = {s: shares(c) for s, c in own.items()}, shares(sum(own.values(), Counter()))
        for s in own:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in terms)) for o in own if o != s]
            tops = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in terms if own[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", tops)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(items[:best if part == "term" else None])]
    return out


def alike_sets(rows, k=5, percent=80):
    """Per row: (doc_id, set size, smallest doc_id reachable; null only without any id)."""
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * len(a | sets[j]):
                label[top(i)] = top(j)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[top(i)] = min(low.get(top(i), doc_id), doc_id)
    return [(doc_id, len(s), low.get(top(i))) for i, ((doc_id, _), s) in enumerate(zip(rows, sets))]
