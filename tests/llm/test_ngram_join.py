import random

import numpy as np
import pytest

from sparkfolio.llm import ngram_join as j
from sparkfolio.llm.queries import op7_ngram_join


def sets_of(texts, n):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    return out


def brute(rows, n, percent):
    """Component of each row by comparing all pairs."""
    sets, up = sets_of([t for _, t in rows], n), list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for k in range(i):
            if sets[i] and sets[k] and 100 * len(sets[i] & sets[k]) >= percent * len(sets[i] | sets[k]):
                up[find(i)] = find(k)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return sorted(((key, len(sets[i]), key if not sets[i] else least.get(find(i))) for i, (key, _) in enumerate(rows)), key=str)


def edited(rng, words, share):
    return " ".join(f"z{rng.randrange(10**6)}" if rng.random() < share else w for w in words)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_against_all_pairs(spark, n, percent):
    rng = random.Random(n)
    line = " ".join(f"licence{i}" for i in range(30))
    rows = []
    for c in range(25):
        base = [f"w{rng.randrange(900)}" for _ in range(rng.choice([3, 9, 20, 60, 200]))]
        rows += [(len(rows) + i, edited(rng, base, rng.choice([0, 0.003, 0.01, 0.02, 0.04]))) for i in range(10)]
    rows += [(1000 + i, line + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.choice([2, 6, 40])))) for i in range(60)]
    rows += [(2000 + i, " ".join(f"w{k}" for k in range(i, i + 60))) for i in range(12)]  # a chain
    rows += [(3000, None), (3001, ""), (3002, " \n"), (3003, "One"), (3004, "one"), (3005, "a b"), (None, "one"), (None, None), (0, rows[0][1]), (0, rows[11][1]), (3006, "x " * 20000)]
    docs = spark.createDataFrame([(k, t, "z", 1) for k, t in rows], "doc_id long, text string, node string, n int")
    got = j.classes(docs, n, percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, n, percent)
    kept = j.keep_one(docs, n, percent)
    assert kept.columns == docs.columns
    want = {c for k, s, c in brute(rows, n, percent) if s}
    words = [r.doc_id for r in kept.collect() if (r.text or "").split()]
    # Key 0 names documents of two classes.
    assert len(words) == len(set(words)) + 1 and set(words) == want
    assert j.classes(docs.limit(0), n, percent).count() == 0


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(4)
    for percent in (80, 90):
        for _ in range(1500):
            size = int(rng.integers(1, 120))
            one = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            frequent = np.sort(rng.choice(one, len(one) * int(rng.integers(0, 2)) // 1))
            gone = int(rng.integers(0, len(one) + 1))
            other = np.unique(np.concatenate([one[gone * int(rng.integers(0, 2)) // 8:], rng.integers(0, 2**63, int(rng.integers(0, len(one) // 5 + 1))).astype(np.uint64)]))
            both = len(np.intersect1d(one, other))
            if 100 * both >= percent * (len(one) + len(other) - both) and len(one) != both:
                bits = sum(int(x).bit_count() for x in (j.sketch(one) ^ j.sketch(other)).view(np.uint64))
                assert bits <= len(one) + len(other) - 2 * both
                assert np.intersect1d(j.signatures(one, percent, frequent), j.signatures(other, percent, frequent)).size


def test_query_against_all_pairs(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in op7_ngram_join(spark, sf).collect()), key=str)
    assert got == brute(rows, 3, 90)


def test_pairs_of_a_large_group_grow_with_its_members(spark, monkeypatch):
    """2,000 near copies of one text, in two classes, and 700 equal rows: pairs tried don't grow with the square."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(2000):
        words = list(base)
        for _ in range(1 if i % 2 else 6):  # six changed words: often too far from others
            words[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(5000 + i, " ".join(base)) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    tried = []
    real = j._verified
    monkeypatch.setattr(j, "_verified", lambda pairs, *a: (tried.append(pairs.count()), real(pairs, *a))[1])
    got = {r.doc_id: r.component_id for r in j.classes(docs, n=5, percent=80).collect()}
    assert len(got) == 2700 and len({got[i] for i in range(1, 2000, 2)} | {got[5000 + i] for i in range(700)}) == 1
    assert all(n <= 10 * 2000 for n in tried) and tried[-1] < 2000, tried  # not 2000 * 2000 / 2
