import math
import random
import re
from collections import Counter

from sparkfolio.llm import lexical_search as s
from sparkfolio.llm.queries import op12_ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in TERM.findall(text or "")]


def brute(docs, queries, k=50):
    bags = [(key, Counter(words(text))) for key, text in docs]
    total, length = sum(1 for _, b in bags if b), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in queries:
        asked = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) for t in set(words(text))}
        scores = []
        for key, bag in bags:
            if length:
                m = 50 + (50 * bag.total() * total) // length
                score = sum(w * ((1000000000 * bag[t]) // (1000 * bag[t] + 20 * m)) for t, w in asked.items() if t in bag)
                if score > 0:
                    scores.append((-score, key is None, key or 0))
        out += [(item, r, None if none else key, -score) for r, (score, none, key) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted(map(tuple, op12_ranked_search(spark, sf).collect()), key=str) == brute(docs, items)


def test_terms():
    text = "Ab-1 ÄÉ x\u0085y_z\x00Q`{|}~\x7f@[/:9"
    assert [x.decode() for x in s.terms(text.encode())] == words(text) and s.terms(None) == []


def test_ties_repeats_nulls_blocks_windows(spark):
    rng = random.Random(4)
    letters = ["the", "of", "The", *[f"w{i}" for i in range(40)]]
    docs = [(rng.randrange(200), " ".join(rng.choice(letters[:3 + rng.randrange(41)]) for _ in range(rng.randrange(40)))) for _ in range(400)]
    docs += [(7, "the w1 w2")] * 120 + [(None, "the w1 w2"), (None, None), (8, ""), (9, "?!"), (10, "w3 " * 50000)]
    items = [(i % 9, " ".join(rng.choice(letters) for _ in range(rng.randrange(1, 12)))) for i in range(12)]
    items += [(20, None), (21, ""), (22, "..."), (23, "absent"), (24, "the the The"), (None, "w1")]
    want = {k: brute(docs, items, k) for k in (50, 3)}
    d = spark.createDataFrame([(a, b, 1, "x") for a, b in docs], "doc_id long, text string, item_id int, n string").repartition(3)
    q = spark.createDataFrame([(a, b, 1) for a, b in items], "item_id long, text string, doc_id int")
    few = {"postings": 300, "window": 16}
    for k, options in ((50, {}), (50, few), (3, few | {"share": 0.5}), (3, few | {"block_bytes": 60, "share": 0})):
        assert sorted(map(tuple, s.search(d, q, k=k, **options).collect()), key=str) == want[k]
    assert s.search(d.limit(0), q).count() == 0 and s.search(d, q.limit(0)).count() == 0
    assert s.search(d.filter("text = ''"), q).count() == 0


def test_lists_below_the_floor_are_not_walked(monkeypatch):
    """A frequent term of little weight isn't walked once better documents fill the ranks."""
    import numpy as np

    n = 40_000
    term = np.concatenate((np.zeros(n, np.int64), np.ones(60, np.int64)))
    doc = np.concatenate((np.arange(n), np.arange(60)))
    chunk = s.Chunk(np.arange(n), np.full(n, 100), doc, term, np.ones(n + 60, np.int64), np.array([1, 5000]))
    walked = []
    find = np.searchsorted
    monkeypatch.setattr(s.np, "searchsorted", lambda a, v, *x, **y: (walked.append(len(a)), find(a, v, *x, **y))[1])
    best = s.Best(1, 50)
    chunk.search(0, np.array([0, 1]), best)
    assert best.key[0].tolist() == list(range(50)) and walked.count(n) == 1  # in the first window only
