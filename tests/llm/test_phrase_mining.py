import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparkfolio.llm import phrase_mining as p
from sparkfolio.llm.queries import op11_collocations


def brute(rows, least=10, longest=3, most=2000, share=50):
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        cand = {x: a for x, a in counts.items() if len(x) > 1 and a >= least}
        dropped = {x[i:i + m] for x, a in cand.items() for m in range(2, len(x)) for i in range(len(x) - m + 1)
                   if 100 * a >= share * counts[x[i:i + m]]}
        scored = []
        for x, a in cand.items():
            if x not in dropped:
                score, k = min((10**6 * a * a // (counts[x[:k]] * counts[x[k:]]), k) for k in range(1, len(x)))
                scored.append((-score, -a, " ".join(x).encode(), counts[x[:k]], counts[x[k:]]))
        for rank, (score, a, x, left, right) in enumerate(sorted(scored)[:most], 1):
            out.append((lang, rank, x.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def test_query(spark, sf):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(map(tuple, op11_collocations(spark, sf).collect()))
    assert got == brute(rows) and len(got) > 100


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    letters = ["the", "The", "of", "new", "york", "city", "é", "日本", "x\x00", "a\x85b", "-", "'", *[f"w{i}" for i in range(30)]]
    rows = []
    for i in range(600):
        words = [rng.choice(letters[:4 + rng.randrange(38)]) for _ in range(rng.randrange(60))]
        rows.append((rng.choice(["en", "en", "fr", None, "und"]), "".join(w + rng.choice([" ", " ", "  ", "\t", " ", ". ", ",", "\n", "; "]) for w in words)))
    return rows + [("en", "new york city")] * 300 + [("en", None), (None, ""), ("xx", "...!"), ("de", "lang " * 40_000), ("fr", "a b\x0cc a b\x0bc a b\rc " * 30)]


def frame(spark, rows):
    return spark.createDataFrame([(i, a, b, 1, "p") for i, (a, b) in enumerate(rows)], "doc_id long, lang string, text string, n int, phrase string").repartition(5, "doc_id")


@pytest.mark.parametrize("options", [{}, {"least": 3, "most": 7}, {"least": 4, "longest": 4, "share": 30}, {"longest": 2}, {"fraction": 0.02, "least": 5}])
def test_against_brute_force(spark, corpus, options):
    want = {k: v for k, v in options.items() if k != "fraction"}
    assert sorted(map(tuple, p.collocations(frame(spark, corpus), **options, block=5_000).collect())) == brute(corpus, **want)


def test_passes_close_the_border_and_a_full_filter_loses_nothing(spark, corpus, monkeypatch):
    """A sample of nothing needs each expansion; a filter with every bit set counts all in the first pass."""
    docs = frame(spark, corpus)
    want = sorted(map(tuple, p.frequent_phrases(docs).collect()))
    passes, count = [], p.counted
    monkeypatch.setattr(p, "counted", lambda *a, **b: (passes.append(1), count(*a, **b))[1])
    none = docs.filter("doc_id < 0")
    real = type(docs).sample
    monkeypatch.setattr(type(docs), "sample", lambda self, *a, **b: self.limit(0))
    assert sorted(map(tuple, p.frequent_phrases(docs).collect())) == want and len(passes) == 4  # sample, words, pairs, threes
    monkeypatch.setattr(type(docs), "sample", real)
    passes.clear()
    assert sorted(map(tuple, p.frequent_phrases(docs, bits=1 << 15).collect())) == want and passes
    small = p.bit_filter(docs.select("lang", F.concat("doc_id", F.lit(" x")).alias("phrase")).filter("lang IS NOT NULL"), 1 << 15)
    assert len(small) == 1 << 12 and small.any()
    assert p.collocations(none).count() == 0


def test_products_pass_64_bits(spark):
    big = 9 * 10**14
    rows = [("en", "", 10**15), ("en", "a", big), ("en", "b", big - 1), ("en", "c", 10**13), ("en", "a b", big - 2), ("en", "b c", 12), ("en", "a b c", 11)]
    got = {r.phrase: r for r in p.ranked(spark.createDataFrame(rows, "lang string, phrase string, n long"), 3, 10, 50).collect()}
    assert set(got) == {"a b", "a b c"}  # "b c" lies within the longer one
    assert got["a b"].score == 10**6 * (big - 2)**2 // (big * (big - 1))
    assert (got["a b c"].l, got["a b c"].r) == (big, 12) or got["a b c"].score == min(10**6 * 121 // (big * 12), 10**6 * 121 // ((big - 2) * 10**13))


def test_filter_in_numpy_holds_what_spark_sets(spark):
    rows = [("en", "new york", 5), ("en", "york", 5), ("fr", "é", 5), ("en", "x\x00 y z", 1)]
    bits = p.bit_filter(spark.createDataFrame(rows, "lang string, phrase string, n long"))
    one = lambda lang, *w: p.longer_hash(np_hash(lang, w[0]), np_hash(lang, w[1])) if len(w) == 2 else np_hash(lang, w[0])
    import numpy as np

    def np_hash(lang, w):
        return np.array([p.word_hash(w.encode(), lang)], np.uint64)

    assert p.holds(bits, one("en", "new", "york")).all() and p.holds(bits, one("fr", "é")).all()
    assert not p.holds(bits, one("fr", "york")).any() and not p.holds(bits, one("en", "york", "new")).any()
    assert int(np.unpackbits(bits).sum()) <= 4 * p.MARKS
