import hashlib
import random

import pytest

from sparkfolio.llm import suffix_dedup as s
from sparkfolio.llm.queries import op6_suffix_dedup


def brute(rows, length):
    count = {}
    data = [(t or "").encode() for _, t in rows]
    for d in data:
        for i in range(len(d) - length + 1):
            h = hash(d[i:i + length])
            count[h] = count.get(h, 0) + 1
    out = []
    for (key, _), d in zip(rows, data):
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if count[hash(d[i:i + length])] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((key, len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(frame):
    return sorted(((r[0], r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in frame.collect()), key=str)


def test_orders_and_common_prefixes():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 30)
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 3, 9, 40]))) for _ in range(n)]
        strings += [b"ab" * 40 + s_ for s_ in strings[:5]]
        for shallow in (8, 64):
            order, lcp = s.deep_shallow(strings, 0, shallow)
            assert [strings[i] for i in order] == sorted(strings) and sorted(order) == list(range(len(strings)))
            assert all(lcp[k] == s.common(strings[order[k - 1]], strings[order[k]]) for k in range(1, len(order)))


def fixture(rng, length):
    word = lambda: "".join(rng.choice("abcdefghij é") for _ in range(rng.randint(1, 9)))
    fresh = lambda n: " ".join(word() for _ in range(n))
    shared = [fresh(rng.choice([10, 14, 20, 60])) for _ in range(12)]
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice([fresh(rng.randint(1, 30)), rng.choice(shared)])
            cut = rng.randint(0, 20)
            parts.append(p[cut:] if rng.random() < 0.3 else p[:len(p) - cut])
        texts.append("".join(parts))
    texts += texts[:15] + [None, "", "a" * (length - 1), "a" * length, "a" * 700, "ab" * 500, "é" * 300, "x" * 50 + texts[0], "abc" * 4000]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)]
    return rows + rows[:4] + [(2, texts[50])]


@pytest.mark.parametrize(("length", "most"), [(60, 1_000), (60, 2), (40, 1_000), (100, 5)])
def test_against_all_strings(spark, length, most):
    rows = fixture(random.Random(length + most), length)
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, doc string")
    assert result(s.remove_repeated(docs, length, most)) == brute(rows, length)
    assert s.remove_repeated(docs.limit(0), length).count() == 0


def test_blocks(monkeypatch):
    rng = random.Random(1)
    data = bytes(rng.choice(b"abcd") for _ in range(5000))
    whole = s.anchors(data, 60)
    monkeypatch.setattr(s, "BLOCK", 700)
    parts = s.anchors(data, 60)
    assert set(zip(whole[0], whole[4])) == set(zip(parts[0], parts[4]))
    assert sorted(p for a, b in zip(parts[2], parts[3]) for p in range(a, b + 1)) == list(range(len(data) - 59))


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, op6_suffix_dedup(spark, sf).collect()), key=str) == brute(rows, 400)
