import random

import pytest

from sparkfolio.llm import mixing
from sparkfolio.llm.queries import op8_mixing


def fill(sizes):
    """Targets by resharing the excess again and again."""
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda x: (x is None, x or "")))}
    left, open_, out = 1.5 * sum(sizes.values()), set(sizes), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        stop = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not stop:
            return out | {s: level * weight[s] for s in open_}
        for s in stop:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= stop
    return out


def check(rows, source_of):
    by = {}
    for r in rows:
        assert r.size >= 0 and 0 <= r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0)
        by.setdefault(source_of(r), []).append(r)
    want = fill({s: sum(r.size for r in x) for s, x in by.items()})
    for s, x in by.items():
        assert x[0].source_size == sum(r.size for r in x)
        assert x[0].target == pytest.approx(want[s], rel=1e-9)
        assert abs(sum(r.taken for r in x) - want[s]) <= max(r.size for r in x) + 1e-6


def test_pivot_keeps_mass_and_expectation():
    rng = random.Random(3)
    sizes = [rng.randint(1, 50) for _ in range(200)]
    total = [0.0] * 200
    for _ in range(400):
        got = mixing.pivot([0.3] * 200, sizes, [rng.random() for _ in sizes])
        assert sum(0 < p < 1 for p in got) <= 1
        assert sum(p * w for p, w in zip(got, sizes)) == pytest.approx(0.3 * sum(sizes))
        total = [a + b for a, b in zip(total, got)]
    assert max(abs(t / 400 - 0.3) for t in total) < 0.12


def test_query_and_rerun(spark, sf):
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    first = op8_mixing(spark, sf).collect()
    assert len(first) == len(source)
    check(first, lambda r: source[r.doc_id])
    assert sorted(first) == sorted(op8_mixing(spark, sf).collect())


def test_tree_nulls_repeats_empty(spark):
    rng = random.Random(1)
    rows = [(i if i % 3 else None, "w " * rng.randint(0, 30), None if i % 5 == 0 else "s" * (i % 7 % 4), i) for i in range(900)]
    rows += [(7, "a b c", "s", 1)] * 40 + [(8, None, "gone", 1), (9, "x " * 20000, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(docs, bucket_rows=40, fan_in=3).collect()
    assert len(got) == len(rows)
    check(got, lambda r: r.source)
    again = mixing.mix(docs.repartition(7), bucket_rows=40, fan_in=3).collect()
    assert sorted(r.size for r in again) == sorted(r.size for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert [r.taken for r in mixing.mix(docs.filter("source = 'gone'")).collect()] == [0]
