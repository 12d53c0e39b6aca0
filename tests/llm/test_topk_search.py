import math
import random

from pyspark.sql import functions as F

from sparkfolio.llm import topk_search as t
from sparkfolio.llm.queries import op2_topk


def brute(rows, k=10):
    ok = [(i, key, [math.floor(1024 * x) for x in v]) for i, (key, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, key, v in ok:
        if key is not None and key % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), other is None, other or 0) for j, other, w in ok if j != i)
            out += [(key, n, None if none else other, -s) for n, (s, none, other) in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


def test_query(spark, sf):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, op2_topk(spark, sf).collect()), key=str) == brute(rows)


def test_ties_repeats_nulls_blocks(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(400), [rng.choice([-1.5, 0.25, 1.0, 1e-3]) for _ in range(5)]) for _ in range(500)]
    rows += [(100, [1.0] * 5)] * 30 + [(200, None), (None, [1.0] * 5), (300, [1.0, None, 1.0, 1.0, 1.0]), (300, [float("nan")] * 5), (0, [float("inf")] * 5), (0, []), (-100, [2.0])]
    frame = spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<double>, row int").repartition(5)
    is_query = F.col("vec_id") % 100 == 0
    want = brute(rows)
    for options in ({}, {"block_rows": 7, "bins": 4}):
        assert sorted(map(tuple, t.top_k(frame, is_query, **options).collect()), key=str) == want
    assert t.top_k(frame.limit(0), is_query).count() == 0
    few = frame.filter("vec_id < 0 OR size(embedding) = 0").filter("embedding IS NOT NULL")
    assert sorted(map(tuple, t.top_k(few, is_query).collect())) == [(-100, 1, 0, 0), (0, 1, -100, 0)]


def test_scores_above_a_range_are_not_counted_again(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.25) for _ in range(16)]) for i in range(1500)]
    rows += [(2 ** 63 - 1, rows[100][1]), (None, rows[100][1])]  # the largest key is no null
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    want = brute(rows)
    for bins in (7, 256):
        assert sorted(map(tuple, t.top_k(frame, F.col("vec_id") % 100 == 0, bins=bins).collect()), key=str) == want


def test_scores_near_the_end_of_64_bits(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 6e5) for _ in range(4)]) for i in range(200)]
    rows += [(1000 + i, v) for i, v in rows]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert sorted(map(tuple, t.top_k(frame, F.col("vec_id") % 100 == 0).collect()), key=str) == brute(rows)
