"""Hand values of the Column functions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfolio.functions import trading as X
from sparkfolio.functions.numbers import cents
from sparkfolio.functions.ordering import ordered_positions, with_halo
from sparkfolio.functions.random import uniform_block, with_draw, with_uniform


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def lits(*values):
    return [F.lit(v) for v in values]


def test_fill_and_exit(spark):
    fill = lambda *v: X.entry_fill(*lits(*v))
    row = one(spark, fill(10.0, 11.0, 12.0, 13.0, 10.5).alias("a"), fill(10.0, 11.0, 9.0, 11.0, 8.0).alias("b"),
              fill(10.0, 11.0, 12.0, 13.0, 11.5).alias("c"),
              X.entry_fill(*lits(10.0, 11.0, 9.0, 11.0, 8.0), F.lit(9.0)).alias("d"))
    assert (row.a, row.b, row.c, row.d) == (11.0, 10.0, None, None)
    both = X.bar_exit(*lits("long", 9.0, 12.0, 12.5, 8.5))
    short = X.bar_exit(*lits("short", 12.0, 9.0, 11.0, 8.5))
    none = X.bar_exit(F.lit("long"), F.lit(9.0), F.lit(None).cast("double"), F.lit(99.0), F.lit(9.5))
    row = one(spark, both.alias("a"), short.alias("b"), none.alias("c"))
    assert (row.a.price, row.a.reason) == (9.0, "stop")
    assert (row.b.price, row.b.reason) == (9.0, "target")
    assert row.c is None


def test_r_multiple_and_rounding(spark):
    row = one(spark, X.r_multiple(*lits("long", 10.0, 9.0, 12.0)).alias("a"),
              X.r_multiple(*lits("short", 10.0, 11.0, 12.0)).alias("b"),
              X.r_multiple(*lits("long", 10.0, 10.0, 12.0)).alias("c"),
              cents(F.lit(-0.125)).alias("d"), cents(F.lit(0.125)).alias("e"))
    assert (row.a, row.b, row.c, row.d, row.e) == (2.0, -2.0, -math.inf, -0.12, 0.13)


def test_confidence_and_factors(spark):
    norm = lambda v: X.normal_confidence(F.lit(v).cast("double"))
    row = one(spark, norm(55.0).alias("a"), norm(0.4).alias("b"), norm(None).alias("c"), norm(250.0).alias("d"),
              X.trade_confidence(F.lit(7)).alias("e"), X.trade_confidence(F.lit(10)).alias("f"),
              X.risk_factor(F.lit(0.02), F.lit(0.3)).alias("g"),
              X.risk_factor(F.lit(None).cast("double"), F.lit(None).cast("double")).alias("h"),
              X.is_improvement(F.lit(10.0), F.lit(10.0), 0.0).alias("i"), X.sigmoid(F.lit(-800.0)).alias("j"))
    assert (row.a, row.b, row.c, row.d, row.e, row.f, row.h, row.i) == (0.55, 0.4, None, 1.0, 0.0, 0.5, 1.0, False)
    assert row.g == pytest.approx(0.9 * 0.95)
    assert row.j == 0.0


def test_position_size_takes_the_smaller_budget(spark):
    by_risk = X.position_size(*lits(10_000.0, 5_000.0, 0.01, 5.0, 100.0))
    by_cash = X.position_size(*lits(10_000.0, 5_000.0, 0.02, 1.0, 100.0))
    row = one(spark, by_risk.alias("a"), by_cash.alias("b"))
    assert (row.a, row.b) == (20, 49)


@pytest.mark.parametrize("side,stop,target,problem", [
    ("long", 95.0, 110.0, []), ("long", 101.0, 110.0, ["stop_side"]), ("long", 99.9, 110.0, ["stop_distance"]),
    ("long", 90.0, 103.0, ["reward_risk"]), ("long", 95.0, None, []), ("up", 95.0, 110.0, ["side"]),
])
def test_proposal_contract(spark, side, stop, target, problem):
    problems = X.proposal_problems(F.lit(side), F.lit(100.0), F.lit(100.0), F.lit(stop), F.lit(target).cast("double"),
                                   F.lit(5), F.lit("s"), F.lit("r"))
    found = one(spark, problems.alias("p")).p
    assert [p for p in found if p in problem or not problem] == problem


def sequential(seed, count):
    """The plain stateful form of the generator."""
    out, mask = [], 0xFFFFFFFF
    for _ in range(count):
        seed = (seed + 0x6D2B79F5) & mask
        t = ((seed ^ (seed >> 15)) * (seed | 1)) & mask
        t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & mask)) & mask
        out.append((t ^ (t >> 14)) / 4294967296)
    return out


@pytest.mark.parametrize("seed", [0, 42, 0xC0FFEE, 0xBEEF, 0xFFFFFFFF])
def test_counter_draws_equal_the_stream(spark, seed):
    want = sequential(seed, 300)
    rows = with_uniform(spark.range(300), F.lit(seed), F.col("id")).orderBy("id").collect()
    assert [r.u for r in rows] == want
    assert list(uniform_block(seed, 0, 300)) == want
    assert list(uniform_block(seed, 100, 50)) == want[100:150]
    drawn = with_draw(spark.range(300), F.lit(seed), F.col("id"), F.lit(7)).orderBy("id").collect()
    assert [r.pos for r in drawn] == [int(u * 7) for u in want]


@pytest.mark.parametrize("partitions", [1, 7])
def test_positions_are_exact_with_a_hot_group(spark, partitions):
    rng = np.random.default_rng(1)
    rows = [("hot", float(v)) for v in rng.integers(0, 50, 900)] + [("a", 3.0), ("a", 1.0), ("b", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(partitions)
    got = ordered_positions(df, ["k"], ["v"]).collect()
    for key in ("hot", "a", "b"):
        mine = sorted((r.pos, r.v) for r in got if r.k == key)
        assert [p for p, _ in mine] == list(range(len(mine)))
        assert [v for _, v in mine] == sorted(v for k, v in rows if k == key)
        assert {r.group_rows for r in got if r.k == key} == {len(mine)}


def test_halo_lends_the_rows_before_each_block(spark):
    df = spark.range(25).select(F.lit("k").alias("k"), F.col("id").alias("pos"))
    rows = with_halo(df, ["k"], "pos", back=3, block=10).collect()
    assert sorted(r.pos for r in rows if r._own) == list(range(25))
    assert sorted(r.pos for r in rows if not r._own and r._block == 1) == [7, 8, 9]
