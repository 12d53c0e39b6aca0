"""Seeded resampling over tables: bootstraps, perturbed prices, parameter points.

Every draw is a function of (seed, draw number), so draws are made wherever their row is.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.ordering import ordered_positions, packed, unpacked, with_halo
from ..functions.random import uniform_at, uniform_block, with_uniform

PART = 131_072  # positions of a part that is asked for picks
WHOLE = 4_194_304  # positions of a fold that one task may hold
TRADE_ORDER = ["exit_date", "entry_date", "symbol", "profit"]


# ---- block bootstrap --------------------------------------------------------------
def placed_trades(trades: DataFrame) -> DataFrame:
    return ordered_positions(trades.select("strategy", "fold", *TRADE_ORDER), ["strategy", "fold"], TRADE_ORDER, size="n")


def block_sums(placed: DataFrame) -> DataFrame:
    """Sum of the circular block that starts at each trade, per (strategy, fold).

    Also for the shorter last block.  Blocks are at most ten trades; the first ten trades of a fold
    are repeated after its end, and the frame runs over blocks of positions with a halo, so a fold
    with very many trades is cut over many tasks.
    """
    keys = ["strategy", "fold"]
    n, pos = F.col("n"), F.col("pos")
    length = F.greatest(F.lit(1).cast("bigint"), F.least(F.lit(K.BOOTSTRAP_BLOCK).cast("bigint"), F.floor(n / 2)))
    rows = placed.select(*keys, "pos", "n", length.alias("b"), "profit")
    # Reverse positions turn "the next b-1 trades" into preceding rows, which the halo provides.
    wrapped = F.when(pos < F.col("b") - 1, F.array(pos, pos + n)).otherwise(F.array(pos))
    back = rows.withColumn("_p", F.explode(wrapped)).withColumn("_q", 2 * n - F.col("_p"))
    blocks = with_halo(back, keys, "_q", K.BOOTSTRAP_BLOCK)
    frame = Window.partitionBy(*keys, "_block").orderBy("_q").rowsBetween(1 - K.BOOTSTRAP_BLOCK, 0)
    ahead = F.reverse(F.collect_list("profit").over(frame))
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    summed = blocks.withColumn("_ahead", ahead).where(F.col("_own") & (F.col("_p") < n))
    rest = F.coalesce(F.pmod(n, F.col("b")), F.lit(0))
    return summed.select(
        *keys, "pos", "n", "b", add(F.slice("_ahead", F.lit(1), F.col("b").cast("int"))).alias("full_sum"),
        add(F.slice("_ahead", F.lit(1), F.when(rest == 0, F.col("b")).otherwise(rest).cast("int"))).alias("last_sum"))


BLOCK_REQUESTS = T.ArrayType(T.StructType([T.StructField("part", T.LongType()), T.StructField("short", T.BooleanType()),
                                           T.StructField("per_draw", T.ArrayType(T.IntegerType())),
                                           T.StructField("at", T.ArrayType(T.IntegerType()))]))


def _block_picks(n: int, per_draw: int, before: int, seed: int, draw: int, draws: int, first: int, count: int) -> np.ndarray:
    """Start positions of blocks first..first+count-1 of a fold, a row per draw."""
    k = np.arange(draw, draw + draws, dtype=np.uint64)[:, None] * np.uint64(per_draw) + np.arange(
        before + first, before + first + count, dtype=np.uint64)
    return (uniform_at(int(seed), k) * n).astype(np.int64)


def _drawn_sums(draws: int, seed: int, chunk: int, draw_chunk: int):
    """Per draw, the sum of the picked blocks of a fold, whose block sums one task holds; some draws of some blocks at a time."""

    def run(table: pa.Table) -> pa.Table:
        n, total, stride, skip = (table[name][0].as_py() for name in ("_n", "blocks", "per_draw", "before"))
        full, last, sums = unpacked(table, "full_sum", n), unpacked(table, "last_sum", n), np.zeros(draws)
        for d in range(0, draws, draw_chunk):
            many = min(draw_chunk, draws - d)
            for b in range(0, total, chunk):
                picks = _block_picks(n, stride, skip, seed, d, many, b, min(chunk, total - b))
                ends = picks.shape[1] - (b + chunk >= total)  # the last block may be shorter
                sums[d:d + many] += full[picks[:, :ends]].sum(axis=1) + last[picks[:, ends:]].sum(axis=1)
        names = ("strategy", "fold")
        return pa.table({**{name: pa.array([table[name][0].as_py()] * draws, pa.string()) for name in names},
                         "draw": pa.array(range(draws), pa.int64()), "fold_sum": sums})

    return run


@F.pandas_udf(BLOCK_REQUESTS)
def _request_blocks(n: pd.Series, blocks: pd.Series, per_draw: pd.Series, before: pd.Series, seed: pd.Series, draw: pd.Series,
                    draws: pd.Series, first: pd.Series, count: pd.Series, part: pd.Series) -> pd.Series:
    """The picks of a job by the part they lie in: positions there, draw by draw, and how many each draw has."""
    answers = []
    for size, total, stride, skip, s, d, many, b, c, chunk in zip(n, blocks, per_draw, before, seed, draw, draws, first, count, part):
        picks, rows = _block_picks(size, stride, skip, s, d, many, b, c), []
        ends = c - 1 if b + c == total else c
        for short, some in ((False, picks[:, :ends]), (True, picks[:, ends:])):
            where = some // chunk
            for k in np.unique(where):
                rows.append({"part": int(k), "short": short, "per_draw": (where == k).sum(axis=1).astype(np.int32),
                             "at": (some[where == k] % chunk).astype(np.int32)})
        answers.append(rows)
    return pd.Series(answers)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _answer_sums(values: pd.Series, at: pd.Series, per_draw: pd.Series) -> pd.Series:
    return pd.Series([np.bincount(np.repeat(np.arange(len(c)), c), np.asarray(v, dtype=float)[x], len(c))
                      for v, x, c in zip(values, at, per_draw)])


def bootstrap_shape(trades: DataFrame) -> DataFrame:
    """Rows and blocks of each fold; draw numbers follow the stream: draw, then fold by name, then block."""
    shape = trades.groupBy("strategy", "fold").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "_b", F.greatest(F.lit(1).cast("bigint"), F.least(F.lit(K.BOOTSTRAP_BLOCK).cast("bigint"), F.floor(F.col("n") / 2)))).withColumn(
        "blocks", F.ceil(F.col("n") / F.col("_b")))
    folds = Window.partitionBy("strategy")
    before = folds.orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    return shape.withColumn("per_draw", F.sum("blocks").over(folds)).withColumn(
        "before", F.coalesce(F.sum("blocks").over(before), F.lit(0))).drop("_b")


def bootstrap_jobs(trades: DataFrame, draws: int, chunk: int, draw_chunk: int) -> DataFrame:
    """Some draws' run of blocks of a fold a row."""
    return bootstrap_shape(trades).withColumn(
        "draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(draw_chunk)))).withColumn(
        "draws", F.least(F.lit(draw_chunk), F.lit(draws) - F.col("draw"))).withColumn(
        "first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1, F.lit(chunk).cast("bigint")))).withColumn(
        "count", F.least(F.lit(chunk), F.col("blocks") - F.col("first")))


def block_requests(jobs: DataFrame, seed: int, part: int) -> DataFrame:
    """The picks of each job, drawn once: a row per job and part of the fold that they touch."""
    return jobs.repartition("strategy", "fold", "draw", "first").select(
        "strategy", "fold", "draw", F.explode(_request_blocks(
            "n", "blocks", "per_draw", "before", F.lit(seed), "draw", "draws", "first", "count", F.lit(part))).alias("q")).select(
        "strategy", "fold", "draw", "q.*")


def bootstrap_fold_sums(trades: DataFrame, draws: int = K.BOOTSTRAP_DRAWS, seed: int = K.BOOTSTRAP_SEED,
                        chunk: int = 4096, part: int = PART, draw_chunk: int = 25, whole: int | None = None) -> DataFrame:
    """Resampled profit per (strategy, draw, fold).

    The block sums of a fold of up to ``whole`` trades (``WHOLE``, or one part of another size) are shuffled once, as
    arrays, to a task that draws all its picks, ``chunk`` blocks of ``draw_chunk`` draws at a time: two doubles a trade
    are held and shuffled, whatever the number of draws.  Those of a larger fold are cut into parts of ``part``
    positions; a job asks each part for its picks there and the part answers with a sum per draw.  Parts are dealt to
    chunks of draws, so none is asked by all jobs.
    """
    whole = whole if whole is not None else WHOLE if part == PART else part
    placed = placed_trades(trades)
    held = packed(block_sums(placed.where(F.col("n") <= whole)), ["strategy", "fold"], ["full_sum", "last_sum"]).join(
        F.broadcast(bootstrap_shape(trades).withColumnRenamed("n", "_n")), ["strategy", "fold"]).groupBy("strategy", "fold").applyInArrow(
        _drawn_sums(draws, seed, chunk, draw_chunk), "strategy string, fold string, draw bigint, fold_sum double")
    return held.unionByName(_asked_fold_sums(trades, placed.where(F.col("n") > whole), draws, seed, chunk, part, draw_chunk, whole))


def _asked_fold_sums(trades: DataFrame, placed: DataFrame, draws: int, seed: int, chunk: int, part: int, draw_chunk: int,
                     whole: int) -> DataFrame:
    """``bootstrap_fold_sums`` of the folds of more than ``whole`` trades."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "full_sum", "last_sum")))
    parts = block_sums(placed).withColumn("part", F.floor(F.col("pos") / part)).groupBy("strategy", "fold", "part", "n").agg(
        ordered.alias("rows")).select(
        "strategy", "fold", "part", F.col("n").alias("_n"), F.transform("rows", lambda x: x["full_sum"]).alias("full"),
        F.transform("rows", lambda x: x["last_sum"]).alias("last"))
    jobs = bootstrap_jobs(trades, draws, chunk, draw_chunk)
    starts = F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(draw_chunk)))
    dealt = parts.withColumn("draw", starts).withColumn(
        "short", F.explode(F.array(F.lit(False), F.lit(True)))).select(
        "strategy", "fold", "part", "draw", "short", F.when(F.col("short"), F.col("last")).otherwise(F.col("full")).alias("values"))
    gathered = block_requests(jobs.where(F.col("n") > whole), seed, part).join(
        dealt.hint("merge"), ["strategy", "fold", "part", "draw", "short"]).select(
        "strategy", "fold", "draw", _answer_sums("values", "at", "per_draw").alias("s"))
    drawn = gathered.select("strategy", "fold", "draw", F.posexplode("s").alias("_i", "s"))
    return drawn.groupBy("strategy", (F.col("draw") + F.col("_i")).alias("draw"), "fold").agg(F.sum("s").alias("fold_sum"))


def block_bootstrap(trades: DataFrame, draws: int = K.BOOTSTRAP_DRAWS, quantile: float = K.BOOTSTRAP_QUANTILE,
                    declared: DataFrame | None = None) -> DataFrame:
    """The 90% point (sorted[floor(.9 draws)]) of the resampled median fold profit per strategy.

    ``declared`` (strategy, fold) adds each strategy's own folds without trades, which count as zero.
    """
    sums = bootstrap_fold_sums(trades, draws)
    if declared is not None:
        traded = trades.select("strategy", "fold").distinct()
        empty = declared.select("strategy", "fold").distinct().join(traded, ["strategy", "fold"], "left_anti").join(
            trades.select("strategy").distinct(), "strategy", "left_semi")
        sums = sums.unionByName(empty.select(
            "strategy", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"), "fold",
            F.lit(0.0).alias("fold_sum")))
    medians = sums.groupBy("strategy", "draw").agg(F.median("fold_sum").alias("median_profit"))
    rank = F.row_number().over(Window.partitionBy("strategy").orderBy("median_profit", "draw"))
    at = min(draws - 1, int(quantile * draws)) + 1
    return medians.withColumn("_rank", rank).where(F.col("_rank") == at).select(
        "strategy", F.col("median_profit").alias("q90"))


def fold_medians(trades: DataFrame, declared: DataFrame) -> DataFrame:
    """Median fold profit over declared and traded folds; a declared fold without trades counts as zero."""
    sums = trades.groupBy("strategy", "fold").agg(F.sum("profit").alias("p"), F.count(F.lit(1)).alias("n"))
    rows = declared.select("strategy", "fold").distinct().join(sums, ["strategy", "fold"], "full")
    return rows.groupBy("strategy").agg(F.median(F.coalesce("p", F.lit(0.0))).alias("median_profit"),
                                        F.coalesce(F.sum("n"), F.lit(0)).alias("trades"))


def significance_gate(trades: DataFrame, pairs: DataFrame, declared: DataFrame, draws: int = K.BOOTSTRAP_DRAWS) -> DataFrame:
    """Does each candidate beat its incumbent's noise band?  ``pairs`` is (candidate, incumbent).

    ``declared`` (strategy, fold, start, end) are the evaluation ranges a strategy was run over.  The gate is
    waived (passes) only when the two lists of ranges differ or one is missing, or when the candidate has no
    trades; a fold without trades counts as zero in medians and band.  Incumbents with fewer than eight trades
    get a point comparison marked inconclusive.  Only incumbents are resampled.
    """
    text = F.concat_ws(":", F.col("start").cast("string"), F.col("end").cast("string"))
    ranges = declared.groupBy("strategy").agg(
        F.transform(F.array_sort(F.collect_set(F.struct("start", text.alias("range")))), lambda r: r["range"]).alias("ranges"))
    wanted = trades.join(pairs.select(F.col("incumbent").alias("strategy")).distinct(), "strategy", "left_semi")
    known = fold_medians(trades, declared).join(ranges, "strategy", "left").join(
        block_bootstrap(wanted, draws, declared=declared), "strategy", "left")
    side = lambda name: known.select(
        F.col("strategy").alias(name), F.col("median_profit").alias(f"{name}_median"),
        F.col("trades").alias(f"_{name}_trades"), F.col("ranges").alias(f"_{name}_ranges"), F.col("q90").alias(f"_{name}_q90"))
    joined = pairs.join(side("candidate"), "candidate", "left").join(side("incumbent"), "incumbent", "left")
    same = F.col("_candidate_ranges") == F.col("_incumbent_ranges")
    traded = F.coalesce("_candidate_trades", F.lit(0)) > 0
    waived = ~(F.coalesce(same, F.lit(False)) & traded)
    thin = F.coalesce("_incumbent_trades", F.lit(0)) < K.MIN_INCUMBENT_TRADES
    bar = F.when(thin, F.col("incumbent_median")).otherwise(F.col("_incumbent_q90"))
    return joined.select(
        "candidate", "incumbent", "candidate_median", "incumbent_median", bar.alias("incumbent_q90"),
        (~waived & thin).alias("inconclusive"), waived.alias("waived"),
        (waived | F.coalesce(F.col("candidate_median") > bar, F.lit(False))).alias("passed"))


# ---- correlation intervals --------------------------------------------------------
def _pearson_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlation of each row pair, NaN where a row is constant; sums run left to right."""
    total = lambda x: np.add.accumulate(x, axis=1)[:, -1]
    n = a.shape[1]
    da, db = a - (total(a) / n)[:, None], b - (total(b) / n)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        return total(da * db) / np.sqrt(total(da * da) * total(db * db))


INTERVAL = T.StructType([T.StructField("lower", T.DoubleType()), T.StructField("upper", T.DoubleType()),
                         T.StructField("resamples", T.IntegerType())])


@F.pandas_udf(INTERVAL)
def _correlation_interval(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    rows = []
    for x, y in zip(a, b):
        x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
        n = len(x)
        picks = (uniform_block(K.CORRELATION_SEED, 0, K.CORRELATION_RESAMPLES * n) * n).astype(np.int64).reshape(-1, n)
        r = _pearson_rows(x[picks], y[picks])
        r = r[np.isfinite(r)]
        if len(r) == 0:
            rows.append((None, None, 0))
        else:
            low, high = np.quantile(r, [K.CORRELATION_ALPHA / 2, 1 - K.CORRELATION_ALPHA / 2])
            rows.append((float(low), float(high), len(r)))
    return pd.DataFrame(rows, columns=["lower", "upper", "resamples"])


def correlation_ci(correlated: DataFrame) -> DataFrame:
    """95% percentile interval of each pair's fold correlation (a, b, r, a_scores, b_scores).

    A pair is one row with two short vectors, so 2,000 resamples are one vector computation in its
    task: no row per resample is shuffled.  Pairs without a correlation have no interval.
    """
    known = F.col("r").isNotNull()
    fine = correlated.where(known).withColumn("_ci", _correlation_interval("a_scores", "b_scores")).select(
        *correlated.columns, "_ci.*")
    return fine.unionByName(correlated.where(~known).select(
        *correlated.columns, F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"),
        F.lit(0).alias("resamples")))


SURE = T.StructType([T.StructField("sure", T.BooleanType()), T.StructField("drawn", T.IntegerType())])


def surely_correlated(correlated: DataFrame, floor: float, step: int = 100) -> DataFrame:
    """Whether the lower end of each pair's interval reaches ``floor`` (column ``sure``), and the resamples that took (``drawn``).

    The lower end is at most the order statistic after its place.  So once more resamples than that place allows are
    below ``floor``, of however many finite ones the rest may have, the answer is no; else all are drawn and the end is exact.
    """
    limit = math.ceil(K.CORRELATION_ALPHA / 2 * (K.CORRELATION_RESAMPLES - 1)) + 1

    @F.pandas_udf(SURE)
    def judge(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows, picks = [], {}
        for x, y in zip(a, b):
            x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
            n = len(x)
            if n not in picks:  # the same draws for every pair with so many folds
                picks[n] = (uniform_block(K.CORRELATION_SEED, 0, K.CORRELATION_RESAMPLES * n) * n).astype(np.int64).reshape(-1, n)
            found, at, below = [], 0, 0
            while at < K.CORRELATION_RESAMPLES and below < limit:
                some = picks[n][at:at + step]
                r = _pearson_rows(x[some], y[some])
                found.append(r[np.isfinite(r)])
                below += int((found[-1] < floor).sum())
                at += len(some)
            r = np.concatenate(found)
            sure = below < limit and len(r) > 0 and np.quantile(r, K.CORRELATION_ALPHA / 2) >= floor
            rows.append((bool(sure), at))
        return pd.DataFrame(rows, columns=["sure", "drawn"])

    return correlated.where(F.col("r").isNotNull()).withColumn("_s", judge("a_scores", "b_scores")).select(*correlated.columns, "_s.*")


# ---- perturbed prices -------------------------------------------------------------
def numbered_symbols(seq_bars: DataFrame) -> DataFrame:
    """Bars with the number of their symbol by name, from 0 (``_symbol_no``)."""
    numbers = ordered_positions(seq_bars.select("symbol").distinct(), [], ["symbol"], position="_symbol_no").select(
        "symbol", "_symbol_no")
    return seq_bars.join(numbers, "symbol")


def perturb_prices(seq_bars: DataFrame, seed: Column, amplitude: float = K.PERTURB_AMPLITUDE) -> DataFrame:
    """Every bar scaled by 1 + (2u - 1) * amplitude; symbols numbered by name (unless they are), draws by position."""
    numbered = seq_bars if "_symbol_no" in seq_bars.columns else numbered_symbols(seq_bars)
    stream = seed.cast("bigint") * 100_003 + F.col("_symbol_no") * 1009 + 17
    factor = 1 + (F.col("_u") * 2 - 1) * F.lit(amplitude)
    prices = ("open", "high", "low", "close")
    others = [name for name in seq_bars.columns if name not in (*prices, "_symbol_no")]
    drawn = with_uniform(numbered, stream, F.col("seq") - 1, "_u")
    return drawn.withColumn("_factor", factor).select(
        *others, *[(F.col(name) * F.col("_factor")).alias(name) for name in prices])


def plateau_replicas(seq_bars: DataFrame, replicas: int, outcomes: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run ``outcomes`` on perturbed copies of the bars at once; adds ``replica`` to its rows.

    Copies are branches of one plan that differ in their draws only, and symbols keep their names: all branches read the shuffle
    that brought the bars together by symbol, and no copy is shuffled for windows over a symbol.
    """
    numbered = numbered_symbols(seq_bars)
    return functools.reduce(DataFrame.unionByName, [
        outcomes(perturb_prices(numbered, F.lit(i))).withColumn("replica", F.lit(i)) for i in range(1, replicas + 1)])


# ---- parameter points -------------------------------------------------------------
def parameter_grid(spark: SparkSession, parameters: dict[str, list], budget: int | None = None) -> DataFrame:
    """Cartesian product of the values in order.  A product above the search ``budget`` is refused, never cut.

    Point ``i`` is decoded from its number, digit by digit, so no product is built or sorted.
    """
    total = 1
    for values in parameters.values():
        total *= len(values)
    if budget is not None and total > budget:
        raise ValueError(f"{total} parameter points exceed the search budget of {budget}")
    points = spark.range(total).select(F.col("id").alias("point"))
    size = total
    for name, values in parameters.items():
        size //= len(values)
        digit = F.floor(F.col("point") / size) % len(values)
        points = points.withColumn(name, F.element_at(F.array(*[F.lit(v) for v in values]), (digit + 1).cast("int")))
    return points
