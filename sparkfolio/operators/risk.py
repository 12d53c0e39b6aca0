"""Drawdown, Sortino, ruin bootstrap and the choice of a risk rate."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.numbers import c_exp, c_log, cents, fixed
from ..functions.ordering import ordered_positions, packed, unpacked
from ..functions.random import uniform_at, with_draw


PART = 262_144  # positions of a part that is asked for picks
WHOLE = 33_554_432  # positions of a pool that one task may hold


def _underwater(equity: DataFrame, initial: float, keys: list[str]) -> DataFrame:
    """Equity (one row per key and day) with amount and percent below the running peak."""
    so_far = Window.partitionBy(*keys).orderBy("bar_date").rowsBetween(Window.unboundedPreceding, 0)
    peak = F.greatest(F.lit(float(initial)), F.max("capital").over(so_far))
    return equity.withColumn("peak", peak).withColumn("drawdown", F.col("peak") - F.col("capital")).withColumn(
        "drawdown_pct", F.when(F.col("peak") > 0, F.try_divide(F.lit(100.0) * F.col("drawdown"), F.col("peak")))
        .otherwise(F.lit(0.0)))


def drawdown_engine(equity: DataFrame, initial: float = K.INITIAL_CAPITAL, keys: list[str] | None = None) -> DataFrame:
    """Largest amount below the peak, and the percent at that (first) point."""
    keys = keys or ["strategy"]
    first_largest = F.struct("drawdown", -F.unix_date("bar_date"))
    return _underwater(equity, initial, keys).groupBy(*keys).agg(
        F.max("drawdown").alias("d"), F.max_by("drawdown_pct", first_largest).alias("p")).select(
        *keys, cents(F.col("d")).alias("max_drawdown"), cents(F.col("p")).alias("max_drawdown_pct"))


def drawdown_score(equity: DataFrame, initial: float = K.INITIAL_CAPITAL, keys: list[str] | None = None) -> DataFrame:
    """Largest amount and largest percent below the peak, each on its own."""
    keys = keys or ["strategy"]
    return _underwater(equity, initial, keys).groupBy(*keys).agg(
        F.max("drawdown").alias("max_drawdown"), F.max("drawdown_pct").alias("drawdown_pct"))


def daily_returns(equity: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["strategy"]
    previous = F.lag("capital").over(Window.partitionBy(*keys).orderBy("bar_date"))
    return equity.withColumn("_previous", previous).where(F.col("_previous") > 0).select(
        *keys, "bar_date", ((F.col("capital") - F.col("_previous")) / F.col("_previous")).alias("daily_return"))


def sortino(returns: DataFrame, hurdle_rate: float = K.HURDLE_RATE, keys: list[str] | None = None) -> DataFrame:
    """Annualised excess return over annualised downside deviation; 0 without any downside."""
    keys = keys or ["strategy"]
    hurdle = F.lit(hurdle_rate / 100 / K.SESSIONS_PER_YEAR)
    short = F.least(F.lit(0.0), F.col("daily_return") - hurdle)
    sums = returns.groupBy(*keys).agg(
        F.avg("daily_return").alias("m"), F.sum(short * short).alias("s"), F.count(F.lit(1)).alias("n"))
    excess = (F.col("m") - hurdle) * K.SESSIONS_PER_YEAR
    downside = F.sqrt(F.col("s") / F.col("n")) * F.sqrt(F.lit(float(K.SESSIONS_PER_YEAR)))
    return sums.select(*keys, F.coalesce(F.try_divide(excess, downside), F.lit(0.0)).alias("sortino"))


# ---- ruin -------------------------------------------------------------------------
def r_pool(trades: DataFrame, order: list[str], value: str = "r_multiple") -> DataFrame:
    """R multiples with their exact position in the strategy's trade order."""
    return ordered_positions(trades.select("strategy", *order, F.col(value).alias("r")), ["strategy"], order).select(
        "strategy", "pos", "group_rows", "r")


def ruin_seeds(pool: DataFrame, rates: list[float]) -> DataFrame:
    """Seed per (strategy, rate) from the order-weighted R multiples, in exact integers."""
    millionths = F.floor(F.col("r") * F.lit(1e6) + F.lit(0.5)).cast("decimal(18,0)")
    totals = pool.groupBy("strategy").agg(
        F.sum(millionths * (F.col("pos") + 1).cast("decimal(18,0)")).alias("t"), F.max("group_rows").alias("n"))
    low = F.pmod(F.abs("t"), F.lit(4294967296).cast("decimal(10,0)")).cast("bigint")
    rate = F.explode(F.array(*[F.lit(float(r)) for r in rates]))
    mixed = F.col("low").bitwiseXOR(F.round(F.col("rate") * F.lit(1e6)).cast("bigint"))
    return totals.select("strategy", "n", low.alias("low"), rate.alias("rate")).select(
        "strategy", "n", "rate", F.when(mixed == 0, F.lit(42)).otherwise(mixed).cast("bigint").alias("seed"))


REQUESTS = T.ArrayType(T.StructType([T.StructField("part", T.LongType()), T.StructField("place", T.ArrayType(T.IntegerType())),
                                     T.StructField("at", T.ArrayType(T.IntegerType()))]))
WALKED = "strategy string, rate double, path int, final double, max_drawdown double"
RUN = ("s", "c", "low_s", "low", "high_s", "high", "dd")
RUNS = T.ArrayType(T.StructType([T.StructField("path", T.LongType()), *[T.StructField(name, T.DoubleType()) for name in RUN]]))


def _picks(seed: int, n: int, first: int, last: int, begin: int, end: int) -> np.ndarray:
    """Positions that steps begin..end-1 of paths first..last draw from a pool of n, a row per path."""
    k = np.arange(first, last + 1, dtype=np.uint64)[:, None] * np.uint64(n) + np.arange(begin, end, dtype=np.uint64)
    return (uniform_at(int(seed), k) * n).astype(np.int64)


def _walk(r: np.ndarray, risk: float) -> dict[str, np.ndarray]:
    """Compound runs of steps (a row per path) from capital 1: its end, lowest and highest after a step, and drawdown.

    Capital is a sign and the logarithm of its size, since long paths leave the range of doubles.
    """
    growth = 1 + risk * r
    size, sign = np.abs(growth), np.cumprod(np.sign(growth), axis=1)
    log = np.cumsum(np.log(size, out=np.zeros_like(size), where=size > 0), axis=1)

    def furthest(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sign and logarithm of the largest among ``positive``, else 0 if it occurs, else what is nearest to 0."""
        found, lost = positive.any(axis=1), (sign == 0).any(axis=1)
        most, least = np.where(positive, log, -np.inf).max(axis=1), np.where(sign != 0, log, np.inf).min(axis=1)
        return np.where(found, 1.0, np.where(lost, 0.0, -1.0)), np.where(found, most, np.where(lost, -np.inf, least))

    high_s, high = furthest(sign > 0)
    low_s, low = furthest(sign < 0)
    peak = np.maximum(np.maximum.accumulate(np.where(sign > 0, log, -np.inf), axis=1), 0.0)
    with np.errstate(over="ignore"):
        dd = np.maximum(0.0, (1 - sign * np.exp(log - peak)).max(axis=1))
    end = sign[:, -1]
    return {"s": end, "c": np.where(end != 0, log[:, -1], -np.inf), "low_s": -low_s, "low": low, "high_s": high_s, "high": high, "dd": dd}


def _walk_pool(paths: int, path_chunk: int, step_chunk: int):
    """Some paths of each rate over a pool that one task holds, run by run, each run chained to those before."""

    def run(table: pa.Table) -> pa.Table:
        n, lo, seeds = table["group_rows"][0].as_py(), table["first"][0].as_py(), table["seeds"][0].as_py()
        r, hi, out = unpacked(table, "r", n), min(lo + path_chunk, paths) - 1, []
        for one in seeds:
            s, c, top, dd = np.ones(hi - lo + 1), *np.zeros((3, hi - lo + 1))
            for begin in range(0, n, step_chunk):
                w = _walk(r[_picks(one["seed"], n, lo, hi, begin, min(begin + step_chunk, n))], one["rate"])
                lowest_s, lowest = np.where(s < 0, -w["high_s"], w["low_s"]) * np.abs(s), np.where(s < 0, w["high"], w["low"]) + c
                highest_s, highest = np.where(s < 0, -w["low_s"], w["high_s"]) * np.abs(s), np.where(s < 0, w["low"], w["high"]) + c
                with np.errstate(over="ignore"):
                    dd = np.maximum(np.maximum(dd, np.where(s > 0, w["dd"], 0.0)), 1 - lowest_s * np.exp(lowest - top))
                top, s, c = np.where(highest_s > 0, np.maximum(top, highest), top), s * w["s"], c + w["c"]
            with np.errstate(over="ignore"):
                final = s * np.exp(c)
            out.append(pa.table({"strategy": pa.array([table["strategy"][0].as_py()] * len(c), pa.string()), "rate": [one["rate"]] * len(c),
                                 "path": pa.array(range(lo, hi + 1), pa.int32()), "final": final, "max_drawdown": dd}))
        return pa.concat_tables(out)

    return run


@F.pandas_udf(REQUESTS)
def _request(seed: pd.Series, n: pd.Series, first: pd.Series, last: pd.Series, begin: pd.Series, end: pd.Series,
             chunk: pd.Series) -> pd.Series:
    """The picks of some paths' run by the part they lie in: position there, and place among the run's picks."""
    answers = []
    for s, size, lo, hi, a, b, many in zip(seed, n, first, last, begin, end, chunk):
        picks = _picks(s, size, lo, hi, a, b).ravel()
        part = picks // many
        place = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[place])) + 1
        answers.append([{"part": int(part[x[0]]), "place": x.astype(np.int32), "at": (picks[x] % many).astype(np.int32)}
                        for x in np.split(place, cuts)])
    return pd.Series(answers)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _answer(part: pd.Series, at: pd.Series) -> pd.Series:
    return pd.Series([np.asarray(r, dtype=float)[x] for r, x in zip(part, at)])


@F.pandas_udf(RUNS)
def _walk_answers(places: pd.Series, values: pd.Series, rate: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
    """Runs of some paths from the answers of all parts, put in order."""
    answers = []
    for place, value, risk, lo, hi in zip(places, values, rate, first, last):
        r = np.empty(sum(map(len, place)))
        r[np.concatenate(place)] = np.concatenate(value)
        w = _walk(r.reshape(hi - lo + 1, -1), risk)
        answers.append([{"path": lo + i, **{name: w[name][i] for name in RUN}} for i in range(hi - lo + 1)])
    return pd.Series(answers)


def ruin_jobs(pool: DataFrame, rates: list[float], paths: int, path_chunk: int, step_chunk: int) -> DataFrame:
    """Some paths' run of steps a row: (strategy, n, rate, seed, first, last, run, begin, end)."""
    begin = F.col("run") * step_chunk
    return ruin_seeds(pool, rates).withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(paths - 1), F.lit(path_chunk)))).withColumn(
        "last", F.least(F.col("first") + path_chunk - 1, F.lit(paths - 1))).withColumn(
        "run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / step_chunk)))).withColumn(
        "begin", begin).withColumn("end", F.least(begin + step_chunk, F.col("n")))


def ruin_requests(jobs: DataFrame, pool_chunk: int) -> DataFrame:
    """The picks of each job, drawn once: a row per job and part of the pool that they touch."""
    return jobs.repartition("strategy", "rate", "first", "run").select(
        "strategy", "rate", "first", "last", "run", F.explode(_request(
            "seed", "n", "first", "last", "begin", "end", F.lit(pool_chunk))).alias("q")).select(
        "strategy", "rate", "first", "last", "run", "q.*")


def ruin_paths(pool: DataFrame, rates: list[float], paths: int = K.RUIN_PATHS, path_chunk: int = 50,
               step_chunk: int = 8192, pool_chunk: int = PART, whole: int | None = None) -> DataFrame:
    """Final capital multiple and largest drawdown of every resampled path (strategy, rate, path).

    A path is walked in runs of ``step_chunk`` steps.  A pool of up to ``whole`` trades (``WHOLE``, or one part of another
    size) is shuffled as arrays to one task for each ``path_chunk`` paths, which walks them at every rate: a double a
    trade is held, and what is shuffled grows with the pool, not with the picks.  A larger pool is cut into parts of
    ``pool_chunk`` positions; picks are drawn once, by the job of some paths' run, which asks each part for its picks
    there, parts answer with values, and the answers are put in order.  Parts are dealt to the jobs of a rate and path
    chunk, so none is asked by all.  Runs are compounded and then chained, in logarithms; no path is held.  A final multiple
    beyond the doubles is infinite, its drawdown is not.
    """
    whole = whole if whole is not None else WHOLE if pool_chunk == PART else pool_chunk
    seeds = ruin_seeds(pool, rates).groupBy("strategy").agg(F.array_sort(F.collect_list(F.struct("rate", "seed"))).alias("seeds"))
    held = packed(pool.where(F.col("group_rows") <= whole), ["strategy", "group_rows"], ["r"]).join(
        F.broadcast(seeds), "strategy").withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(paths - 1), F.lit(path_chunk)))).groupBy(
        "strategy", "first").applyInArrow(_walk_pool(paths, path_chunk, step_chunk), WALKED)
    return held.unionByName(_asked_paths(pool, rates, paths, path_chunk, step_chunk, pool_chunk, whole))


def _asked_paths(pool: DataFrame, rates: list[float], paths: int, path_chunk: int, step_chunk: int, pool_chunk: int,
                 whole: int) -> DataFrame:
    """``ruin_paths`` of the pools of more than ``whole`` trades."""
    pool = pool.where(F.col("group_rows") > whole)
    jobs = ruin_jobs(pool, rates, paths, path_chunk, step_chunk)
    parts = pool.withColumn("part", F.floor(F.col("pos") / pool_chunk)).groupBy("strategy", "part", "group_rows").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "r"))), lambda p: p["r"]).alias("values"))
    dealt = parts.select(
        "strategy", "part", "values", F.explode(F.array(*[F.lit(float(r)) for r in rates])).alias("rate")).withColumn(
        "first", F.explode(F.sequence(F.lit(0), F.lit(paths - 1), F.lit(path_chunk))))
    key = ["strategy", "rate", "first", "last", "run"]
    answered = ruin_requests(jobs, pool_chunk).join(
        dealt.hint("merge"), ["strategy", "part", "rate", "first"]).select(*key, "place", _answer("values", "at").alias("value"))
    gathered = answered.groupBy(*key).agg(F.collect_list(F.struct("place", "value")).alias("a")).select(
        "strategy", "rate", "run", F.explode(_walk_answers("a.place", "a.value", "rate", "first", "last")).alias("w"))
    runs = gathered.groupBy("strategy", "rate", "w.path").agg(
        F.array_sort(F.collect_list(F.struct("run", "w"))).alias("runs"))
    start = F.struct(F.lit(1.0).alias("s"), F.lit(0.0).alias("c"), F.lit(0.0).alias("top"), F.lit(0.0).alias("dd"))

    def chain(acc: Column, run: Column) -> Column:
        w, flip, size = run["w"], acc["s"] < 0, F.abs(acc["s"])
        lowest_s, lowest = F.when(flip, -w["high_s"]).otherwise(w["low_s"]) * size, F.when(flip, w["high"]).otherwise(w["low"]) + acc["c"]
        highest_s, highest = F.when(flip, -w["low_s"]).otherwise(w["high_s"]) * size, F.when(flip, w["low"]).otherwise(w["high"]) + acc["c"]
        return F.struct((acc["s"] * w["s"]).alias("s"), (acc["c"] + w["c"]).alias("c"),
                        F.when(highest_s > 0, F.greatest(acc["top"], highest)).otherwise(acc["top"]).alias("top"),
                        F.greatest(acc["dd"], F.when(acc["s"] > 0, w["dd"]).otherwise(0.0), 1 - lowest_s * F.exp(lowest - acc["top"])).alias("dd"))

    return runs.select("strategy", "rate", "path", F.aggregate("runs", start, chain).alias("w")).select(
        "strategy", "rate", F.col("path").cast("int").alias("path"), (F.col("w.s") * F.exp("w.c")).alias("final"), F.col("w.dd").alias("max_drawdown"))


def ruin_bootstrap(walked: DataFrame, ruin_drawdown: float = K.RUIN_DRAWDOWN, quantile: float = K.RUIN_QUANTILE) -> DataFrame:
    """Share of ruined paths and the 95% drawdown (sorted[floor(.95 n)]) per strategy and rate."""
    order = Window.partitionBy("strategy", "rate").orderBy("max_drawdown", "path")
    ranked = walked.withColumn("_i", F.row_number().over(order) - 1).withColumn(
        "_n", F.count(F.lit(1)).over(Window.partitionBy("strategy", "rate")))
    at = F.col("_i") == F.floor(F.col("_n") * F.lit(quantile))
    return ranked.groupBy("strategy", "rate").agg(
        (F.count_if(F.col("max_drawdown") >= F.lit(ruin_drawdown)) / F.count(F.lit(1))).alias("ruin_probability"),
        F.max(F.when(at, F.col("max_drawdown"))).alias("drawdown95"))


def capital_envelope(pool: DataFrame, dates: DataFrame, walked: DataFrame, rates: list[float],
                     initial: float = K.INITIAL_CAPITAL) -> DataFrame:
    """The 5/50/95 percentile paths by final capital, point by point, dated by the trades' exits.

    Step s of a path is dated by exit s-1; step 0 by the first date.  Three paths per strategy and rate
    are walked again; points come from an equi join on the drawn position.  Running capital is a segmented scan: sums of
    logarithms, signs and zeros within runs of 4,096 steps, plus those of the runs before, so a long path is never held
    by one task and a loss beyond the capital stays a loss.
    """
    order = Window.partitionBy("strategy", "rate").orderBy("final", "path")
    ranked = walked.withColumn("_i", F.row_number().over(order) - 1).withColumn(
        "_n", F.count(F.lit(1)).over(Window.partitionBy("strategy", "rate")))
    wanted = [F.when(F.col("_i") == F.floor(F.col("_n") * F.lit(q)), F.lit(name))
              for name, q in (("p5", 0.05), ("p50", 0.50), ("p95", 0.95))]
    chosen = ranked.withColumn("band", F.explode(F.array_compact(F.array(*wanted)))).select(
        "strategy", "rate", "band", "path")
    n, block = F.col("n"), 4096
    runs = chosen.join(ruin_seeds(pool, rates), ["strategy", "rate"]).withColumn(
        "run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / block)))).repartition(
        "strategy", "rate", "band", "run")
    begin = F.col("run") * block
    steps = runs.withColumn("step", F.explode(F.sequence(begin, F.least(begin + block, n) - 1)))
    picks = with_draw(steps, F.col("seed"), F.col("path") * n + F.col("step"), n)
    key = ["strategy", "rate", "band"]
    grown = picks.join(pool.select("strategy", "pos", "r").hint("merge"), ["strategy", "pos"]).select(
        *key, "run", F.col("step").alias("at"), (1 + F.col("rate") * F.col("r")).alias("growth"))
    growth = F.col("growth")
    # Logarithms to 15 places as decimals: their sums are exact, whatever their order.  Scaled before rounding, as SQL engines do.
    scaled = F.round(c_log(F.when(growth != 0, F.abs(growth)).otherwise(1.0)) * F.lit(1e15)).cast("decimal(20,0)")
    parts = [(scaled * F.lit(Decimal("1e-15"))).cast("decimal(20,15)").alias("log"), (growth < 0).cast("bigint").alias("below"),
             (growth == 0).cast("bigint").alias("lost")]
    sums = ["log", "below", "lost"]
    so_far = Window.partitionBy(*key, "run").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    inside = grown.select(*key, "run", "at", *parts).select(*key, "run", "at", *[F.sum(x).over(so_far).alias(x) for x in sums])
    runs_before = Window.partitionBy(*key).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # a row per run
    before = grown.select(*key, "run", *parts).groupBy(*key, "run").agg(*[F.sum(x).alias(x) for x in sums]).select(
        *key, "run", *[F.coalesce(F.sum(x).over(runs_before), F.lit(0)).alias(f"_{x}") for x in sums])
    # Of 38 digits a sum would keep 14 places; by its text, since a decimal of up to 18 digits becomes a double in two roundings.
    log = F.col("log").cast("decimal(30,15)") + F.col("_log").cast("decimal(30,15)")
    size = c_exp(log.cast("string").cast("double"))
    multiple = F.when(F.col("lost") + F.col("_lost") > 0, 0.0).when((F.col("below") + F.col("_below")) % 2 == 1, -size).otherwise(size)
    points = inside.join(before, [*key, "run"]).select(
        *key, (F.col("at") + 1).alias("step"), (F.lit(float(initial)) * multiple).alias("capital"))
    opening = chosen.select(*key, F.lit(0).cast("bigint").alias("step"), F.lit(float(initial)).alias("capital"))
    dated = points.join(dates.select("strategy", (F.col("pos") + 1).alias("step"), F.col("exit_date").alias("bar_date")),
                        ["strategy", "step"])
    first_dates = dates.groupBy("strategy").agg(F.min("exit_date").alias("bar_date"))
    return dated.unionByName(opening.join(first_dates, "strategy")).select(
        *key, "step", "bar_date", cents(F.col("capital")).alias("capital"))


# ---- choice -----------------------------------------------------------------------
def choose_risk_rate(passes: DataFrame) -> DataFrame:
    """The rate each profile takes, from one table of passes (strategy, rate, sortino,
    ruin_probability, drawdown95, return_pct, max_drawdown_pct).

    Tier 1 keeps both ceilings, tier 2 the ruin ceiling only, tier 3 neither; the best tier present is
    used.  Each preference is an ascending struct key, so one ``min_by`` picks the winner.
    """
    profiles = F.explode(F.array(*[
        F.struct(F.lit(name).alias("profile"), F.lit(ruin).alias("ruin_cap"), F.lit(dd).alias("dd_cap"))
        for name, (ruin, dd) in K.RISK_CEILINGS.items()]))
    ruin_ok = F.col("ruin_probability") <= F.col("ruin_cap")
    tier = F.when(ruin_ok & (F.col("drawdown95") < F.col("dd_cap")), 1).when(ruin_ok, 2).otherwise(3)
    rows = passes.withColumn("c", profiles).select(*passes.columns, "c.*").withColumn("tier", tier)
    # A strategy has a handful of rates: this window is tiny.
    best = F.max("sortino").over(Window.partitionBy("strategy", "profile", "tier"))
    rows = rows.withColumn("best_sortino", best)
    zero, rate = F.lit(0.0), F.col("rate")
    is_a, is_m = F.col("profile") == "aggressive", F.col("profile") == "moderate"
    capped = F.col("tier") < 3
    beats = F.col("sortino") > 0
    near_best = F.col("sortino") >= F.col("best_sortino") - F.lit(K.SORTINO_TIE)
    preserve = ~is_a & ~is_m & capped & ~beats
    group = F.when(is_m & capped, F.when(near_best, zero).otherwise(F.lit(1.0))).when(
        preserve, F.lit(1.0)).otherwise(zero)
    gain = F.when((is_a & (F.col("tier") == 1)) | preserve, -F.col("return_pct")).otherwise(zero)
    loss = F.when(preserve, F.col("max_drawdown_pct")).otherwise(zero)
    tail = F.when(preserve, F.col("drawdown95")).otherwise(zero)
    key = F.struct("tier", group, gain, loss, tail, F.when(is_a, -rate).otherwise(rate))
    return rows.groupBy("strategy", "profile").agg(
        F.min_by(F.struct("rate", "tier", "sortino", "ruin_probability", "drawdown95", "return_pct"), key).alias("c")
    ).select("strategy", "profile", "c.*")


def risk_sensitivity(passes: DataFrame, chosen: DataFrame) -> DataFrame:
    """All rates per profile, rounded, with the recommended and disqualified flags."""
    caps = F.explode(F.array(*[
        F.struct(F.lit(name).alias("profile"), F.lit(ruin).alias("ruin_cap"), F.lit(dd).alias("dd_cap"))
        for name, (ruin, dd) in K.RISK_CEILINGS.items()]))
    rows = passes.withColumn("c", caps).select(*passes.columns, "c.*").join(
        chosen.select("strategy", "profile", F.col("rate").alias("chosen_rate")), ["strategy", "profile"])
    ruined = F.col("ruin_probability") > F.col("ruin_cap")
    return rows.select(
        "strategy", "profile", fixed(F.col("rate") * 100).alias("risk_pct"), fixed(F.col("return_pct")).alias("return_pct"),
        fixed(F.col("max_drawdown_pct")).alias("max_drawdown_pct"),
        fixed(F.col("ruin_probability") * 100).alias("ruin_probability_pct"),
        fixed(F.col("drawdown95") * 100).alias("drawdown95_pct"), fixed(F.col("sortino")).alias("sortino"),
        (F.col("rate") == F.col("chosen_rate")).alias("recommended"), ruined.alias("ruin_disqualified"),
        (~ruined & (F.col("drawdown95") >= F.col("dd_cap"))).alias("drawdown_disqualified"))
