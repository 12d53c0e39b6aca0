"""Profile scores, their factors, fold gates and the promotion decision.

Trade tables may put a third of their rows on one strategy: totals are plain aggregations (combined
before the shuffle) and ranks come from range-partitioned positions.  Equity tables hold at most one
row per strategy and calendar day, so windows over one strategy's equity are bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numbers import clamp, fixed, ratio
from ..functions.ordering import ordered_positions, with_halo

STRATEGY = ["strategy"]


# ---- profile score and factors ----------------------------------------------------
def profile_score(trades: DataFrame, equity: DataFrame, initial: float = K.INITIAL_CAPITAL) -> DataFrame:
    """Final capital, earned profit (the score), trades and win rate per strategy."""
    last = equity.groupBy("strategy").agg(F.max_by("capital", "bar_date").alias("final_capital"))
    counts = trades.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(F.col("profit") > 0).alias("wins"))
    joined = last.join(counts, "strategy", "full")
    final = F.coalesce("final_capital", F.lit(float(initial)))
    n = F.coalesce("trades", F.lit(0))
    return joined.select(
        "strategy", final.alias("final_capital"), (final - initial).alias("earned_profit"),
        (final - initial).alias("score"), n.alias("trades"),
        F.coalesce(F.try_divide(F.lit(100.0) * F.col("wins"), n), F.lit(0.0)).alias("win_rate"))


def profit_ranks(trades: DataFrame) -> DataFrame:
    """Trades with their exact 0-based position by profit inside the strategy."""
    return ordered_positions(trades.select("strategy", "profit"), STRATEGY, ["profit"])


def concentration_factor(trades: DataFrame, scores: DataFrame, trim: float = K.TRADE_TRIM_SHARE) -> DataFrame:
    """Profit kept when the best trades are capped at the upper-median winner, over earned profit."""
    ranks = profit_ranks(trades)
    sizes = ranks.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("profit") > 0).alias("_w"))
    middle = ranks.join(sizes, "strategy").where(
        (F.col("_w") > 0) & (F.col("pos") == F.col("_n") - F.col("_w") + F.floor(F.col("_w") / 2))
    ).select("strategy", F.col("profit").alias("_cap"))
    top = F.col("pos") >= F.col("group_rows") - F.floor(F.col("group_rows") * F.lit(trim))
    kept = ranks.join(middle, "strategy", "left").groupBy("strategy").agg(F.sum(
        F.when(top, F.least(F.col("profit"), F.coalesce("_cap", F.lit(0.0)))).otherwise(F.col("profit"))).alias("_kept"))
    factor = F.when((F.col("earned_profit") > 0) & F.col("_kept").isNotNull(), clamp(
        F.try_divide("_kept", "earned_profit"), 0.0, 1.0)).otherwise(F.lit(1.0))
    return scores.join(kept, "strategy", "left").select("strategy", factor.alias("concentration_factor"))


def symbol_factor(trades: DataFrame, scores: DataFrame) -> DataFrame:
    """Profit without the best symbol, over profit."""
    best = trades.groupBy("strategy", "symbol").agg(F.sum("profit").alias("_p")).groupBy("strategy").agg(
        F.max("_p").alias("_best"))
    earned = F.col("earned_profit")
    rest = earned - F.greatest(F.lit(0.0), F.coalesce("_best", F.lit(0.0)))
    return scores.join(best, "strategy", "left").select("strategy", F.when(earned > 0, clamp(
        F.try_divide(rest, earned), K.SYMBOL_FACTOR_FLOOR, 1.0)).otherwise(F.lit(1.0)).alias("symbol_factor"))


def top_trade_share(trades: DataFrame, top: int = 3) -> DataFrame:
    """Share of gross wins carried by the three best trades, in percent.

    The rank filter becomes a window group limit: each task keeps ``top`` rows before the shuffle.
    """
    wins = trades.where(F.col("profit") > 0).select("strategy", "profit")
    rank = F.row_number().over(Window.partitionBy("strategy").orderBy(F.desc("profit")))
    best = wins.withColumn("_rank", rank).where(F.col("_rank") <= top).groupBy("strategy").agg(
        F.sum("profit").alias("_top"))
    gross = trades.groupBy("strategy").agg(F.sum(F.greatest(F.col("profit"), F.lit(0.0))).alias("_gross"))
    return gross.join(best, "strategy", "left").select(
        "strategy", F.coalesce(F.try_divide(F.lit(100.0) * F.col("_top"), F.col("_gross")), F.lit(0.0))
        .alias("top_trade_share_pct"))


def quarter_rate(trades: DataFrame) -> DataFrame:
    """Share of traded quarters (by exit) with a profit."""
    quarters = trades.groupBy("strategy", F.year("exit_date").alias("y"), F.quarter("exit_date").alias("q")).agg(
        F.sum("profit").alias("p"))
    return quarters.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("quarters"),
        (F.count_if(F.col("p") > 0) / F.count(F.lit(1))).alias("profitable_quarter_rate"))


def time_windows(equity: DataFrame, initial: float = K.INITIAL_CAPITAL, parts: int = K.TIME_WINDOWS) -> DataFrame:
    """Chained returns of six equal segments of the equity path (needs twice as many points)."""
    path = Window.partitionBy("strategy").orderBy("bar_date")
    numbered = equity.withColumn("_i", F.row_number().over(path)).withColumn(
        "_n", F.count(F.lit(1)).over(Window.partitionBy("strategy")))
    # Point number floor(n * w / parts), w = 1..parts, ends segment w.
    ends = numbered.where(F.col("_n") >= 2 * parts).withColumn(
        "w", F.ceil(F.col("_i") * parts / F.col("_n"))).where(F.floor(F.col("_n") * F.col("w") / parts) == F.col("_i"))
    before = F.coalesce(F.lag("capital").over(path), F.lit(float(initial)))
    return ends.select("strategy", (F.col("w") - 1).alias("segment"), F.when(
        before > 0, F.try_divide("capital", before) - 1).otherwise(F.lit(0.0)).alias("segment_return"))


def time_factors(windows: DataFrame) -> DataFrame:
    """Spread of gains over the segments, weight of recent ones, and their clamped product."""
    r, gain = F.col("segment_return"), F.greatest(F.lit(0.0), F.col("segment_return"))
    weight = F.pow(F.lit(K.RECENCY_DECAY), K.TIME_WINDOWS - 1 - F.col("segment"))
    sums = windows.groupBy("strategy").agg(
        F.sum(gain).alias("g"), F.sum(gain * gain).alias("g2"), F.sum(r * weight).alias("rw"),
        F.sum(weight).alias("w"), F.avg(r).alias("m"))
    effective = F.try_divide(F.col("g") * F.col("g"), F.col("g2"))
    contribution = F.when(F.col("g") > 0, F.lit(K.TIME_FACTOR_FLOOR) + F.lit(1 - K.TIME_FACTOR_FLOOR) * (
        effective / K.TIME_WINDOWS)).otherwise(F.lit(1.0))
    recency = F.when(F.col("m") > 0, clamp((1 + F.col("rw") / F.col("w")) / (1 + F.col("m")), *K.RECENCY_RANGE)
                     ).otherwise(F.lit(1.0))
    return sums.select("strategy", contribution.alias("time_contribution_factor"), recency.alias("recency_factor"),
                       clamp(contribution * recency, K.TIME_FACTOR_FLOOR, K.RECENCY_RANGE[1]).alias("time_factor"))


def combine_profiles(profile_scores: DataFrame) -> DataFrame:
    """Weighted mean of the profile scores (2 conservative, 3 moderate, 1 aggressive) and all failures."""
    weight = F.lit(0)
    for name, value in K.PROFILE_WEIGHTS.items():
        weight = F.when(F.col("profile") == name, F.lit(value)).otherwise(weight)
    prefixed = F.transform("failures", lambda f: F.concat(F.col("profile"), F.lit(":"), f))
    return profile_scores.groupBy("strategy").agg(
        (F.sum(weight * F.col("score")) / F.lit(float(sum(K.PROFILE_WEIGHTS.values())))).alias("score"),
        F.array_join(F.array_sort(F.flatten(F.collect_list(prefixed))), ",").alias("failures"))


# ---- eligibility ------------------------------------------------------------------
def eligibility(outcomes: DataFrame, order: list[str], keys: list[str] | None = None,
                value: str = "r_multiple") -> DataFrame:
    """May the next trade of the same kind be taken, given the 20 outcomes before it?

    Outcomes of one kind can be very many, so they are cut into blocks of exact positions, each with
    the 20 rows before it; the frame never spans more.
    """
    keys = keys or ["strategy", "side", "setup", "regime"]
    placed = ordered_positions(outcomes, keys, order)
    blocks = with_halo(placed, keys, "pos", K.PERFORMANCE_WINDOW)
    frame = Window.partitionBy(*keys, "_block").orderBy("pos").rowsBetween(-K.PERFORMANCE_WINDOW, -1)
    recent = blocks.withColumn("_last", F.collect_list(value).over(frame)).where("_own").drop("_block", "_own")
    n = F.size("_last")
    total = F.aggregate("_last", F.lit(0.0), lambda acc, x: acc + x)
    wins = F.size(F.filter("_last", lambda x: x > 0))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("peak"), F.lit(0.0).alias("dd"))

    def step(acc: Column, x: Column) -> Column:
        now = acc["sum"] + x
        peak = F.greatest(acc["peak"], now)
        return F.struct(now.alias("sum"), peak.alias("peak"), F.greatest(acc["dd"], peak - now).alias("dd"))

    rated = recent.withColumn("sample_size", n).withColumn(
        "expectancy_r", F.coalesce(F.try_divide(total, n), F.lit(0.0))).withColumn(
        "win_rate", F.coalesce(F.try_divide(wins.cast("double"), n), F.lit(0.0))).withColumn(
        "max_drawdown_r", F.aggregate("_last", start, step)["dd"])
    reason = (
        F.when(F.col("sample_size") < K.PERFORMANCE_MIN_SAMPLE, "warmup")
        .when(F.col("expectancy_r") <= 0, "negative-expectancy")
        .when(F.col("win_rate") < F.lit(K.PERFORMANCE_MIN_WIN_RATE), "low-win-rate")
        .when(F.col("max_drawdown_r") > F.lit(K.PERFORMANCE_MAX_DRAWDOWN_R), "drawdown")
        .otherwise("eligible"))
    return rated.withColumn("reason", reason).withColumn(
        "actionable", F.col("reason").isin("warmup", "eligible")).drop("_last", "group_rows")


# ---- fold gates -------------------------------------------------------------------
def positive_fold_gate(fold_returns: DataFrame, rate: float = K.MIN_POSITIVE_FOLD_RATE) -> DataFrame:
    """Enough folds with a strictly positive profit (strategy, fold, profit)."""
    sums = fold_returns.groupBy("strategy").agg(
        F.count_if(F.col("profit") > 0).alias("positive_folds"), F.count(F.lit(1)).alias("total_folds"))
    need = F.ceil(F.col("total_folds") * F.lit(float(rate)))
    return sums.select("strategy", "positive_folds", "total_folds", need.alias("minimum_positive_folds"),
                       (F.col("positive_folds") / F.col("total_folds")).alias("positive_fold_rate"),
                       (F.col("positive_folds") >= need).alias("passed"))


def fold_trade_counts(trades: DataFrame, folds: DataFrame) -> DataFrame:
    """Trades per strategy and declared fold, zeros included."""
    from .folds import fold_list

    counted = trades.groupBy("strategy", "fold").agg(F.count(F.lit(1)).alias("n"))
    cells = counted.select("strategy").distinct().join(F.broadcast(fold_list(folds))).select(
        "strategy", F.explode("folds").alias("f")).select("strategy", "f.fold")
    return cells.join(counted, ["strategy", "fold"], "left").select(
        "strategy", "fold", F.coalesce("n", F.lit(0)).alias("trades"))


def sample_adequacy_gate(counts: DataFrame) -> DataFrame:
    sums = counts.groupBy("strategy").agg(
        F.sum("trades").alias("total_trades"), F.count(F.lit(1)).alias("folds"),
        F.count_if(F.col("trades") == 0).alias("empty_folds"), F.min("trades").alias("min_fold_trades"))
    active = F.col("folds") - F.col("empty_folds")
    return sums.withColumn("passed", (F.col("total_trades") >= K.MIN_TOTAL_TRADES) & (
        active >= F.ceil(F.col("folds") / 2)))


def drawdown_gate(fold_drawdowns: DataFrame, ceiling: float = K.MAX_FOLD_DRAWDOWN_PCT) -> DataFrame:
    return fold_drawdowns.groupBy("strategy").agg(F.max("drawdown_pct").alias("max_fold_drawdown_pct")).withColumn(
        "passed", F.col("max_fold_drawdown_pct") <= F.lit(float(ceiling)))


def aggregate_folds(fold_results: DataFrame, rate: float = K.MIN_POSITIVE_FOLD_RATE) -> DataFrame:
    """Walk-forward summary of (strategy, fold, score, profit, drawdown_pct); a strategy has few folds."""
    sums = fold_results.groupBy("strategy").agg(
        F.median("score").alias("median_fold_score"), F.min("score").alias("worst_fold_score"),
        F.max("score").alias("best_fold_score"), F.count_if(F.col("score") < 0).alias("losing_folds"),
        F.count_if(F.col("profit") > 0).alias("positive_folds"), F.count(F.lit(1)).alias("folds"),
        F.max("drawdown_pct").alias("max_fold_drawdown_pct"))
    few = F.col("positive_folds") < F.ceil(F.col("folds") * F.lit(float(rate)))
    deep = F.col("max_fold_drawdown_pct") > F.lit(K.MAX_FOLD_DRAWDOWN_PCT)
    return sums.withColumn("gate_failures", F.array_join(F.array_compact(F.array(
        F.when(few, "minimum-positive-return-folds"), F.when(deep, "maximum-drawdown"))), ","))


def promotion_decision(period_profits: DataFrame, fold_drawdowns: DataFrame, full_period: DataFrame,
                       counts: DataFrame) -> DataFrame:
    """Five gates and their conjunction per strategy.

    ``full_period`` has (strategy, earned_profit, drawdown_pct).  Every input is one small row per
    strategy after its own aggregation.
    """
    gates = (
        positive_fold_gate(period_profits).select("strategy", F.col("passed").alias("positive_return_folds"))
        .join(drawdown_gate(fold_drawdowns).select("strategy", F.col("passed").alias("maximum_drawdown")), "strategy")
        .join(full_period.select(
            "strategy", (F.col("earned_profit") > 0).alias("full_period_return"),
            (F.col("drawdown_pct") <= F.lit(K.MAX_FOLD_DRAWDOWN_PCT)).alias("full_period_drawdown")), "strategy")
        .join(sample_adequacy_gate(counts).select("strategy", F.col("passed").alias("sample_adequacy")), "strategy"))
    return gates.withColumn("promotable", F.expr(
        "positive_return_folds AND maximum_drawdown AND full_period_return AND full_period_drawdown AND sample_adequacy"))


def evaluation_summary(trades: DataFrame, fold_results: DataFrame, period_profits: DataFrame,
                       scores: DataFrame) -> DataFrame:
    """The secondary metrics of an evaluation, rounded for reports."""
    folds = aggregate_folds(fold_results)
    gate = positive_fold_gate(period_profits)
    totals = trades.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("total_trades"), F.sum("profit").alias("p"), F.count_if(F.col("profit") > 0).alias("w"))
    return scores.select("strategy", "score").join(folds.drop("positive_folds", "folds"), "strategy").join(
        gate.select("strategy", "positive_folds", "positive_fold_rate"), "strategy").join(totals, "strategy").select(
        "strategy", fixed(F.col("score")).alias("net_profit"), fixed(F.col("median_fold_score")).alias("median_fold_score"),
        "positive_folds", fixed(100 * F.col("positive_fold_rate")).alias("positive_fold_rate_pct"),
        fixed(F.col("max_fold_drawdown_pct")).alias("max_fold_drawdown_pct"), "losing_folds",
        fixed(F.col("worst_fold_score")).alias("worst_fold_score"), fixed(F.col("best_fold_score")).alias("best_fold_score"),
        "total_trades", fixed(ratio(100.0 * F.col("w"), F.col("total_trades"), 0.0)).alias("win_rate_pct"),
        fixed(F.col("p")).alias("total_profit"))


def strategy_attribution(trades: DataFrame) -> DataFrame:
    return trades.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("trades"), F.sum("profit").alias("profit"), F.count_if(F.col("profit") > 0).alias("wins"))
