"""One evaluation from raw bars to a promotion decision, for all strategies at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numbers import cents
from ..operators import bars as B
from ..operators import features, folds, outcomes, risk, scoring
from ..session import written


def adjusted_bars(bars: DataFrame) -> DataFrame:
    """What rules and outcomes see: candles scaled to the adjusted close, so a split is no move of the price."""
    return B.adjust_prices(bars).withColumn("adj_close", F.col("close"))


def evaluate(bars: DataFrame, fold_table: DataFrame, rules: Callable[[DataFrame], DataFrame], initial: float = K.INITIAL_CAPITAL) -> DataFrame:
    """A row per strategy: summary of its walk-forward trades, the five gates and the decision.

    ``rules`` turns adjusted bars into proposals.  Trades are closed signals of adjusted bars, placed in the fold of their
    exit; one outside every fold is an error.  Closed trades are written once, since every score reads them.
    """
    adjusted = adjusted_bars(bars)
    closed = outcomes.trade_outcomes(features.bar_seq(adjusted), rules(adjusted))
    trades = written(folds.assign_fold(closed, fold_table, "exit_date", strict=True), "evaluated")
    equity = outcomes.equity_curve(trades, initial).select("strategy", "bar_date", cents(F.col("equity")).alias("capital"))
    keys = ["strategy", "fold"]
    by_fold = outcomes.equity_curve(trades, initial, keys).select(*keys, "bar_date", cents(F.col("equity")).alias("capital"))
    drawdowns = risk.drawdown_score(by_fold, initial, keys).select(*keys, "drawdown_pct")
    fold_scores = trades.groupBy(*keys).agg(F.round(F.sum("profit"), 6).alias("score"))
    results = fold_scores.withColumn("profit", F.col("score")).join(drawdowns, keys)
    periods = folds.period_profits(equity, fold_table, initial)
    scores = scoring.profile_score(trades, equity)
    full = scores.join(risk.drawdown_score(equity, initial), "strategy").select("strategy", "earned_profit", "drawdown_pct")
    decided = scoring.promotion_decision(periods, drawdowns, full, scoring.fold_trade_counts(trades, fold_table))
    return scoring.evaluation_summary(trades, results, periods, scores).join(decided, "strategy")
