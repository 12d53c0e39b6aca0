"""Example rules and the research flow over bars: features, proposals, outcomes, passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numbers import cents
from ..operators import features, outcomes, risk, signals

LONGEST_HOLD = 10  # what the rules below state at most
TRADE_ORDER = ["exit_date", "entry_date", "symbol", "seq"]


def featured(bars: DataFrame) -> DataFrame:
    """Bars with position, 20-bar mean and previous close: one shuffle on the symbol."""
    rows = features.rolling_mean(features.bar_seq(bars), 20, "mean20")
    return rows.withColumn("previous_close", F.lag("close").over(features.by_symbol()))


def _levels(name: str, side: str, confidence: Column) -> Column:
    close, day = F.col("close"), F.dayofmonth("bar_date")
    long = side == "long"
    target = close * F.lit(1.06 if long else 0.94)
    return signals.proposal(
        name, F.lit(side), close * F.lit(0.99), close * F.lit(1.01), close * F.lit(0.95 if long else 1.05),
        F.when(day % 5 != 0, target), 1 + F.col("seq") % 10,
        F.when(close < F.lit(0.95) * F.col("mean20"), "deep").otherwise("shallow"),
        F.when(F.col("volume") >= 30, "busy").otherwise("quiet"), confidence)


def example_rules() -> list[Column]:
    """Three rules: ``dip`` (also asks to leave on strength), ``deep`` and ``turn``."""
    close, mean = F.col("close"), F.col("mean20")
    percent = (30 + F.col("seq") % 60).cast("double")
    silent = F.when(F.col("seq") % 4 != 0, percent / 100)
    return [
        F.when(close < F.lit(0.97) * mean, _levels("dip", "long", percent)).when(
            close > F.lit(1.05) * mean, _levels("dip", "short", percent)),
        F.when(close < F.lit(0.95) * mean, _levels("deep", "long", silent)),
        F.when((close > F.col("previous_close")) & (close < F.lit(0.98) * mean), _levels("turn", "long", silent)),
    ]


def example_signals(bars: DataFrame) -> DataFrame:
    return signals.signal_rule(featured(bars), *example_rules())


def asked(bars: DataFrame) -> DataFrame:
    """Bars with the proposals of the example rules on them."""
    return signals.asked_bars(featured(bars), *example_rules())


def screen(bars: DataFrame, training_end: str) -> DataFrame:
    """Signal screen of the example rules on training bars."""
    training = featured(bars.where(F.col("bar_date") <= F.lit(training_end).cast("date")))
    fired = signals.signal_rule(training, *example_rules())
    return signals.signal_screen(training, fired, horizons=list(range(1, 11)))


def grid_scores(bars: DataFrame, points: DataFrame, training_end: str) -> DataFrame:
    """Screen every parameter point (lookback, drop, hold) of a dip rule in one pass over the bars.

    The points are a search budget of a few rows; they travel as one array on each bar.
    """
    training = features.bar_seq(bars.where(F.col("bar_date") <= F.lit(training_end).cast("date")))
    for length in (10, 20):
        training = features.rolling_mean(training, length, f"mean{length}")
    packed = points.agg(F.sort_array(F.collect_list(F.struct("point", "lookback", "drop", "hold"))).alias("points"))
    asked = training.where(F.col("seq") >= K.LOOKBACK_BARS).join(F.broadcast(packed)).withColumn(
        "p", F.explode("points")).where(F.col("close") < F.col("p.drop") * F.when(
            F.col("p.lookback") == 10, F.col("mean10")).otherwise(F.col("mean20")))
    fired = asked.select(
        F.col("p.point").alias("point"), "symbol", F.col("bar_date").alias("signal_date"), "seq",
        F.lit("long").alias("side"), F.col("p.hold").alias("max_hold_days"))
    scores = signals.signal_screen(training, fired, by=["point"], horizons=[3, 8])
    return points.join(scores, "point").select(
        F.lit("dip").alias("campaign"), "point", F.create_map(
            F.lit("lookback"), F.col("lookback").cast("string"), F.lit("drop"), F.col("drop").cast("string"),
            F.lit("hold"), F.col("hold").cast("string")).alias("params"), "signals", F.round("alpha", 9).alias("score"))


GRID = {"lookback": [10, 20], "drop": [0.97, 0.98], "hold": [3, 8]}


def risk_passes(seq_bars: DataFrame, proposals: DataFrame, rates: list[float]) -> DataFrame:
    """Trades of every risk rate: fills and exits once, then sized per rate."""
    closed = outcomes.closed_signals(seq_bars, proposals).withColumn("rate", F.explode(F.array(*[F.lit(float(r)) for r in rates])))
    entry = outcomes.buy_price(F.col("raw_entry"))
    sized = closed.withColumn("initial_risk", entry - F.col("stop_loss")).withColumn("qty", outcomes.position_size(
        F.lit(K.INITIAL_CAPITAL), F.lit(K.INITIAL_CAPITAL / K.MAX_POSITIONS), F.col("rate"), F.col("initial_risk"), entry))
    return outcomes.apply_costs(sized.where(F.col("qty") > 0))


def pass_results(trades_by_rate: DataFrame, ruin: DataFrame) -> DataFrame:
    """One row per (strategy, rate): return, drawdown, Sortino and the ruin estimates."""
    keys = ["strategy", "rate"]
    curve = outcomes.equity_curve(trades_by_rate, keys=keys).select(*keys, "bar_date", cents(F.col("equity")).alias("capital"))
    final = curve.groupBy(*keys).agg(F.max_by("capital", "bar_date").alias("f")).select(
        *keys, (100 * (F.col("f") - K.INITIAL_CAPITAL) / K.INITIAL_CAPITAL).alias("return_pct"))
    ratio = risk.sortino(risk.daily_returns(curve, keys), keys=keys)
    return final.join(ratio, keys).join(risk.drawdown_engine(curve, keys=keys).select(*keys, "max_drawdown_pct"), keys).join(
        ruin, keys)
