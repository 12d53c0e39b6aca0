"""Prices, proposals, fills, exits, costs and R multiples as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .numbers import clamp, is_finite


# ---- prices ---------------------------------------------------------------------
def adjustment_factor(close: Column, adj_close: Column) -> Column:
    return F.when(close != 0, adj_close / close).otherwise(F.lit(1.0))


def real_iso_date(text: Column) -> Column:
    """Text is YYYY-MM-DD and names a day that exists."""
    return F.coalesce(text.rlike(K.ISO_DATE_PATTERN), F.lit(False)) & F.try_to_date(text, "yyyy-MM-dd").isNotNull()


def price_problems(symbol: Column, date_text: Column, open_: Column, high: Column, low: Column,
                   close: Column, adj_close: Column, volume: Column) -> Column:
    """Array of reasons why a price row is invalid; empty for a good row."""
    prices = [open_, high, low, close, adj_close]
    bad_price = F.lit(False)
    for price in prices:
        bad_price = bad_price | ~(is_finite(price) & F.coalesce(price > 0, F.lit(False)))
    whole = is_finite(volume) & F.coalesce((volume >= 0) & (volume == F.floor(volume)), F.lit(False))
    checks = [
        (F.coalesce(F.trim(symbol), F.lit("")) == "", "symbol"),
        (~real_iso_date(date_text), "date"),
        (bad_price, "price"),
        (~whole, "volume"),
        (F.coalesce(high < low, F.lit(False)), "range"),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in checks]))


# ---- proposals ------------------------------------------------------------------
def worst_entry(side: Column, entry_min: Column, entry_max: Column) -> Column:
    return F.when(side == "long", entry_max).otherwise(entry_min)


def stop_risk(side: Column, entry: Column, stop: Column) -> Column:
    return F.when(side == "long", entry - stop).otherwise(stop - entry)


def reward_risk(side: Column, entry: Column, stop: Column, target: Column, no_target: float) -> Column:
    """Reward per unit of risk at the worst entry; ``no_target`` where upside is uncapped."""
    risk = stop_risk(side, entry, stop)
    reward = F.when(side == "long", target - entry).otherwise(entry - target)
    return (
        F.when(risk <= 0, F.lit(float("-inf")) if no_target else F.lit(0.0))
        .when(target.isNull(), F.lit(float(no_target)))
        .otherwise(F.try_divide(reward, risk))
    )


def expected_r(score: Column, rr: Column) -> Column:
    """Expectancy in R; null when the reward is uncapped."""
    return F.when(rr == F.lit(float("inf")), F.lit(None).cast("double")).otherwise(score * rr - (1 - score))


def proposal_problems(side: Column, entry_min: Column, entry_max: Column, stop: Column, target: Column,
                      max_hold: Column, setup: Column, regime: Column) -> Column:
    """Array of broken rules of a proposal; empty when it keeps the contract."""
    long = side == "long"
    entry = worst_entry(side, entry_min, entry_max)
    risk = stop_risk(side, entry, stop)
    rr = reward_risk(side, entry, stop, target, float("inf"))
    wrong_stop = F.when(long, entry_min <= stop).otherwise(stop <= entry_max)
    wrong_target = target.isNotNull() & F.when(long, target <= entry_max).otherwise(entry_min <= target)
    not_number = ~is_finite(entry_min) | ~is_finite(entry_max) | ~is_finite(stop) | (
        target.isNotNull() & ~is_finite(target))
    checks = [
        (~F.coalesce(side.isin("long", "short"), F.lit(False)), "side"),
        (not_number, "number"),
        (entry_min <= 0, "entry_min"),
        (entry_max < entry_min, "entry_range"),
        (wrong_stop, "stop_side"),
        (wrong_target, "target_side"),
        (F.try_divide(risk, entry) < F.lit(K.MIN_STOP_DISTANCE), "stop_distance"),
        (rr < F.lit(K.MIN_REWARD_RISK), "reward_risk"),
        (~F.coalesce(max_hold > 0, F.lit(False)), "max_hold"),
        (F.coalesce(F.trim(setup), F.lit("")) == "", "setup"),
        (F.coalesce(F.trim(regime), F.lit("")) == "", "regime"),
    ]
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for test, name in checks]))


# ---- confidence -----------------------------------------------------------------
def normal_confidence(raw: Column) -> Column:
    """Confidence in [0, 1]; values above 1 are percent; null (or NaN) stays null."""
    value = F.when(raw > 1, raw / 100).otherwise(raw)
    return F.when(raw.isNull() | F.isnan(raw), F.lit(None).cast("double")).otherwise(clamp(value, 0.0, 1.0))


def logit(p: Column) -> Column:
    q = clamp(p, K.LOGIT_EPS, 1 - K.LOGIT_EPS)
    return F.ln(q / (1 - q))


def sigmoid(x: Column) -> Column:
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


# ---- execution ------------------------------------------------------------------
def entry_fill(entry_min: Column, entry_max: Column, open_: Column, high: Column, low: Column,
               stop: Column | None = None) -> Column:
    """Raw fill price or null: out of reach, or (when a stop is given) opened at or below it."""
    missed = (high < entry_min) | (low > entry_max)
    if stop is not None:
        missed = missed | (open_ <= stop)
    return F.when(~missed, F.greatest(entry_min, F.least(entry_max, open_)))


def bar_exit(side: Column, stop: Column, target: Column, high: Column, low: Column) -> Column:
    """struct<price, reason> for the level hit inside one bar, null for none; the stop wins."""
    long = side == "long"
    hit_stop = F.when(long, low <= stop).otherwise(high >= stop)
    hit_target = target.isNotNull() & F.when(long, high >= target).otherwise(low <= target)
    return F.when(hit_stop, F.struct(stop.alias("price"), F.lit("stop").alias("reason"))).when(
        hit_target, F.struct(target.alias("price"), F.lit("target").alias("reason")))


def r_multiple(side: Column, entry: Column, stop: Column, exit_: Column) -> Column:
    risk = stop_risk(side, entry, stop)
    move = F.when(side == "long", exit_ - entry).otherwise(entry - exit_)
    return F.when(risk <= 0, F.lit(float("-inf"))).otherwise(F.try_divide(move, risk))


def pnl_r_multiple(pnl: Column, qty: Column, risk: Column) -> Column:
    return F.when(risk > 0, F.try_divide(pnl, qty * risk)).otherwise(F.lit(0.0))


def buy_price(raw: Column, bps: float = K.SLIPPAGE_BPS_PER_SIDE) -> Column:
    return raw * F.lit(1 + bps / 10000)


def sell_price(raw: Column, bps: float = K.SLIPPAGE_BPS_PER_SIDE) -> Column:
    return raw * F.lit(1 - bps / 10000)


def position_size(capital: Column, budget: Column, risk_rate: Column, risk_per_share: Column, entry: Column,
                  brokerage: float = K.BROKERAGE_PER_SIDE) -> Column:
    """Whole shares allowed by both the risk budget and the cash budget."""
    by_risk = F.when(risk_per_share > 0, F.try_divide(capital * risk_rate, risk_per_share)).otherwise(F.lit(1.0))
    cash = F.greatest(F.lit(0.0), budget - F.lit(brokerage))
    by_cash = F.when(entry > 0, F.floor(F.try_divide(cash, entry)).cast("double")).otherwise(F.lit(0.0))
    return F.floor(F.least(by_risk, by_cash))


def risk_factor(ruin: Column, drawdown95: Column) -> Column:
    ruin_part = F.when(is_finite(ruin), clamp(1 - ruin * 5, 0.75, 1.0)).otherwise(F.lit(1.0))
    excess = F.greatest(F.lit(0.0), drawdown95 - F.lit(0.25))
    drawdown_part = F.when(is_finite(drawdown95), clamp(1 - excess, 0.75, 1.0)).otherwise(F.lit(1.0))
    return ruin_part * drawdown_part


def trade_confidence(trades: Column) -> Column:
    enough = F.coalesce(trades >= K.MIN_TRADES_FOR_SCORE, F.lit(False))
    return F.when(enough, F.least(F.lit(1.0), trades / F.lit(float(K.FULL_CONFIDENCE_TRADES)))).otherwise(F.lit(0.0))


def is_improvement(score: Column, best: Column, min_delta_pct: float, failed_checks: Column | None = None) -> Column:
    better = score > best + F.abs(best) * F.lit(float(min_delta_pct))
    return better if failed_checks is None else better & (failed_checks == 0)


def predicted_return_pct(origin: Column, forecast: Column) -> Column:
    """Percent return of a forecast, null unless both prices are finite and positive."""
    fine = is_finite(origin) & is_finite(forecast) & (origin > 0) & (forecast > 0)
    return F.when(fine, F.lit(100.0) * (F.try_divide(forecast, origin) - 1))


def time_exit(days_open: Column, max_hold: Column) -> Column:
    return days_open >= max_hold


def adjust_open_long(stop: Column, new_side: Column, new_stop: Column, new_target: Column) -> Column:
    """struct<action, stop_loss, target>: a short proposal exits, a long one ratchets the stop."""
    leave = new_side == "short"
    empty = F.lit(None).cast("double")
    return F.struct(
        F.when(leave, F.lit("exit")).otherwise(F.lit("adjust")).alias("action"),
        F.when(leave, empty).otherwise(F.greatest(stop, new_stop)).alias("stop_loss"),
        F.when(leave, empty).otherwise(new_target).alias("target"),
    )
