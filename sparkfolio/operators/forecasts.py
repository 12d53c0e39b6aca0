"""Forecast windows, baselines, scoring of user models, and forecast metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numbers import guard
from ..functions.numbers import sign_with_deadband
from .features import by_symbol

FORECAST_COLUMNS = ["symbol", "origin", "model", "horizon", "target_date", "origin_price", "actual_price",
                    "forecast_price", "quantiles"]
SCORED = "symbol string, origin date, model string, horizon int, forecast_price double, quantiles array<double>"


# ---- windows ----------------------------------------------------------------------
def rolling_windows(seq_bars: DataFrame, context: int, stride: int, horizons: list[int], start: str | None = None,
                    end: str | None = None) -> DataFrame:
    """Forecast origins of a partition: enough bars before, every horizon inside it, each ``stride``-th
    eligible one.  Without ``start`` or ``end`` it is open there, so every bar may be an origin.  Windows are over
    one symbol (one row per day).
    """
    last = F.lead("bar_date", max(horizons)).over(by_symbol())
    inside = seq_bars if end is None else seq_bars.where(F.col("bar_date") <= F.lit(end).cast("date"))
    eligible = inside.withColumn("_last", last).where((F.col("seq") >= context) & F.col("_last").isNotNull())
    if start is not None:
        eligible = eligible.where(F.col("bar_date") >= F.lit(start).cast("date"))
    numbered = eligible.withColumn("_i", F.row_number().over(by_symbol()) - 1)
    return numbered.where(F.col("_i") % stride == 0).select(
        "symbol", F.col("bar_date").alias("origin"), "seq", F.col("adj_close").alias("origin_price"))


def anchored_windows(seq_bars: DataFrame, context: int, stride: int, ranges: DataFrame) -> DataFrame:
    """Origins every ``stride`` bars from the symbol's own history, in the named range that holds them."""
    from .folds import assign_fold

    origins = seq_bars.where((F.col("seq") >= context) & ((F.col("seq") - context) % stride == 0))
    return assign_fold(origins, ranges, "bar_date").select(
        "symbol", F.col("bar_date").alias("origin"), "seq", F.col("adj_close").alias("origin_price"), "fold")


def window_history(seq_bars: DataFrame, origins: DataFrame, context: int) -> DataFrame:
    """Origins with their trailing ``context`` adjusted closes: nothing later crosses to a model.

    Bars are marked as origins before the window, so histories are made where their symbol lies and only those asked
    for go on: no array is shuffled or sorted.
    """
    frame = by_symbol().rowsBetween(1 - context, 0)
    others = [name for name in origins.columns if name not in ("symbol", "seq")]
    asked = origins.groupBy("symbol", "seq").agg(F.collect_list(F.struct(*others)).alias("_asked"))
    marked = seq_bars.select("symbol", "bar_date", "seq", "adj_close").join(asked, ["symbol", "seq"], "left")
    history = marked.withColumn("history", F.collect_list("adj_close").over(frame))
    return history.where(F.col("_asked").isNotNull() & (F.col("seq") >= context)).select(
        "symbol", "seq", F.inline("_asked"), "history").select(*origins.columns, "history")


def forecast_targets(seq_bars: DataFrame, origins: DataFrame, horizons: list[int]) -> DataFrame:
    """Target date and actual adjusted price per origin and horizon."""
    asked = origins.withColumn("horizon", F.explode(F.array(*[F.lit(int(h)) for h in horizons]))).withColumn(
        "_target", F.col("seq") + F.col("horizon"))
    actual = seq_bars.select("symbol", F.col("seq").alias("_target"), F.col("bar_date").alias("target_date"),
                             F.col("adj_close").alias("actual_price"))
    return asked.join(actual, ["symbol", "_target"]).drop("_target")


# ---- models -----------------------------------------------------------------------
def baseline_unchanged(targets: DataFrame) -> DataFrame:
    return targets.select("symbol", "origin", F.lit("unchanged").alias("model"), "horizon", "target_date",
                          "origin_price", "actual_price", F.col("origin_price").alias("forecast_price"),
                          F.lit(None).cast("array<double>").alias("quantiles"))


def baseline_momentum(targets: DataFrame, seq_bars: DataFrame, lookback: int = 10) -> DataFrame:
    """Origin price carried on at the mean log return of the last ``lookback`` bars."""
    back = seq_bars.select("symbol", "seq", F.lag("adj_close", lookback).over(by_symbol()).alias("_past"))
    daily = F.ln(F.try_divide("origin_price", "_past")) / lookback
    return targets.join(back, ["symbol", "seq"]).select(
        "symbol", "origin", F.lit("momentum").alias("model"), "horizon", "target_date", "origin_price", "actual_price",
        (F.col("origin_price") * F.exp(daily * F.col("horizon"))).alias("forecast_price"),
        F.lit(None).cast("array<double>").alias("quantiles"))


def empirical_quantiles(histories: np.ndarray, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """Shipped example model: quantiles of the window's own past ``horizon``-bar returns."""
    past = histories[:, horizon:] / histories[:, :-horizon] - 1
    levels = np.quantile(past, K.QUANTILE_LEVELS, axis=1).T
    prices = histories[:, -1:] * (1 + levels)
    return prices[:, 4], prices


def forecast_scorer(windows: DataFrame, model: Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]],
                    name: str, horizons: list[int]) -> DataFrame:
    """Run a user model on Arrow batches of context windows (symbol, origin, history).

    The model gets (windows x context) prices and a horizon; it answers point forecasts and nine
    quantiles per window.  Wrong lengths, numbers that are not finite, and crossed quantiles are errors.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            histories = np.stack(batch["history"].to_numpy())
            for horizon in horizons:
                points, quantiles = model(histories, horizon)
                points, quantiles = np.asarray(points, float), np.asarray(quantiles, float)
                if points.shape != (len(batch),) or quantiles.shape != (len(batch), len(K.QUANTILE_LEVELS)):
                    raise ValueError("unexpected forecast shape")
                if not (np.isfinite(points).all() and np.isfinite(quantiles).all()):
                    raise ValueError("forecast is not finite")
                if (np.diff(quantiles, axis=1) < 0).any():
                    raise ValueError("crossed quantiles")
                yield pd.DataFrame({"symbol": batch["symbol"], "origin": batch["origin"], "model": name,
                                    "horizon": horizon, "forecast_price": points, "quantiles": list(quantiles)})

    return windows.select("symbol", "origin", "history").mapInPandas(run, SCORED)


def scored_forecasts(targets: DataFrame, scored: DataFrame) -> DataFrame:
    """Model output with the targets it is judged on."""
    return targets.select("symbol", "origin", "horizon", "target_date", "origin_price", "actual_price").join(
        scored, ["symbol", "origin", "horizon"]).select(*FORECAST_COLUMNS)


# ---- metrics ----------------------------------------------------------------------
def forecast_errors(forecasts: DataFrame, deadband: float) -> DataFrame:
    """Row-level errors in percent of the origin price, and both directions."""
    origin = F.col("origin_price")
    change = lambda price: F.lit(100.0) * (F.try_divide(F.col(price), origin) - 1)
    return forecasts.withColumn("abs_error", F.abs(F.col("forecast_price") - F.col("actual_price"))).withColumn(
        "error_pp", F.try_divide(F.lit(100.0) * F.col("abs_error"), origin)).withColumn(
        "actual_dir", sign_with_deadband(change("actual_price"), deadband)).withColumn(
        "forecast_dir", sign_with_deadband(change("forecast_price"), deadband))


def _by_groups(rows: DataFrame, *aggs) -> DataFrame:
    """Aggregate overall, per symbol and per origin year, for each model and horizon, in one pass."""
    keyed = rows.withColumn("year", F.year("origin").cast("string"))
    sets = [[F.col("model"), F.col("horizon")], [F.col("symbol"), F.col("model"), F.col("horizon")],
            [F.col("year"), F.col("model"), F.col("horizon")]]
    grouped = keyed.groupingSets(sets, "symbol", "year", "model", "horizon").agg(
        F.grouping("symbol").alias("_s"), F.grouping("year").alias("_y"), *aggs)
    group = F.when(F.col("_s") == 0, "symbol").when(F.col("_y") == 0, "year").otherwise("overall")
    label = F.when(F.col("_s") == 0, F.col("symbol")).when(F.col("_y") == 0, F.col("year")).otherwise("all")
    return grouped.select(group.alias("group"), label.alias("label"), *[
        c for c in grouped.columns if c not in ("symbol", "year", "_s", "_y")])


def forecast_metrics(forecasts: DataFrame, deadband: float = 0.1) -> DataFrame:
    """Errors and direction skill per group, model and horizon."""
    rows = forecast_errors(forecasts, deadband)
    hit = F.col("actual_dir") == F.col("forecast_dir")
    n = F.count(F.lit(1))
    up, down = F.count_if(F.col("actual_dir") == 1), F.count_if(F.col("actual_dir") == -1)
    recall = lambda sign, total: F.try_divide(F.count_if(hit & (F.col("actual_dir") == sign)), total)
    share = lambda test: 100.0 * F.count_if(test) / n
    return _by_groups(
        rows, n.alias("n"), F.avg("error_pp").alias("return_mae_pp"), F.avg("abs_error").alias("price_mae"),
        F.count_if(hit).alias("direction_hits"), share(hit).alias("direction_accuracy_pct"),
        (100.0 * (recall(1, up) + recall(-1, down)) / 2).alias("balanced_accuracy_pct"),
        share(F.col("actual_dir") == 1).alias("actual_up_pct"), share(F.col("actual_dir") == 0).alias("actual_flat_pct"),
        share(F.col("forecast_dir") != 0).alias("predicted_nonflat_pct"))


def near_hits(forecasts: DataFrame, tolerances: list[float]) -> DataFrame:
    """Rows within each tolerance of the actual price, in percent of the origin price."""
    level = F.explode(F.array(*[F.lit(float(t)) for t in tolerances]))
    rows = forecast_errors(forecasts, 0.0).withColumn("tolerance", level)
    near = F.col("error_pp") <= F.col("tolerance")
    return rows.groupBy("model", "horizon", "tolerance").agg(
        F.count_if(near).alias("hits"), (100.0 * F.count_if(near) / F.count(F.lit(1))).alias("hit_pct"))


def quantile_calibration(forecasts: DataFrame) -> DataFrame:
    """Interval coverage and width, pinball loss and observed coverage of each quantile level."""
    rows = forecasts.where(F.col("quantiles").isNotNull())
    q, actual, origin = F.col("quantiles"), F.col("actual_price"), F.col("origin_price")
    first, last = q[0], q[len(K.QUANTILE_LEVELS) - 1]
    levels = F.array(*[F.lit(level) for level in K.QUANTILE_LEVELS])

    def pinball(value, level):
        gap = F.try_divide(F.lit(100.0) * (actual - value), origin)
        return F.greatest(level * gap, (level - 1) * gap)

    loss = F.aggregate(F.zip_with(q, levels, pinball), F.lit(0.0), lambda acc, x: acc + x)
    observed = [(100.0 * F.count_if(actual <= q[i]) / F.count(F.lit(1))).alias(f"observed_{int(round(level * 100))}")
                for i, level in enumerate(K.QUANTILE_LEVELS)]
    return rows.groupBy("model", "horizon").agg(
        F.count(F.lit(1)).alias("n"),
        (100.0 * F.count_if((first <= actual) & (actual <= last)) / F.count(F.lit(1))).alias("interval_coverage_pct"),
        F.avg(F.try_divide(F.lit(100.0) * (last - first), origin)).alias("interval_width_pp"),
        (F.avg(loss) / len(K.QUANTILE_LEVELS)).alias("pinball_pp"), *observed)


def forecast_skill(metrics: DataFrame, baseline: str = "unchanged") -> DataFrame:
    """Skill of each model against the baseline: overall, and by how many symbols it wins."""
    base = metrics.where(F.col("model") == baseline).select(
        "group", "label", "horizon", F.col("return_mae_pp").alias("_base"))
    joined = metrics.where((F.col("model") != baseline) & F.col("group").isin("overall", "symbol")).join(
        base, ["group", "label", "horizon"])
    overall, symbol = F.col("group") == "overall", F.col("group") == "symbol"
    skill = F.lit(100.0) * (1 - F.try_divide("return_mae_pp", "_base"))
    return joined.groupBy("model", "horizon").agg(
        F.max(F.when(overall, skill)).alias("mae_skill_pct"),
        F.count_if(symbol & (F.col("return_mae_pp") < F.col("_base"))).alias("symbols_beating_baseline"),
        F.count_if(symbol).alias("symbols"),
        F.avg(F.when(symbol, F.col("return_mae_pp"))).alias("equal_weight_symbol_mae_pp"))


# ---- campaigns --------------------------------------------------------------------
def window_completeness(forecasts: DataFrame, models: list[str], horizons: list[int]) -> DataFrame:
    """Present and expected (model, horizon) results of each stored window."""
    wanted = F.col("model").isin(models) & F.col("horizon").isin(horizons)
    pair = F.when(wanted, F.struct("model", "horizon"))
    return forecasts.groupBy("symbol", "origin").agg(
        F.count_distinct(pair).alias("present"), F.count(F.lit(1)).alias("rows")).withColumn(
        "complete", (F.col("present") == len(models) * len(horizons)) & (F.col("rows") == F.col("present")))


def forecast_completeness(forecasts: DataFrame, origins: DataFrame, models: list[str], horizons: list[int]) -> DataFrame:
    """Status of a campaign; a stored window with missing results raises."""
    stored = window_completeness(forecasts, models, horizons).agg(
        F.count_if("complete").alias("complete_windows"), F.count_if(~F.col("complete")).alias("broken"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("forecast_rows"))
    planned = origins.agg(F.count(F.lit(1)).alias("expected_windows"))
    checked = guard(stored, F.col("broken") == 0, F.lit("incomplete windows; score them again first"))
    return checked.join(F.broadcast(planned)).select(
        "expected_windows", "complete_windows", "forecast_rows",
        F.when(F.col("complete_windows") == F.col("expected_windows"), "complete").otherwise("partial").alias("status"))


def pending_windows(origins: DataFrame, forecasts: DataFrame, models: list[str], horizons: list[int]) -> DataFrame:
    """Origins whose full set of results is not stored yet."""
    done = window_completeness(forecasts, models, horizons).where("complete")
    return origins.join(done.select("symbol", "origin"), ["symbol", "origin"], "left_anti")


def window_keys(windows: DataFrame, settings: str) -> DataFrame:
    """Content key of each window: equal inputs under equal settings share one prediction."""
    text = F.concat_ws("|", F.lit(settings), "symbol", F.col("origin").cast("string"),
                       F.array_join(F.transform("history", lambda x: x.cast("string")), ","))
    return windows.withColumn("key", F.sha2(text, 256))


def forecast_view(campaign_windows: DataFrame, predictions: DataFrame) -> DataFrame:
    """Campaign windows with the predictions stored under their content key."""
    return campaign_windows.join(predictions, "key")
