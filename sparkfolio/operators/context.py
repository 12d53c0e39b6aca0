"""Point-in-time joins of context series and forecasts to bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numbers import guard
from ..functions.numbers import is_finite
from ..functions.trading import predicted_return_pct

# Every window below is over one symbol or one role: at most one row per calendar day.


def align_market_index(bars: DataFrame, market: DataFrame, role: str = "index") -> DataFrame:
    """Index close of the same date, filled forward over the symbol's own bars.

    An index value of a date on which the symbol had no bar is not carried.
    """
    series = market.where((F.col("role") == role) & is_finite(F.col("close"))).select(
        "bar_date", F.col("close").alias("_index"))
    own = Window.partitionBy("symbol").orderBy("bar_date").rowsBetween(Window.unboundedPreceding, 0)
    return bars.join(series, "bar_date", "left").withColumn(
        "index_close", F.last("_index", ignorenulls=True).over(own)).drop("_index")


def market_asof(bars: DataFrame, market: DataFrame, value: Column, strict: bool = False) -> DataFrame:
    """Latest context value on or before each bar date (strictly before, when ``strict``) per role.

    The as-of step runs on the calendar: distinct bar dates against the context series, both bounded
    by the number of days.  Bars then take their value by an equi join on the date.
    """
    point = F.struct(value.alias("v"), F.col("bar_date").alias("d"))
    known = market.select("role", "bar_date", F.lit(False).alias("_asks"), point.alias("_p"))
    asked = bars.select("bar_date").distinct().join(market.select("role").distinct()).select(
        "role", "bar_date", F.lit(True).alias("_asks"), F.lit(None).cast(known.schema["_p"].dataType).alias("_p"))
    same_day = F.desc("_asks") if strict else F.asc("_asks")
    path = Window.partitionBy("role").orderBy("bar_date", same_day).rowsBetween(Window.unboundedPreceding, 0)
    lookup = known.unionByName(asked).withColumn("_p", F.last("_p", ignorenulls=True).over(path)).where("_asks").select(
        "role", "bar_date", F.col("_p.v").alias("context"), F.col("_p.d").alias("context_date"))
    return bars.join(lookup, "bar_date")


def trailing_context(market: DataFrame, bars_back: int = K.LOOKBACK_BARS) -> DataFrame:
    """Context rows with their trailing ``bars_back`` points (itself included) as an array."""
    frame = Window.partitionBy("role").orderBy("bar_date").rowsBetween(1 - bars_back, 0)
    return market.withColumn("history", F.collect_list(F.struct("bar_date", "close")).over(frame))


def market_asof_window(bars: DataFrame, market: DataFrame, bars_back: int = K.LOOKBACK_BARS,
                       strict: bool = False) -> DataFrame:
    """As ``market_asof`` with the trailing context points as an array."""
    return market_asof(bars, trailing_context(market, bars_back), F.col("history"), strict)


def forecast_exact_join(bars: DataFrame, forecasts: DataFrame, model: str,
                        horizon: int = K.FEATURE_HORIZON) -> DataFrame:
    """Forecast made on the bar's own date, else null: never carried, outcomes never exposed."""
    feature = forecasts.where((F.col("model") == model) & (F.col("horizon") == horizon)).select(
        "symbol", F.col("origin").alias("bar_date"), F.col("origin").alias("as_of"),
        F.col("horizon").alias("horizon_days"),
        predicted_return_pct(F.col("origin_price"), F.col("forecast_price")).alias("predicted_return_pct"),
    ).where(is_finite(F.col("predicted_return_pct")))
    return bars.join(feature, ["symbol", "bar_date"], "left")


def forecast_coverage(forecasts: DataFrame, symbols: DataFrame, ranges: DataFrame, model: str,
                      horizon: int = K.FEATURE_HORIZON, strict: bool = False, campaign: DataFrame | None = None) -> DataFrame:
    """Forecast rows per symbol and range; an empty cell is an error when ``strict``.

    With the ranges of a ``campaign``, a range outside of them is an error.
    """
    from .folds import assign_fold, fold_list

    if campaign is not None:
        ranges = guard(ranges_inside(ranges, campaign), F.col("inside"),
                       F.concat(F.lit("outside the campaign: "), F.col("fold"))).drop("inside")

    counts = assign_fold(
        forecasts.where((F.col("model") == model) & (F.col("horizon") == horizon)).select("symbol", "origin"),
        ranges, "origin").groupBy("symbol", "fold").agg(F.count(F.lit(1)).alias("n"))
    cells = symbols.select("symbol").distinct().join(F.broadcast(fold_list(ranges))).select(
        "symbol", F.explode("folds").alias("f")).select("symbol", "f.fold")
    rows = F.coalesce("n", F.lit(0))
    covered = cells.join(counts, ["symbol", "fold"], "left").select("symbol", "fold", rows.alias("forecasts"))
    if strict:
        empty = F.concat(F.lit("no forecasts for "), F.col("symbol"), F.lit(" in "), F.col("fold"))
        covered = guard(covered, F.col("forecasts") > 0, empty)
    return covered


def ranges_inside(ranges: DataFrame, campaign: DataFrame) -> DataFrame:
    """Whether each wanted range lies inside one of the campaign's ranges."""
    from .folds import fold_list

    inside = F.exists("folds", lambda f: (f["start"] <= F.col("start")) & (F.col("end") <= f["end"]))
    return ranges.join(F.broadcast(fold_list(campaign))).select("fold", "start", "end", inside.alias("inside"))
