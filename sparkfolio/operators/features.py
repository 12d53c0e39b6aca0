"""Per-bar features.  Windows are over one symbol: at most one row per calendar day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .. import constants as K

def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("bar_date")


def bar_seq(bars: DataFrame) -> DataFrame:
    """Position of each bar in its symbol, from 1."""
    return bars.withColumn("seq", F.row_number().over(by_symbol()))


def rolling_traded_value(bars: DataFrame, length: int = K.TRADED_VALUE_BARS) -> DataFrame:
    """Mean close x volume of the last ``length`` bars, fewer at the start."""
    return bars.withColumn(
        "traded_value", F.avg(F.col("close") * F.col("volume")).over(by_symbol().rowsBetween(1 - length, 0)))


def rolling_mean(bars: DataFrame, length: int, name: str) -> DataFrame:
    """Mean close of the last ``length`` bars, to eight places."""
    return bars.withColumn(name, F.round(F.avg("close").over(by_symbol().rowsBetween(1 - length, 0)), 8))


def lookback_bars(bars: DataFrame, length: int = K.LOOKBACK_BARS) -> DataFrame:
    """The trailing ``length`` bars as an array, only where it is full."""
    frame = by_symbol().rowsBetween(1 - length, 0)
    history = F.collect_list(F.struct("bar_date", "open", "high", "low", "close", "volume")).over(frame)
    return bars.withColumn("history", history).where(F.size("history") == length)


def market_calendar(bars: DataFrame) -> DataFrame:
    """Distinct trading dates of all symbols, each with the next one.

    The window has no key, but its rows are days: the calendar, not the data, bounds it.
    """
    dates = bars.select("bar_date").distinct()
    return dates.withColumn("next_date", F.lead("bar_date").over(Window.partitionBy(F.lit(1)).orderBy("bar_date")))
