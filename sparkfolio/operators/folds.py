"""Walk-forward folds: calendar, assignment, slices and periods.

A fold table is a calendar of tens of rows.  ``fold_list`` folds it into one array row, with a
size check, so that ranges are matched by an expression on each row: no range join, no shuffle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numbers import fixed, guard

MAX_FOLDS = 1000


def fold_list(folds: DataFrame, limit: int = MAX_FOLDS) -> DataFrame:
    """One row holding array<struct<start, end, fold>> ordered by start; more than ``limit`` raises, so that
    the row can be broadcast."""
    listed = folds.agg(F.sort_array(F.collect_list(F.struct("start", "end", "fold"))).alias("folds"))
    return guard(listed, F.size("folds") <= limit, F.lit(f"more than {limit} folds"))


def assign_fold(rows: DataFrame, folds: DataFrame, date: str, strict: bool = False) -> DataFrame:
    """Add ``fold``: the first range that holds ``date``; others are dropped, or an error when strict."""
    inside = F.filter("folds", lambda f: (f["start"] <= F.col(date)) & (F.col(date) <= f["end"]))
    found = rows.join(F.broadcast(fold_list(folds))).withColumn(
        "fold", F.try_element_at(inside, F.lit(1))["fold"]).drop("folds")
    if not strict:
        return found.where(F.col("fold").isNotNull())
    problem = F.concat(F.lit("outside every fold: "), F.col(date).cast("string"))
    return guard(found, F.col("fold").isNotNull(), problem)


def fold_calendar(latest: DataFrame, fold_start: str, months: int, training_end: str,
                  fixed_count: int | None = None, evaluation_end: str | None = None) -> DataFrame:
    """Anchored folds of ``months`` months up to the latest date; the last one is cut there.

    ``latest`` is one row with a date column ``latest`` (an aggregate of the bars, so nothing is
    collected).  With ``evaluation_end`` the folds end there and must be ``fixed_count`` in number.
    """
    if dt.date.fromisoformat(fold_start).day > 28:
        raise ValueError("fold start must be on day 1..28")
    if training_end >= fold_start:
        raise ValueError("folds must follow training")
    start = F.lit(fold_start).cast("date")
    end = F.lit(evaluation_end).cast("date") if evaluation_end else F.col("latest")
    starts = F.transform(F.sequence(start, end, F.expr(f"interval {int(months)} months")), lambda d: d)
    listed = latest.select(end.alias("last"), F.when(end >= start, starts).otherwise(F.raise_error(F.lit(
        "folds must start no later than the latest data")).cast("array<date>")).alias("starts"))
    if fixed_count is not None:
        listed = listed.withColumn("starts", F.when(F.size("starts") == fixed_count, F.col("starts")).otherwise(
            F.raise_error(F.lit("fixed folds must end exactly at the evaluation end")).cast("array<date>")))
    return listed.select("last", F.posexplode("starts").alias("i", "start")).select(
        F.concat(F.lit("fold-"), (F.col("i") + 1).cast("string")).alias("fold"), "start",
        F.least(F.date_sub(F.add_months("start", months), 1), F.col("last")).alias("end"))


def warmup_slice(seq_bars: DataFrame, folds: DataFrame, warmup: int = K.LOOKBACK_BARS) -> DataFrame:
    """Bars of each fold and the ``warmup`` bars before its first one, per symbol.

    A symbol's first and last positions in each fold are one array row.  A bar is joined with its symbol's row only,
    searches it, and is repeated for the spans that hold it and no others.
    """
    spans = assign_fold(seq_bars.select("symbol", "bar_date", "seq"), folds, "bar_date").groupBy("symbol", "fold").agg(
        F.min("seq").alias("first"), F.max("seq").alias("last")).groupBy("symbol").agg(
        F.sort_array(F.collect_list(F.struct("first", "last", "fold"))).alias("_spans"))  # as many as folds: MAX_FOLDS
    seq = F.col("seq")
    held = F.filter("_spans", lambda x: (x["first"] - warmup <= seq) & (seq <= x["last"]))
    return seq_bars.join(spans, "symbol").withColumn("_span", F.explode(held)).withColumn("fold", F.col("_span.fold")).withColumn(
        "warmup", seq < F.col("_span.first")).drop("_spans", "_span")


def window_dates(slices: DataFrame) -> DataFrame:
    """Dates of any symbol inside a fold proper."""
    return slices.where(~F.col("warmup")).select("fold", "bar_date").distinct()


def period_profits(equity: DataFrame, folds: DataFrame, initial: float = K.INITIAL_CAPITAL) -> DataFrame:
    """Profit of each fold on one continuous equity path, to the cent.

    Capital at a fold's end is the last point on or before it, also from earlier folds.
    """
    hit = assign_fold(equity, folds, "bar_date").groupBy("strategy", "fold").agg(
        F.max_by("capital", "bar_date").alias("last_capital"))
    before = equity.join(F.broadcast(fold_list(folds))).where(
        F.col("bar_date") < F.col("folds")[0]["start"]).groupBy("strategy").agg(
        F.max_by("capital", "bar_date").alias("early"))
    cells = equity.select("strategy").distinct().join(F.broadcast(fold_list(folds))).select(
        "strategy", F.posexplode("folds").alias("i", "f")).select("strategy", "i", "f.fold")
    path = Window.partitionBy("strategy").orderBy("i")
    so_far = path.rowsBetween(Window.unboundedPreceding, 0)
    start = F.coalesce("early", F.lit(float(initial)))
    filled = cells.join(hit, ["strategy", "fold"], "left").join(before, "strategy", "left").withColumn(
        "end_capital", F.coalesce(F.last("last_capital", ignorenulls=True).over(so_far), start))
    previous = F.coalesce(F.lag("end_capital").over(path), F.lit(float(initial)))
    return filled.select("strategy", "fold", fixed(F.col("end_capital") - previous).alias("profit"))


def fold_names(declared: DataFrame, trades: DataFrame) -> DataFrame:
    """Fold names from the declared folds and from trades, without repeats."""
    return declared.select("fold").union(trades.select("fold").distinct()).distinct()
