"""Adjusting, validating and describing bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.trading import adjustment_factor, price_problems


def adjust_prices(bars: DataFrame) -> DataFrame:
    """Candles with prices scaled by adj_close / close; volume unchanged."""
    factor = adjustment_factor(F.col("close"), F.col("adj_close"))
    return bars.select(
        "symbol", "bar_date",
        *[(F.col(name) * factor).alias(name) for name in ("open", "high", "low")],
        F.col("adj_close").alias("close"), "volume")


def quarantine(rows: DataFrame) -> DataFrame:
    """Invalid provider rows with their reasons."""
    checked = rows.withColumn("problems", price_problems(*[F.col(name) for name in K.CSV_COLUMNS]))
    return checked.where(F.size("problems") > 0)


def duplicate_dates(rows: DataFrame, keys: tuple[str, str] = ("symbol", "bar_date")) -> DataFrame:
    """Keys that occur more than once (a candle series must be strictly increasing)."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def select_universe(bars: DataFrame, training_end: str, first_by: str, excluded: list[str],
                    top: int = K.UNIVERSE_TOP_N) -> DataFrame:
    """The ``top`` symbols by mean traded value over the training range, with early enough history."""
    stats = bars.where(F.col("bar_date") <= F.lit(training_end).cast("date")).groupBy("symbol").agg(
        F.avg(F.col("close") * F.col("volume")).alias("traded_value"),
        F.min("bar_date").alias("first_date"),
        F.count(F.lit(1)).alias("bars"),
    )
    kept = stats.where((F.col("first_date") <= F.lit(first_by).cast("date")) & ~F.col("symbol").isin(excluded))
    return kept.orderBy(F.desc("traded_value"), "symbol").limit(top)


def price_status(bars: DataFrame, universe: DataFrame) -> DataFrame:
    """Count, first and last bar per universe symbol (missing ones shown) and a total row."""
    marked = universe.select("symbol").distinct().join(
        bars.groupBy("symbol").agg(
            F.count(F.lit(1)).alias("n"), F.min("bar_date").alias("a"), F.max("bar_date").alias("b")),
        "symbol", "left")
    return marked.rollup("symbol").agg(
        F.sum(F.coalesce("n", F.lit(0))).alias("bars"), F.min("a").alias("first_date"), F.max("b").alias("last_date"),
        F.grouping("symbol").alias("is_total"),
    ).withColumn("status", F.when(F.col("is_total") == 1, "total").when(F.col("bars") == 0, "missing").otherwise("present"))


def price_quality(bars: DataFrame, max_move: float = K.MAX_DAILY_MOVE) -> DataFrame:
    """One row per problem: the malformed count of a symbol, or a large adjusted move into a date.

    The window holds the bars of one symbol: at most one per calendar day.
    """
    bad = F.lit(False)
    for name in ("open", "high", "low", "close", "adj_close"):
        bad = bad | (F.col(name) <= 0)
    bad = bad | (F.col("high") < F.col("low"))
    malformed = bars.groupBy("symbol").agg(F.count_if(bad).alias("n")).where(F.col("n") > 0).select(
        "symbol", F.lit("malformed").alias("problem"), F.lit(None).cast("date").alias("bar_date"),
        F.col("n").cast("double").alias("value"))
    previous = F.lag("adj_close").over(Window.partitionBy("symbol").orderBy("bar_date"))
    moves = bars.select("symbol", "bar_date", F.try_divide("adj_close", previous).alias("step")).where(
        F.abs(F.col("step") - 1) > F.lit(max_move)).select(
        "symbol", F.lit("move").alias("problem"), "bar_date", (F.col("step") - 1).alias("value"))
    return malformed.unionByName(moves)


def symbol_coverage(bars: DataFrame, symbols: DataFrame, training_end: str, fold_start: str,
                    training_start: str = "0001-01-01") -> DataFrame:
    """First, last, training rows and the two training checks per symbol."""
    date = F.col("bar_date")
    in_training = (date >= F.lit(training_start).cast("date")) & (date <= F.lit(training_end).cast("date"))
    stats = bars.groupBy("symbol").agg(
        F.min("bar_date").alias("first_date"), F.max("bar_date").alias("last_date"),
        F.count_if(in_training).alias("training_rows"))
    rows = F.coalesce("training_rows", F.lit(0))
    return symbols.select("symbol").distinct().join(stats, "symbol", "left").select(
        "symbol", "first_date", "last_date", rows.alias("training_rows"),
        (rows >= K.MIN_TRAINING_ROWS).alias("enough_training"),
        F.coalesce(F.col("last_date") >= F.lit(fold_start).cast("date"), F.lit(False)).alias("has_evaluation"))


def fold_coverage(bars: DataFrame, symbols: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows per symbol and fold, with empty and sparse cells marked.

    Folds are a fixed small calendar: they travel as one array on each symbol and are exploded,
    and bars are counted per (symbol, fold) before any join.
    """
    from .folds import assign_fold, fold_list

    counts = assign_fold(bars, folds, "bar_date").groupBy("symbol", "fold").agg(F.count(F.lit(1)).alias("n"))
    cells = symbols.select("symbol").distinct().join(F.broadcast(fold_list(folds))).select(
        "symbol", F.explode("folds").alias("f")).select("symbol", "f.*")
    days = F.datediff("end", "start") + 1
    rows = F.coalesce("n", F.lit(0))
    return cells.join(counts, ["symbol", "fold"], "left").select(
        "symbol", "fold", rows.alias("bars"), (rows == 0).alias("empty"),
        ((rows > 0) & (rows < days * F.lit(K.SPARSE_COVERAGE))).alias("sparse"))


def missing_roles(market: DataFrame, roles: DataFrame) -> DataFrame:
    """Context roles that have no data."""
    return roles.join(market.select("role").distinct(), "role", "left_anti")


def training_range(bars: DataFrame, training_end: str, evaluation_end: str) -> DataFrame:
    """First training bar and last evaluation bar over all symbols, and whether the ranges are apart."""
    end = F.lit(training_end).cast("date")
    last = F.lit(evaluation_end).cast("date")
    return bars.agg(
        F.min(F.when(F.col("bar_date") <= end, F.col("bar_date"))).alias("training_start"),
        F.max(F.when(F.col("bar_date") <= last, F.col("bar_date"))).alias("latest"),
        F.min(F.when(F.col("bar_date") > end, F.col("bar_date"))).alias("evaluation_start"),
    ).select("training_start", end.alias("training_end"), "evaluation_start", "latest",
             F.coalesce(F.col("evaluation_start") > end, F.lit(False)).alias("apart"))
