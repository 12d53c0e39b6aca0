"""Price files and tables: read, check, upsert, sync and export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.numbers import guard
from ..functions.trading import adjustment_factor, predicted_return_pct, price_problems


def read_prices_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """CSV files whose header has the eight price columns in any order; extra columns are ignored.

    ``multi_line`` allows line breaks inside quotes, at the price of one task per file.
    The result holds typed rows and a ``problems`` array (see ``require_valid``).
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, quote='"', escape='"', multiLine=multi_line,
                         ignoreLeadingWhiteSpace=False, enforceSchema=False)
    missing = [name for name in K.CSV_COLUMNS if name not in raw.columns]
    if missing:
        raise ValueError(f"{path}: missing required columns: {', '.join(missing)}")
    number = lambda name: F.expr(f"try_cast(trim(`{name}`) AS double)")
    typed = raw.select(
        F.trim("symbol").alias("symbol"), F.trim("date").alias("date"),
        *[number(name).alias(name) for name in K.CSV_COLUMNS[2:]],
    )
    return with_problems(typed)


def with_problems(rows: DataFrame) -> DataFrame:
    return rows.withColumn("problems", price_problems(*[F.col(name) for name in K.CSV_COLUMNS]))


def require_valid(rows: DataFrame) -> DataFrame:
    """Typed bars; any row with a problem fails the job, so nothing is half imported."""
    message = F.concat(F.lit("invalid "), F.concat_ws("/", "problems"), F.lit(" in row of "),
                       F.coalesce("symbol", F.lit("?")), F.lit(" "), F.coalesce("date", F.lit("?")))
    return _to_bars(guard(rows, F.size("problems") == 0, message))


def valid_rows(rows: DataFrame) -> DataFrame:
    """The rows without problems, as bars (the others stay in quarantine)."""
    return _to_bars(rows.where(F.size("problems") == 0))


def _to_bars(rows: DataFrame) -> DataFrame:
    return rows.select(
        "symbol", F.try_to_date("date", "yyyy-MM-dd").alias("bar_date"),
        "open", "high", "low", "close", "adj_close", F.expr("try_cast(volume AS bigint)").alias("volume"))


def read_prices(bars: DataFrame, symbols: list[str]) -> DataFrame:
    """Rows of the given symbols; on Parquet the filter reaches the scan."""
    return bars.where(F.col("symbol").isin(symbols)).select(*K.PRICE_COLUMNS)


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """Universe CSV (symbol, name, sector, status); a ragged row is an error."""
    schema = T.StructType([T.StructField(name, T.StringType()) for name in ("symbol", "name", "sector", "status")])
    rows = spark.read.csv(path, header=True, schema=schema, mode="FAILFAST", quote='"', escape='"')
    return rows.where(~F.col("status").eqNullSafe(K.UNAVAILABLE_STATUS))


def upsert_prices(base: DataFrame, batch: DataFrame) -> DataFrame:
    """Union of both, the batch winning on (symbol, bar_date).

    ``batch`` may carry ``batch_no``; its highest value wins.  Grouping by the full key with
    ``max_by`` pre-aggregates on the map side, so repeated keys never pile up in one task.
    """
    if "batch_no" not in batch.columns:
        batch = batch.withColumn("batch_no", F.lit(1))
    rows = base.select(*K.PRICE_COLUMNS).withColumn("batch_no", F.lit(0)).unionByName(
        batch.select(*K.PRICE_COLUMNS, "batch_no"))
    values = [name for name in K.PRICE_COLUMNS if name not in ("symbol", "bar_date")]
    return rows.groupBy("symbol", "bar_date").agg(
        F.max_by(F.struct(*values), "batch_no").alias("v")).select("symbol", "bar_date", "v.*")


def write_prices(bars: DataFrame, path: str) -> None:
    """Parquet by year, rows of a symbol together, so symbol and date filters skip files."""
    (
        bars.withColumn("year", F.year("bar_date"))
        .repartitionByRange("year", "symbol", "bar_date")
        .sortWithinPartitions("year", "symbol", "bar_date")
        .write.mode("overwrite").partitionBy("year").parquet(path)
    )


def newer_rows(source: DataFrame, target: DataFrame, symbols: list[str] | None = None,
               after: str | None = None) -> DataFrame:
    """Source rows later than the target's last bar of the symbol (and than ``after``)."""
    if symbols is not None:
        source = source.where(F.col("symbol").isin(symbols))
    last = target.groupBy("symbol").agg(F.max("bar_date").alias("last_date"))
    floor_date = F.lit(after or "0001-01-01").cast("date")
    cutoff = F.greatest(F.coalesce("last_date", floor_date), floor_date)
    return source.join(last, "symbol", "left").where(F.col("bar_date") > cutoff).drop("last_date")


def sync_newer_rows(source_rows: DataFrame, target: DataFrame, symbols: list[str] | None = None,
                    after: str | None = None) -> DataFrame:
    """Newer provider rows, checked as a whole: one bad new row raises and nothing is returned.

    Rows at or before the cutoff are never examined.  Dates that do not parse cannot be placed in
    time and count as new.
    """
    dated = with_problems(source_rows).withColumn("bar_date", F.try_to_date("date", "yyyy-MM-dd"))
    known = newer_rows(dated.where(F.col("bar_date").isNotNull()), target, symbols, after)
    undated = dated.where(F.col("bar_date").isNull())
    if symbols is not None:
        undated = undated.where(F.col("symbol").isin(symbols))
    fresh = known.unionByName(undated)
    return require_valid(fresh.drop("bar_date"))


def training_rows(bars: DataFrame, training_end: str, training_start: str | None = None,
                  minimum: int = K.MIN_TRAINING_ROWS) -> DataFrame:
    """Adjusted training bars of symbols with enough rows, rounded to six places."""
    rows = bars.where(F.col("bar_date") <= F.lit(training_end).cast("date"))
    if training_start:
        rows = rows.where(F.col("bar_date") >= F.lit(training_start).cast("date"))
    rows = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("symbol"))).where(F.col("n") >= minimum)
    factor = adjustment_factor(F.col("close"), F.col("adj_close"))
    return rows.select(
        "symbol", "bar_date",
        *[F.round(F.col(name) * factor, 6).alias(name) for name in ("open", "high", "low")],
        F.round("adj_close", 6).alias("close"), "volume")


def export_training(rows: DataFrame, path: str) -> None:
    """One folder of CSV files per symbol."""
    rows.repartition("symbol").sortWithinPartitions("symbol", "bar_date").write.mode("overwrite").partitionBy(
        "symbol").csv(path, header=True)


def training_forecasts(forecasts: DataFrame, training_end: str, horizon: int = K.FEATURE_HORIZON) -> DataFrame:
    """Forecast features whose origin lies in the training range, outcomes left out."""
    return forecasts.where((F.col("origin") <= F.lit(training_end).cast("date")) & (F.col("horizon") == horizon)).select(
        "symbol", F.col("origin").alias("as_of"), F.col("horizon").alias("horizon_days"), "model",
        predicted_return_pct(F.col("origin_price"), F.col("forecast_price")).alias("predicted_return_pct"))

