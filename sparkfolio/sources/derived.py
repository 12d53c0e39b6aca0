"""Working tables that Spark derives from the given relational and event tables.

No market data ships with the library, so bars are built from ``lineitem``: supplier is the
symbol, ship date the bar.  The definitions decide shape only; every operator takes any table
with the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numbers import cents


SPLIT_DATE = "1997-07-01"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _symbol(key: str) -> Column:
    return F.concat(F.lit("S"), F.lpad(F.col(key).cast("string"), 5, "0"))


def _bars(spark: SparkSession, folder: str, price: Column, split: bool = False) -> DataFrame:
    """Line items cross once, by symbol, and are grouped where they lie: nearly each is a bar of its own, so combining
    them before would sort them all for nothing.  Whoever wants bars by symbol finds them so."""
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    items = table(spark, folder, "lineitem").select(
        _symbol("l_suppkey").alias("symbol"),
        F.to_date("l_shipdate").alias("bar_date"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
    ).repartition("symbol")
    bars = items.groupBy("symbol", "bar_date").agg(
        F.min_by(price, order).alias("open"),
        F.max(price + F.col("l_quantity") / 50).alias("high"),
        F.min(price - 20 * F.col("l_tax")).alias("low"),
        F.max_by(price, order).alias("close"),
        F.min("l_discount").alias("cut"),
        F.sum("l_quantity").cast("bigint").alias("volume"),
    )
    raw = F.when(F.substring("symbol", -1, 1).isin("3", "8") & (F.col("bar_date") < F.lit(SPLIT_DATE).cast("date")), 2.0).otherwise(1.0)
    raw = raw if split else F.lit(1.0)
    return bars.select(
        "symbol", "bar_date", *[(F.col(name) * raw).alias(name) for name in ("open", "high", "low", "close")],
        (F.col("close") * (1 - F.lit(0.5) * F.col("cut"))).alias("adj_close"), "volume",
    )


def bars(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (symbol, bar_date): smooth prices around 100.

    Symbols that end in 3 or 8 split two for one: raw prices before the split are twice as high, adjusted closes aren't.
    """
    return _bars(spark, folder, 100 * (1 + F.col("l_discount") - F.col("l_tax")) + F.col("l_quantity") / 100, split=True)


def raw_bars(spark: SparkSession, folder: str) -> DataFrame:
    """As ``bars`` with unit prices, which jump a lot (for quality rules)."""
    return _bars(spark, folder, F.col("l_extendedprice") / F.col("l_quantity"))


def bar_days(spark: SparkSession, folder: str) -> DataFrame:
    """Dates of all bars, with repeats: each line item has a bar, so no bar has to be made for a calendar."""
    return table(spark, folder, "lineitem").select(F.to_date("l_shipdate").alias("bar_date"))


def provider_rows(bar_table: DataFrame) -> DataFrame:
    """Untrusted rows as a provider would send them: all bars, and broken copies of some."""
    good = bar_table.select(
        "symbol", F.date_format("bar_date", "yyyy-MM-dd").alias("date"), "open", "high", "low", "close", "adj_close",
        F.col("volume").cast("double").alias("volume"), F.dayofmonth("bar_date").alias("day"),
    )
    day = F.col("day")
    broken = good.where(day >= 24).select(
        F.when(day == 31, "").otherwise(F.col("symbol")).alias("symbol"),
        F.when(day == 27, F.concat(F.substring("date", 1, 5), F.regexp_replace(F.substring("date", 6, 5), "^0", "")))
        .when(day == 24, F.concat(F.substring("date", 1, 8), F.lit("39")))
        .otherwise(F.col("date")).alias("date"),
        "open",
        F.when(day == 30, F.col("low") - 1).otherwise(F.col("high")).alias("high"),
        "low",
        F.when(day == 29, F.lit(0.0)).otherwise(F.col("close")).alias("close"),
        "adj_close",
        F.when(day == 26, F.col("volume") + F.lit(0.5)).when(day == 25, -F.col("volume"))
        .otherwise(F.col("volume")).alias("volume"),
        "day",
    )
    return good.unionByName(broken).drop("day")


def market(bar_table: DataFrame) -> DataFrame:
    """Price-weighted index and volatility closes per weekday (role, bar_date, close)."""
    daily = bar_table.groupBy("bar_date").agg(
        F.round(F.sum("close"), 6).alias("index"),
        F.round(F.max("high") - F.min("low"), 6).alias("volatility"),
    ).where(F.weekday("bar_date") < 5)
    return daily.unpivot("bar_date", ["index", "volatility"], "role", "close").select("role", "bar_date", "close")


def calendar_folds(bar_table: DataFrame) -> DataFrame:
    """Yearly folds from the first year of the bars to the last, numbered from 1995."""
    years = bar_table.agg(F.min(F.year("bar_date")).alias("a"), F.max(F.year("bar_date")).alias("b")).where("a IS NOT NULL").select(
        F.explode(F.sequence("a", "b")).alias("y"))
    return years.select(
        F.concat(F.lit("fold-"), (F.col("y") - 1994).cast("string")).alias("fold"),
        F.make_date("y", F.lit(1), F.lit(1)).alias("start"),
        F.make_date("y", F.lit(12), F.lit(31)).alias("end"),
    )


def trades(spark: SparkSession, folder: str) -> DataFrame:
    """Closed trades of many strategies (brand = strategy)."""
    item = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_discount",
        "l_returnflag", "l_linestatus")
    order = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    part = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type")
    joined = item.join(order, item.l_orderkey == order.o_orderkey).join(part, item.l_partkey == part.p_partkey)
    ship, placed = F.to_date("l_shipdate"), F.to_date("o_orderdate")
    return joined.select(
        F.col("p_brand").alias("strategy"),
        F.col("p_type").alias("family"),
        _symbol("l_suppkey").alias("symbol"),
        F.concat(F.lit("fold-"), (F.year(ship) - 1994).cast("string")).alias("fold"),
        F.least(ship, placed).alias("entry_date"),
        F.greatest(ship, placed).alias("exit_date"),
        (F.col("l_extendedprice") * (F.col("l_discount") - F.lit(0.05)) / 1000).alias("profit"),
        F.col("l_returnflag").alias("setup"),
        F.col("l_linestatus").alias("regime"),
    )


def cast(trade_table: DataFrame) -> DataFrame:
    """Trades of all strategies and of six made from them, so that every verdict occurs: a copy, a near copy that shares no
    trade, two winners of other families, one that trades in three folds only, and one that a symbol carries."""
    profit, symbol = F.col("profit"), F.col("symbol")
    lucky = F.when((symbol == "S00001") & (profit > 0), profit * 1000).otherwise(profit)
    made = [("Brand#98", "COPY", "Brand#11", profit), ("Brand#97", "SHIFT", "Brand#12", profit * F.lit(1.01)),
            ("Strong#6", "STRONG A", "Brand#11", F.abs("profit")), ("Strong#9", "STRONG B", "Brand#13", F.abs("profit")),
            ("Short#5", "SHORT", "Brand#15", profit), ("Lucky#8", "LUCKY", "Brand#25", lucky)]
    row = lambda name, family, base, value: F.when(F.col("strategy") == base, F.struct(
        F.lit(name).alias("name"), F.lit(family).alias("family"), value.alias("profit")))
    extra = trade_table.withColumn("m", F.explode(F.array_compact(F.array(*[row(*x) for x in made])))).select(
        F.col("m.name").alias("strategy"), F.col("m.family").alias("family"), "symbol", "fold",
        F.when(F.col("m.name") == "Brand#97", F.date_sub("entry_date", 1)).otherwise(F.col("entry_date")).alias("entry_date"),
        "exit_date", F.col("m.profit").alias("profit"), "setup", "regime")
    return trade_table.unionByName(extra.where((F.col("strategy") != "Short#5") | F.col("fold").isin("fold-1", "fold-2", "fold-3")))


def fold_scores(trade_table: DataFrame) -> DataFrame:
    return trade_table.groupBy("strategy", "fold").agg(F.round(F.sum("profit"), 6).alias("score"))


def daily_equity(trade_table: DataFrame, initial: float = K.INITIAL_CAPITAL) -> DataFrame:
    """Capital per (strategy, exit date), to the cent."""
    from ..operators.outcomes import equity_curve

    return equity_curve(trade_table, initial).select("strategy", "bar_date", cents(F.col("equity")).alias("capital"))


def calls(events: DataFrame) -> DataFrame:
    """Start and end records of calls: even event ids start call id/2, odd ones end it.

    Sign-ups are no call starts, so some ends have none.
    """
    kind = F.when(F.col("event_id") % 2 == 0, "start").otherwise("end")
    return events.select(
        F.floor(F.col("event_id") / 2).alias("call_id"), kind.alias("kind"), "ts",
        F.col("event_type").alias("tool"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
        F.col("props").alias("text"),
    ).where((F.col("kind") == "end") | (F.col("tool") != "signup"))


def trials(events: DataFrame) -> DataFrame:
    """Trial ledger rows; users repeat run records."""
    return events.select(
        "ts", F.col("event_type").alias("source"), F.col("value").alias("score"),
        (F.col("value") > F.lit(20.0)).alias("accepted"),
        F.concat(F.lit("run-"), F.col("user_id").cast("string"), F.lit("-"), F.col("event_type"), F.lit("-"), F.date_format("ts", "yyyyMMddHH"))
        .alias("run_record"),
    )
