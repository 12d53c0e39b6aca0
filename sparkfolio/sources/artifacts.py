"""Evaluation artifacts and the trial ledger as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import ordered_positions

LEDGER_SCHEMA = """
    timestamp string, source string, score double, error string, accepted boolean, hypothesisId string,
    cycleId string, runRecord string, artifactFile string
"""


def write_artifacts(trades: DataFrame, fold_results: DataFrame, scores: DataFrame, path: str,
                    part_rows: int = 10_000) -> None:
    """JSON rows of a strategy, one per fold and part of at most ``part_rows`` trades.

    A fold with very many trades is cut by exact position, so no nested array grows with the data.
    The fold's segment is on its first part; readers see a strategy as the union of its rows.
    """
    order = ["exit_date", "entry_date", "symbol", "profit"]
    placed = ordered_positions(trades.select("strategy", "fold", *order), ["strategy", "fold"], order)
    nested = placed.groupBy("strategy", "fold", F.floor(F.col("pos") / part_rows).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct(
            F.col("symbol"), F.col("fold"), F.col("entry_date").cast("string").alias("entryDate"),
            F.col("exit_date").cast("string").alias("exitDate"), F.round("profit", 2).alias("profit")))).alias("trades"))
    segment = F.array(F.struct(F.col("fold").alias("name"), F.lit("fold").alias("group"),
                               F.col("profit").alias("value"), (F.col("profit") > 0).alias("passed")))
    declared = F.array(F.struct(F.col("fold").alias("name"), F.col("start").cast("string").alias("start"),
                                F.col("end").cast("string").alias("end")))
    # A row of its own for each part, so that the nested trades are joined where they were nested.
    parts = trades.groupBy("strategy", "fold").agg(F.ceil(F.count(F.lit(1)) / part_rows).alias("_parts"))
    heads = fold_results.select("strategy", "fold", "profit", "start", "end").join(scores, "strategy").join(
        parts, ["strategy", "fold"], "left").withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("_parts"), F.lit(1)) - 1)))
    first = F.col("part") == 0
    rows = heads.join(nested, ["strategy", "fold", "part"], "left").select(
        "strategy",
        F.struct(F.lit("walkForwardScore").alias("name"), F.round("score", 2).alias("value"),
                 F.lit("maximize").alias("direction")).alias("primary"),
        F.when(first, segment).alias("segments"), F.when(first, declared).alias("folds"),
        F.coalesce("trades", F.array().cast(nested.schema["trades"].dataType)).alias("trades"))
    rows.write.mode("overwrite").json(path)


LISTS = ("trades", "segments", "folds")


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Artifact lines as (strategy, body), ``body`` a VARIANT: members are judged one by one when they are taken out.

    A line that is no JSON object gives a row of nulls, so it can be counted; ``strategy`` must be text.
    """
    body = F.try_parse_json("value")
    return spark.read.text(path).select(body.alias("body")).select(
        _text("body", "strategy").alias("strategy"), F.when(F.schema_of_variant("body").startswith("OBJECT"), F.col("body")).alias("body"))


def _kind(member: str, name: str) -> Column:
    """JSON type of a member's field: STRING, BIGINT, DOUBLE, DECIMAL(..), BOOLEAN, VOID, ARRAY<..>, OBJECT<..>, or null."""
    return F.schema_of_variant(F.try_variant_get(member, f"$.{name}", "variant"))


def _text(member: str, name: str) -> Column:
    """A field that is text, else null: numbers are not read as text."""
    return F.when(_kind(member, name) == "STRING", F.try_variant_get(member, f"$.{name}", "string"))


def _number(member: str, name: str) -> Column:
    """A field that is a number, else null: text is not read as a number."""
    return F.when(_kind(member, name).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(member, f"$.{name}", "double"))


def _members(artifacts: DataFrame, name: str) -> DataFrame:
    """A row per member of a list; a list of another type has none."""
    return artifacts.select("strategy", F.explode(F.try_variant_get("body", f"$.{name}", "array<variant>")).alias("m"))


def _trade() -> Column:
    return _text("m", "fold").isNotNull() & _number("m", "profit").isNotNull()


def _segment() -> Column:
    return F.coalesce((_text("m", "group") == "fold") & _text("m", "name").isNotNull() & _number("m", "value").isNotNull(), F.lit(False))


def _fold_name() -> Column:
    return F.try_variant_get("m", "$.name", "string")  # names may be numbers here, read as text


def _fold() -> Column:
    return F.coalesce(_fold_name() != "", F.lit(False))


def artifact_trades(artifacts: DataFrame) -> DataFrame:
    """Trades with a fold and a numeric profit; a missing symbol reads ``unknown``."""
    return _members(artifacts, "trades").where(_trade()).select(
        "strategy", F.coalesce(_text("m", "symbol"), F.lit("unknown")).alias("symbol"), _text("m", "fold").alias("fold"),
        F.try_to_date(_text("m", "entryDate")).alias("entry_date"), F.try_to_date(_text("m", "exitDate")).alias("exit_date"),
        _number("m", "profit").alias("profit"))


def artifact_segments(artifacts: DataFrame) -> DataFrame:
    """Fold segments with a name and a numeric value."""
    return _members(artifacts, "segments").where(_segment()).select(
        "strategy", _text("m", "name").alias("fold"), _number("m", "value").alias("score"))


def artifact_folds(artifacts: DataFrame) -> DataFrame:
    """Declared folds with a name."""
    return _members(artifacts, "folds").where(_fold()).select(
        "strategy", _fold_name().alias("fold"), F.try_to_date(_text("m", "start")).alias("start"),
        F.try_to_date(_text("m", "end")).alias("end"))


def artifact_losses(artifacts: DataFrame) -> DataFrame:
    """(strategy, list, members, dropped): how many members of each list are kept and how many are malformed.

    A list of another type counts as one dropped member, and so does a line that is no object (list ``line``, no strategy).
    """
    rows = None
    for name, good in zip(LISTS, (_trade(), _segment(), _fold()), strict=True):
        kind = _kind("body", name)
        broken = artifacts.where(kind.isNotNull() & ~kind.startswith("ARRAY") & (kind != "VOID")).select("strategy", F.lit(False).alias("ok"))
        part = _members(artifacts, name).select("strategy", good.alias("ok")).unionByName(broken).withColumn("list", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    lines = artifacts.where(F.col("body").isNull()).select("strategy", F.lit(False).alias("ok"), F.lit("line").alias("list"))
    return rows.unionByName(lines).groupBy("strategy", "list").agg(
        F.count_if("ok").alias("members"), F.count_if(~F.col("ok")).alias("dropped"))


def append_trials(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER_SCHEMA).json(path)


def trial_ledger(ledger: DataFrame, runs: DataFrame) -> DataFrame:
    """Ledger rows plus run records that the ledger does not know yet.

    Runs without time, score or decision are dropped.
    """
    known = ledger.where(F.col("run_record").isNotNull()).select("run_record").distinct()
    fresh = runs.where(F.col("ts").isNotNull() & F.col("score").isNotNull() & F.col("accepted").isNotNull()).join(
        known, "run_record", "left_anti")
    return ledger.unionByName(fresh.select(*ledger.columns))


def trial_summary(trials: DataFrame) -> DataFrame:
    """Trials and accepted ones per source, and in total (source null)."""
    return trials.rollup("source").agg(
        F.count(F.lit(1)).alias("trials"), F.count_if("accepted").alias("accepted"))
