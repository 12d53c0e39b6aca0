"""Rules, proposals, ensembles and the signal screen."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numbers import clamp
from ..functions.trading import (expected_r, logit, normal_confidence, proposal_problems, reward_risk, sigmoid,
                                 worst_entry)
from ..functions.ordering import ordered_positions
from ..session import written
from . import features

PROPOSAL_COLUMNS = ["strategy", "symbol", "signal_date", "seq", "side", "entry_min", "entry_max", "stop_loss",
                    "target", "max_hold_days", "setup", "regime", "confidence"]

SIGNAL_TYPES = [(name, pa.date32() if name == "signal_date" else pa.int32() if name in ("seq", "max_hold_days") else pa.string()
                 if name in ("strategy", "symbol", "side", "setup", "regime") else pa.float64()) for name in PROPOSAL_COLUMNS]


# ---- rules ----------------------------------------------------------------------
def proposal(strategy: str, side: Column, entry_min: Column, entry_max: Column, stop_loss: Column, target: Column,
             max_hold_days: Column, setup: Column, regime: Column, confidence: Column) -> Column:
    """One proposal as a struct column."""
    return F.struct(
        F.lit(strategy).alias("strategy"), side.alias("side"), entry_min.alias("entry_min"),
        entry_max.alias("entry_max"), stop_loss.alias("stop_loss"), target.alias("target"),
        max_hold_days.cast("int").alias("max_hold_days"), setup.alias("setup"), regime.alias("regime"),
        confidence.alias("confidence"))


def signal_rule(featured: DataFrame, *rules: Column, lookback: int = K.LOOKBACK_BARS) -> DataFrame:
    """Proposals of Column rules (null = no signal) on bars with enough history: one narrow pass."""
    fired = F.explode(F.array_compact(F.array(*rules)))
    return featured.where(F.col("seq") >= lookback).select("symbol", "bar_date", "seq", fired.alias("p")).select(
        "p.strategy", "symbol", F.col("bar_date").alias("signal_date"), "seq",
        *[f"p.{name}" for name in PROPOSAL_COLUMNS[4:]])


def asked_bars(featured: DataFrame, *rules: Column, lookback: int = K.LOOKBACK_BARS) -> DataFrame:
    """Bars with the proposals that Column rules make on them (``asked``, an array per bar); rows of ``signal_rule`` where they were made."""
    return featured.withColumn("asked", F.array_compact(F.array(*[F.when(F.col("seq") >= lookback, rule) for rule in rules])))


def signal_rule_pandas(seq_bars: DataFrame, rule: Callable[[dict[str, np.ndarray]], dict | None], strategy: str,
                       lookback: int = K.LOOKBACK_BARS) -> DataFrame:
    """Proposals of a Python rule that sees the trailing ``lookback`` bars only.

    For rules that Columns cannot express.  Bars cross to Python once, in order of symbol and date; a task keeps the
    last ``lookback - 1`` bars of the symbol at hand, and each window is a read-only view into what it holds, so memory
    is a batch however long a history is.  A rule that raises counts as no signal.
    """
    fields = ["open", "high", "low", "close", "volume"]
    schema = ("strategy string, symbol string, signal_date date, seq int, side string, entry_min double, "
              "entry_max double, stop_loss double, target double, max_hold_days int, setup string, regime string, "
              "confidence double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, symbol_before = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            symbols, dates = batch.column(0).to_pylist(), batch.column(1)
            seq = batch.column(2).to_numpy()
            values = [column.to_numpy(zero_copy_only=False) for column in batch.columns[3:]]
            starts = [i for i in range(len(symbols)) if i == 0 or symbols[i] != symbols[i - 1]]
            found = []
            for start, end in zip(starts, [*starts[1:], len(symbols)], strict=True):
                parts = [x[start:end] for x in values]
                kept = 0
                if start == 0 and held is not None and symbols[0] == symbol_before:
                    kept = len(held[0])
                    parts = [np.concatenate((old, new)) for old, new in zip(held, parts, strict=True)]
                for x in parts:
                    x.flags.writeable = False
                views = [sliding_window_view(x, lookback) for x in parts] if len(parts[0]) >= lookback else []
                first = max(0, lookback - 1 - kept)  # the first new bar whose window is full
                for i in range(first, end - start) if views else ():
                    try:
                        answer = rule({name: view[i + kept - lookback + 1] for name, view in zip(fields, views, strict=True)})
                    except Exception:
                        answer = None
                    if answer:
                        found.append({"strategy": strategy, "symbol": symbols[start], "signal_date": dates[start + i].as_py(),
                                      "seq": int(seq[start + i]), **answer})
                held, symbol_before = [x[-(lookback - 1):] if lookback > 1 else x[:0] for x in parts], symbols[end - 1]
            columns = [pa.array([row[name] for row in found], kind) for name, kind in SIGNAL_TYPES]
            yield pa.RecordBatch.from_arrays(columns, names=PROPOSAL_COLUMNS)

    ordered = seq_bars.select("symbol", "bar_date", "seq", *fields).repartition("symbol").sortWithinPartitions("symbol", "bar_date")
    return ordered.mapInArrow(run, schema)


def validate_proposals(proposals: DataFrame) -> DataFrame:
    names = ["side", "entry_min", "entry_max", "stop_loss", "target", "max_hold_days", "setup", "regime"]
    return proposals.withColumn("problems", proposal_problems(*[F.col(name) for name in names]))


def ensemble_signals(*proposal_tables: DataFrame) -> DataFrame:
    """Proposals of several rules in one long table."""
    result = proposal_tables[0]
    for other in proposal_tables[1:]:
        result = result.unionByName(other)
    return result


# ---- screen ---------------------------------------------------------------------
def horizon(max_hold_days: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(K.MAX_SCREEN_HORIZON), F.floor(max_hold_days).cast("int")))


def forward_return(seq_bars: DataFrame, signals: DataFrame) -> DataFrame:
    """Return from the next open to the close ``horizon`` bars later, per long signal.

    Signals whose horizon runs past the data are dropped by the inner joins.
    """
    wanted = signals.where(F.col("side") == "long").withColumn("horizon", horizon(F.col("max_hold_days")))
    entry = seq_bars.select("symbol", (F.col("seq") - 1).alias("seq"), F.col("open").alias("_open"))
    last = seq_bars.select("symbol", F.col("seq").alias("_exit_seq"), F.col("close").alias("_close"))
    return (
        wanted.withColumn("_exit_seq", F.col("seq") + 1 + F.col("horizon"))
        .join(entry, ["symbol", "seq"]).join(last, ["symbol", "_exit_seq"])
        .withColumn("forward_return", F.try_divide("_close", "_open") - 1).drop("_exit_seq", "_open", "_close")
    )


def forward_baseline(seq_bars: DataFrame, horizons: list[int], lookback: int = K.LOOKBACK_BARS,
                     training_start: str | None = None) -> DataFrame:
    """Mean forward return per (symbol, horizon) over every eligible entry bar.

    All horizons come from one window pass (one ``lead`` each, one sort), then one aggregation.
    """
    frame = features.by_symbol()
    steps = [F.struct(F.lit(h).alias("horizon"), (F.try_divide(F.lead("close", h).over(frame), F.col("open")) - 1)
                      .alias("r")) for h in sorted(set(horizons))]
    rows = seq_bars.withColumn("_previous", F.lag("bar_date").over(frame)).withColumn("_steps", F.array(*steps))
    rows = rows.where(F.col("seq") > lookback)
    if training_start:
        rows = rows.where(F.col("_previous") >= F.lit(training_start).cast("date"))
    return rows.select("symbol", F.explode("_steps").alias("s")).where(F.col("s.r").isNotNull()).groupBy(
        "symbol", F.col("s.horizon").alias("horizon")).agg(
        F.avg("s.r").alias("baseline_return"), F.count(F.lit(1)).alias("entries"))


def signal_screen(seq_bars: DataFrame, signals: DataFrame, by: list[str] | None = None,
                  minimum: int = K.SCREEN_MIN_SIGNALS, lookback: int = K.LOOKBACK_BARS,
                  horizons: list[int] | None = None, training_start: str | None = None) -> DataFrame:
    """Do entries beat the same symbol's unconditional return over the same horizon?

    ``seq_bars`` and ``signals`` are cut to the training range by the caller.  ``horizons`` limits the
    baseline to those a rule can ask for; by default all 30 are prepared.
    """
    by = by or ["strategy"]
    if training_start:
        signals = signals.where(F.col("signal_date") >= F.lit(training_start).cast("date"))
    base = forward_baseline(seq_bars, horizons or list(range(1, K.MAX_SCREEN_HORIZON + 1)), lookback, training_start)
    scored = forward_return(seq_bars, signals).join(base, ["symbol", "horizon"])
    means = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("signals"), F.avg("forward_return").alias("actual_mean"),
        F.avg("baseline_return").alias("baseline_mean"))
    alpha = F.col("actual_mean") - F.col("baseline_mean")
    applies = F.col("signals") >= minimum
    return means.select(*by, "signals", "actual_mean", "baseline_mean", alpha.alias("alpha"),
                        applies.alias("applies"), (~applies | (alpha > 0)).alias("passed"))


# ---- ensembles ------------------------------------------------------------------
def symmetric_correlations(correlations: DataFrame) -> DataFrame:
    """Both directions of (a, b, r); an entry given as (a, b) outranks a given (b, a).

    Values are clamped to [-1, 1].
    """
    both = correlations.select("a", "b", "r", F.lit(0).alias("_way")).unionByName(
        correlations.select(F.col("b").alias("a"), F.col("a").alias("b"), "r", F.lit(1).alias("_way")))
    return both.where(F.col("r").isNotNull()).groupBy("a", "b").agg(
        clamp(F.min_by("r", "_way"), -1.0, 1.0).alias("r"))


def ensemble_weights(fired: DataFrame, correlations: DataFrame) -> DataFrame:
    """Independence weight of each fired strategy per (symbol, signal_date).

    The strategies that fired together travel as a short array on each row (bounded by the number of
    rules), so partners come from an explode instead of a self join on hot dates.
    """
    together = Window.partitionBy("symbol", "signal_date")
    partners = fired.withColumn("_others", F.collect_set("strategy").over(together))
    pairs = partners.select("symbol", "signal_date", "strategy", F.explode("_others").alias("b")).where(
        F.col("b") != F.col("strategy"))
    known = symmetric_correlations(correlations).select(F.col("a").alias("strategy"), "b", "r")
    penalty = pairs.join(known, ["strategy", "b"]).groupBy("symbol", "signal_date", "strategy").agg(
        F.sum(F.greatest(F.col("r"), F.lit(0.0))).alias("_penalty"))
    return fired.join(penalty, ["symbol", "signal_date", "strategy"], "left").withColumn(
        "weight", 1 / (1 + F.coalesce("_penalty", F.lit(0.0)))).drop("_penalty")


def ensemble_score(weighted: DataFrame) -> DataFrame:
    """Pooled score per (symbol, signal_date): log-odds of the reported confidences, weighted by
    independence, pushed away from the base rate by the effective number of votes."""
    confidence = normal_confidence(F.col("confidence"))
    reported = confidence.isNotNull()
    pooled = weighted.groupBy("symbol", "signal_date").agg(
        F.count(F.lit(1)).alias("strategies"), F.sum("weight").alias("votes"),
        F.sum(F.when(reported, F.col("weight"))).alias("_w"),
        F.sum(F.when(reported, F.col("weight") * logit(confidence))).alias("_wl"))
    anchor = logit(F.lit(K.BASE_RATE))
    mean = F.coalesce(F.try_divide("_wl", "_w"), anchor)
    evidence = anchor + (mean - anchor) * (1 + F.lit(K.ENSEMBLE_LAMBDA) * (F.col("votes") - 1))
    return pooled.withColumn("evidence", evidence).withColumn(
        "score", clamp(sigmoid(F.col("evidence")), 0.0, 1.0)).drop("_w", "_wl")


def proposal_economics(proposals: DataFrame) -> DataFrame:
    """Worst-case entry, risk and both readings of reward:risk."""
    side, stop, target = F.col("side"), F.col("stop_loss"), F.col("target")
    entry = worst_entry(side, F.col("entry_min"), F.col("entry_max"))
    return proposals.withColumn("worst_entry", entry).withColumn(
        "risk", F.when(side == "long", entry - stop).otherwise(stop - entry)).withColumn(
        "reward_risk", reward_risk(side, entry, stop, target, float("inf"))).withColumn(
        "reward_risk_tie", reward_risk(side, entry, stop, target, 0.0))


def ensemble_representative(proposals: DataFrame) -> DataFrame:
    """The proposal that stands for all fired ones: reported and higher confidence, then reward:risk."""
    rated = proposal_economics(proposals).withColumn("_c", normal_confidence(F.col("confidence")))
    names = [name for name in rated.columns if name not in ("symbol", "signal_date", "_c")]
    # min_by over a struct key needs ascending parts, so wanted-first values are negated.
    key = F.struct(F.col("_c").isNull(), -F.coalesce("_c", F.lit(0.0)), -F.col("reward_risk_tie"), F.col("strategy"))
    return rated.groupBy("symbol", "signal_date").agg(F.min_by(F.struct(*names), key).alias("r")).select(
        "symbol", "signal_date", "r.*")


def graded_candidates(fired: DataFrame, correlations: DataFrame) -> DataFrame:
    """Representative proposal with pooled score and expectancy per (symbol, signal_date)."""
    scores = ensemble_score(ensemble_weights(fired, correlations))
    chosen = ensemble_representative(fired).join(scores, ["symbol", "signal_date"])
    return chosen.where(F.col("risk") > 0).withColumn("expected_r", expected_r(F.col("score"), F.col("reward_risk")))


def daily_top_k(candidates: DataFrame, k: int, liquidity_floor: float = 0.0) -> DataFrame:
    """The ``k`` best candidates of each date.

    Candidates without a finite expectancy rank at the upper median of the day's known ones.  The
    median is a rank over (date, expectancy) taken with range-partitioned positions, so a date with
    very many candidates is not sorted in one task; the top k uses Spark's window group limit.
    """
    if liquidity_floor > 0:
        candidates = candidates.where(F.col("traded_value") >= F.lit(float(liquidity_floor)))
    # Read three times below, so the graded candidates are cut from their lineage once.
    candidates = written(candidates, "candidates")
    known = candidates.where(F.col("expected_r").isNotNull()).select("signal_date", "expected_r")
    middle = ordered_positions(known, ["signal_date"], ["expected_r"]).where(
        F.col("pos") == F.floor(F.col("group_rows") / 2)).select("signal_date", F.col("expected_r").alias("_median"))
    ranked = candidates.join(middle, "signal_date", "left").withColumn(
        "rank_r", F.coalesce("expected_r", "_median", F.lit(0.0))).drop("_median")
    order = Window.partitionBy("signal_date").orderBy(
        F.desc("rank_r"), F.desc("evidence"), F.desc("votes"), F.desc("traded_value"), "symbol")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
