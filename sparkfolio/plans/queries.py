"""Registered queries: one per operator, each over the whole derived tables."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import trading as X
from ..functions.numbers import cents
from ..functions.ordering import ordered_positions
from ..functions.random import with_uniform
from ..operators import bars as B
from ..operators import context as C
from ..operators import evidence as E
from ..operators import features as W
from ..operators import folds as D
from ..operators import forecasts as P
from ..operators import outcomes as O
from ..operators import resample as Z
from ..operators import risk as Q
from ..operators import scoring as S
from ..operators import signals as G
from ..session import record_written, shared_folder, stored, written
from ..sources import artifacts, derived, forecast_store, prices
from ..sources.price_table import PriceTable
from ..streaming import streams
from . import rules
from .evaluate import adjusted_bars
from .evaluate import evaluate as evaluate_flow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TRAINING_END = "1998-12-31"
MODELS = ["unchanged", "momentum"]


def query(build: Callable[["Tables"], DataFrame]) -> Callable[["Tables"], DataFrame]:
    """Register ``build`` under its name; double columns are rounded for comparison, halves moved up as in the SQL."""
    places = getattr(build, "places", {})
    QUERIES[build.__name__] = lambda spark, folder: tidy(build(Tables(spark, folder)), places)
    return build


EXACT = -1  # compared as it is
PRICES = dict(open=EXACT, high=EXACT, low=EXACT, close=EXACT, adj_close=EXACT)


def precise(**places: int):
    def mark(build):
        build.places = places
        return build
    return mark


def tidy(df: DataFrame, places: dict[str, int]) -> DataFrame:
    return df.select([
        (F.round(F.col(f"`{f.name}`") + F.lit(float(f"3e-{places.get(f.name, 6) + 3}")), places.get(f.name, 6)) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) and places.get(f.name) != EXACT else F.col(f"`{f.name}`") for f in df.schema.fields])


def by_symbol(bars: DataFrame) -> DataFrame:
    """Bars of a symbol together and in date order (at most one row per day each)."""
    return bars.repartition("symbol").sortWithinPartitions("symbol", "bar_date")


class Tables:
    """Derived tables of one data folder, built on demand."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def kept(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return stored(self.spark, self.folder, name, build)

    def raw(self, name: str) -> DataFrame:
        return derived.table(self.spark, self.folder, name)

    @property
    def bars(self) -> DataFrame:
        return self.kept("bars", lambda: by_symbol(derived.bars(self.spark, self.folder)))

    @property
    def raw_bars(self) -> DataFrame:
        return self.kept("raw_bars", lambda: by_symbol(derived.raw_bars(self.spark, self.folder)))

    @property
    def adjusted(self) -> DataFrame:
        """Bars as rules, outcomes, context and forecasts see them."""
        return adjusted_bars(self.bars)

    @property
    def seq(self) -> DataFrame:
        return W.bar_seq(self.adjusted)

    @property
    def seq_where_made(self) -> DataFrame:
        """``seq`` made where line items lie by symbol, for a query that does all of its work there and stores no bars."""
        return W.bar_seq(adjusted_bars(derived.bars(self.spark, self.folder)))

    @property
    def market(self) -> DataFrame:
        return derived.market(self.adjusted)

    @property
    def folds(self) -> DataFrame:
        return self.kept("folds", lambda: derived.calendar_folds(derived.bar_days(self.spark, self.folder)))

    @property
    def signals(self) -> DataFrame:
        return self.kept("signals", lambda: rules.example_signals(self.adjusted))

    @property
    def outcomes(self) -> DataFrame:
        """Trades of the example rules, made where the bars of a symbol lie: as ``trade_outcomes`` of ``signals``, without its joins."""
        return self.kept("outcomes", lambda: O.asked_outcomes(rules.asked(self.adjusted), rules.LONGEST_HOLD))

    @property
    def longs(self) -> DataFrame:
        return self.signals.where(F.col("side") == "long")

    @property
    def trades(self) -> DataFrame:
        return self.kept("trades", lambda: derived.trades(self.spark, self.folder))

    @property
    def equity(self) -> DataFrame:
        return derived.daily_equity(self.trades)

    @property
    def fold_scores(self) -> DataFrame:
        return derived.fold_scores(self.trades)

    @property
    def scores(self) -> DataFrame:
        return S.profile_score(self.trades, self.equity)

    @property
    def fold_drawdowns(self) -> DataFrame:
        keys = ["strategy", "fold"]


        curve = O.equity_curve(self.trades, keys=keys).select(*keys, "bar_date", cents(F.col("equity")).alias("capital"))
        return Q.drawdown_score(curve, keys=keys).select(*keys, "drawdown_pct")

    @property
    def fold_results(self) -> DataFrame:
        return self.fold_scores.withColumn("profit", F.col("score")).join(self.fold_drawdowns, ["strategy", "fold"])

    @property
    def periods(self) -> DataFrame:
        return D.period_profits(self.equity, self.folds)

    @property
    def full_period(self) -> DataFrame:
        return self.scores.join(Q.drawdown_score(self.equity), "strategy").select(
            "strategy", "earned_profit", "drawdown_pct")

    @property
    def counts(self) -> DataFrame:
        return S.fold_trade_counts(self.trades, self.folds)

    @property
    def verdicts(self) -> DataFrame:
        return E.audit_verdict(E.audit_sample(self.trades, self.folds), E.audit_concentration(self.trades, self.periods))

    @property
    def scored(self) -> DataFrame:
        families = self.trades.groupBy("strategy").agg(F.min("family").alias("family"))
        return self.scores.select("strategy", "score").join(families, "strategy").join(self.verdicts, "strategy")

    @property
    def pairs(self) -> DataFrame:
        return E.pair_lineages(E.fold_vectors(self.fold_scores))

    @property
    def rule_correlations(self) -> DataFrame:
        pairs = [("deep", "dip", 0.6), ("turn", "dip", 0.3), ("turn", "deep", -0.2)]
        return self.spark.createDataFrame(pairs, "a string, b string, r double")

    @property
    def origins(self) -> DataFrame:
        return P.rolling_windows(self.seq, 64, 5, K.FORECAST_HORIZONS)

    @property
    def targets(self) -> DataFrame:
        return P.forecast_targets(self.seq, self.origins, K.FORECAST_HORIZONS)

    @property
    def baselines(self) -> DataFrame:
        return P.baseline_unchanged(self.targets).unionByName(P.baseline_momentum(self.targets, self.seq))

    @property
    def empirical(self) -> DataFrame:
        windows = P.window_history(self.seq, self.origins, 64)
        scored = P.forecast_scorer(windows, P.empirical_quantiles, "empirical", K.FORECAST_HORIZONS)
        return P.scored_forecasts(self.targets, scored)

    @property
    def forecasts(self) -> DataFrame:
        return self.kept("forecasts", lambda: self.baselines.unionByName(self.empirical))

    @property
    def candidates(self) -> DataFrame:
        graded = G.graded_candidates(self.longs, self.rule_correlations)
        liquidity = W.rolling_traded_value(self.adjusted).select(
            "symbol", F.col("bar_date").alias("signal_date"), "traded_value")
        return graded.join(liquidity, ["symbol", "signal_date"])

    @property
    def grid(self) -> DataFrame:
        return rules.grid_scores(self.adjusted, Z.parameter_grid(self.spark, rules.GRID), TRAINING_END)

    @property
    def training(self) -> DataFrame:
        return W.bar_seq(self.adjusted.where(F.col("bar_date") <= F.lit(TRAINING_END).cast("date")))

    @property
    def ranges(self) -> DataFrame:
        return self.folds

    def folder_for(self, name: str) -> str:
        """A fresh folder in the shared checkpoint folder."""
        root = shared_folder(self.spark)
        return record_written(self.spark, f"{root}/{name}-{uuid.uuid4().hex}")


class CastTables(Tables):
    """Tables whose trades hold more kinds of strategies (see ``derived.cast``)."""

    @property
    def trades(self) -> DataFrame:
        return self.kept("cast", lambda: derived.cast(Tables(self.spark, self.folder).trades))


def with_cast(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    @functools.wraps(build)
    def run(t: Tables) -> DataFrame:
        return build(CastTables(t.spark, t.folder))
    return run


# ---- sources ----------------------------------------------------------------------
@query
@precise(**PRICES)
def read_prices(t: Tables) -> DataFrame:
    return prices.read_prices(t.bars, ["S00001", "S00002", "S00003", "S00005", "S00008"])


@query
@precise(**PRICES)
def read_prices_csv(t: Tables) -> DataFrame:
    path = t.folder_for("csv")
    derived.provider_rows(t.bars).withColumn("provider_note", F.lit('a "note", kept out')).select(
        "volume", "provider_note", *K.CSV_COLUMNS[:-1]).write.csv(path, header=True, quote='"', escape='"')
    return prices.valid_rows(prices.read_prices_csv(t.spark, path))


@query
def read_universe(t: Tables) -> DataFrame:
    path = t.folder_for("universe")
    t.raw("supplier").select(
        F.concat(F.lit("S"), F.lpad(F.col("s_suppkey").cast("string"), 5, "0")).alias("symbol"), F.col("s_name").alias("name"),
        F.col("s_nationkey").cast("string").alias("sector"),
        F.when(F.col("s_acctbal") < 0, K.UNAVAILABLE_STATUS).otherwise("member").alias("status")).write.csv(path, header=True)
    return prices.read_universe(t.spark, path)


@query
@precise(**PRICES)
def upsert_prices(t: Tables) -> DataFrame:
    known = t.bars.select("symbol", "bar_date")
    late = t.raw_bars.where(F.col("bar_date") >= F.lit("2001-01-01").cast("date"))
    return prices.upsert_prices(t.bars, late.join(known, ["symbol", "bar_date"], "left_semi"))


@query
@precise(**PRICES)
def sync_newer_rows(t: Tables) -> DataFrame:
    target = t.bars.where((F.col("bar_date") < F.lit("2000-01-01").cast("date")) & (F.col("symbol") >= "S00010"))
    source = t.bars.select("symbol", F.date_format("bar_date", "yyyy-MM-dd").alias("date"), *K.PRICE_COLUMNS[2:7],
                           F.col("volume").cast("double").alias("volume"))
    return prices.sync_newer_rows(source, target, after="1999-06-30")


def _as_sent(bars: DataFrame) -> DataFrame:
    """Bars as a provider would send them: dates as text, volumes as numbers."""
    return bars.select("symbol", F.date_format("bar_date", "yyyy-MM-dd").alias("date"), *K.PRICE_COLUMNS[2:7],
                       F.col("volume").cast("double").alias("volume"))


def _breaks(write: Callable[[], object]) -> None:
    """Run a write that has to fail."""
    try:
        write()
    except (PySparkException, Py4JJavaError):
        return
    raise AssertionError("a write with a bad row was accepted")


def _one_bad_row(rows: DataFrame) -> DataFrame:
    """The rows, the first of them by symbol and date with a negative close."""
    first = rows.agg(F.min(F.struct("symbol", "date")).alias("f"))
    bad = (F.col("symbol") == F.col("f.symbol")) & (F.col("date") == F.col("f.date"))
    return rows.join(F.broadcast(first)).withColumn("close", F.when(bad, -F.col("close")).otherwise(F.col("close"))).drop("f")


@query
@precise(**PRICES)
def upsert_prices_table(t: Tables) -> DataFrame:
    """A batch with a bad row breaks halfway and leaves the version before; the good batch is the next version."""
    table = PriceTable(t.spark, t.folder_for("price-table"))
    table.overwrite(t.bars)
    late = t.raw_bars.where((F.col("bar_date") >= F.lit("2001-01-01").cast("date")) & (F.col("high") >= F.col("low")) & (F.col("low") > 0)).join(
        t.bars.select("symbol", "bar_date"), ["symbol", "bar_date"], "left_semi")
    _breaks(lambda: table.upsert(prices.require_valid(prices.with_problems(_one_bad_row(_as_sent(late))))))
    before = table.read()
    table.upsert(prices.require_valid(prices.with_problems(_as_sent(late))))
    return before.withColumn("state", F.lit("before")).unionByName(table.read().withColumn("state", F.lit("after")))


@query
@precise(**PRICES)
def sync_prices_table(t: Tables) -> DataFrame:
    """Newer provider rows reach the table all at once: first a source with a bad new row, then a good one, then a merge."""
    table = PriceTable(t.spark, t.folder_for("price-table"))
    table.overwrite(t.bars.where((F.col("bar_date") < F.lit("2000-01-01").cast("date")) & (F.col("symbol") >= "S00010")))
    source = _as_sent(t.bars)
    newest = source.where(F.col("date") >= "2001-01-01")
    _breaks(lambda: table.upsert(prices.sync_newer_rows(_one_bad_row(newest), table.read())))
    before = table.read()
    table.upsert(prices.sync_newer_rows(source, table.read(), after="1999-06-30"))
    table.compact()
    return before.withColumn("state", F.lit("before")).unionByName(table.read().withColumn("state", F.lit("after")))


@query
def export_training(t: Tables) -> DataFrame:
    """Through the CSV files of each symbol and back."""
    path = t.folder_for("training")
    prices.export_training(prices.training_rows(t.bars, "2001-06-30"), path)
    kinds = "bar_date date, open double, high double, low double, close double, volume bigint, symbol string"
    return t.spark.read.schema(kinds).csv(path, header=True)


@query
def export_training_forecasts(t: Tables) -> DataFrame:
    return prices.training_forecasts(t.forecasts, TRAINING_END)


def _artifact_files(t: Tables) -> DataFrame:
    """Artifacts of all strategies, a broken one of each, and lines that are no JSON."""
    path = t.folder_for("artifacts")
    artifacts.write_artifacts(t.trades, t.fold_results.join(t.folds, "fold"), t.scores.select("strategy", "score"), path)
    member = lambda **values: F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in values.items()]))
    listed = F.concat_ws(",", member(symbol=5, fold="odd", profit=1.5), member(fold="odd", profit="1.5"), member(fold=3, profit=1.0), F.lit("7"))
    line = F.concat(F.lit('{"strategy":"'), F.col("strategy"), F.lit('","trades":['), listed, F.lit('],"segments":"none"}'))
    names = t.trades.select("strategy").distinct()
    names.select(line.alias("value")).union(names.select(F.concat(F.lit('{"strategy": "'), "strategy"))).write.mode("append").text(path)
    return artifacts.read_artifacts(t.spark, path)


@query
def read_artifacts(t: Tables) -> DataFrame:
    return artifacts.artifact_trades(_artifact_files(t))


@query
def artifact_losses(t: Tables) -> DataFrame:
    """Members kept and dropped by list, over whole and broken artifacts."""
    return artifacts.artifact_losses(_artifact_files(t))


@query
def write_artifact(t: Tables) -> DataFrame:
    path = t.folder_for("artifacts")
    artifacts.write_artifacts(t.trades, t.fold_results.join(t.folds, "fold"), t.scores.select("strategy", "score"), path)
    return artifacts.artifact_segments(artifacts.read_artifacts(t.spark, path))


@query
def trial_ledger(t: Tables) -> DataFrame:
    """Appended to the ledger's files in two turns, read back, and completed with run records that it doesn't hold."""
    path, rows = t.folder_for("ledger"), derived.trials(t.raw("events"))
    at = lambda day: F.lit(day).cast("timestamp")
    lines = rows.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"), "source", "score", "accepted",
                        F.col("run_record").alias("runRecord"), F.col("ts"))
    for first, last in (("1970-01-01", "2024-01-08"), ("2024-01-08", "2024-01-15")):
        artifacts.append_trials(lines.where((F.col("ts") >= at(first)) & (F.col("ts") < at(last))).drop("ts"), path)
    ledger = artifacts.read_ledger(t.spark, path).select(
        F.col("timestamp").cast(rows.schema["ts"].dataType).alias("ts"), "source", "score", "accepted", F.col("runRecord").alias("run_record"))
    return artifacts.trial_ledger(ledger, rows.where(F.col("ts") >= at("2024-01-10")))


@query
def forecast_store_batches(t: Tables) -> DataFrame:
    path = t.folder_for("store")
    rows = written(t.baselines.withColumn("campaign", F.lit("c1")), "batches")  # read five times below
    forecast_store.store_batch(t.spark, path, rows.where(F.col("model") == "unchanged"))
    forecast_store.store_batch(t.spark, path, rows)
    forecast_store.store_batch(t.spark, path, rows.where(F.col("model") == "momentum"), replace=True)
    return forecast_store.read_forecasts(t.spark, path, rows).select(
        "campaign", "symbol", "origin", "model", "horizon", "forecast_price")


QUERIES["forecast_store"] = QUERIES.pop("forecast_store_batches")


@query
def forecast_view(t: Tables) -> DataFrame:
    keyed = written(P.window_keys(P.window_history(t.seq, t.origins, 64), "context=64").select("symbol", "origin", "key"), "keys")
    asked = keyed.join(t.targets.select("symbol", "origin", "horizon"), ["symbol", "origin"]).withColumn(
        "key", F.concat_ws("-", "key", F.col("horizon").cast("string")))
    stored = P.baseline_momentum(t.targets, t.seq).join(keyed, ["symbol", "origin"]).select(
        F.concat_ws("-", "key", F.col("horizon").cast("string")).alias("key"), "origin_price", "forecast_price")
    return P.forecast_view(asked, stored).drop("key")


# ---- column functions -------------------------------------------------------------
@query
def adjust_prices(t: Tables) -> DataFrame:
    return B.adjust_prices(t.bars)


@query
def validate_prices(t: Tables) -> DataFrame:
    return B.quarantine(derived.provider_rows(t.bars)).select(
        "symbol", "date", "close", "volume", F.array_join("problems", ",").alias("problems"))


@query
def validate_candle_order(t: Tables) -> DataFrame:
    return B.duplicate_dates(derived.provider_rows(t.bars), ("symbol", "date"))


@query
def validate_proposals(t: Tables) -> DataFrame:
    return G.validate_proposals(t.signals).select(
        "strategy", "symbol", "signal_date", "side", F.array_join("problems", ",").alias("problems"))


@query
def proposal_economics(t: Tables) -> DataFrame:
    score = F.coalesce(X.normal_confidence(F.col("confidence")), F.lit(K.BASE_RATE))
    finite = lambda c: F.when(F.col(c) == F.lit(float("inf")), F.lit(999.0)).otherwise(F.col(c)).alias(c)
    return G.proposal_economics(t.signals).withColumn("expected_r", X.expected_r(score, F.col("reward_risk"))).select(
        "strategy", "symbol", "signal_date", "side", "worst_entry", "risk", finite("reward_risk"), "reward_risk_tie", "expected_r")


def _next_bar(t: Tables, proposals: DataFrame) -> DataFrame:
    bar = t.seq.select("symbol", (F.col("seq") - 1).alias("seq"), "open", "high", "low", "close")
    return proposals.join(bar, ["symbol", "seq"])


@query
def entry_fill(t: Tables) -> DataFrame:
    fill = X.entry_fill(*[F.col(c) for c in ("entry_min", "entry_max", "open", "high", "low", "stop_loss")])
    return _next_bar(t, t.signals).select("strategy", "symbol", "signal_date", fill.alias("raw_entry"))


@query
def bar_exit(t: Tables) -> DataFrame:
    hit = X.bar_exit(*[F.col(c) for c in ("side", "stop_loss", "target", "high", "low")])
    return _next_bar(t, t.signals).withColumn("h", hit).select(
        "strategy", "symbol", "signal_date", "side", F.col("h.price").alias("price"), F.col("h.reason").alias("reason"))


@query
def r_multiple(t: Tables) -> DataFrame:
    entry = X.worst_entry(F.col("side"), F.col("entry_min"), F.col("entry_max"))
    return _next_bar(t, t.signals).select(
        "strategy", "symbol", "signal_date", "side", X.r_multiple(F.col("side"), entry, F.col("stop_loss"), F.col("close")).alias("r"))


@query
@precise(entry_price=10, exit_price=10)
def apply_costs(t: Tables) -> DataFrame:
    return t.outcomes.select(
        "strategy", "symbol", "seq", "entry_price", "exit_price", "brokerage", "slippage", "profit")


@query
def size_position(t: Tables) -> DataFrame:
    entry = X.buy_price(F.col("entry_max"))
    rows = t.longs.withColumn("rate", F.explode(F.array(*[F.lit(r) for r in K.RISK_RATES])))
    qty = X.position_size(F.lit(K.INITIAL_CAPITAL), F.lit(K.INITIAL_CAPITAL / K.MAX_POSITIONS), F.col("rate"),
                          entry - F.col("stop_loss"), entry)
    return rows.select("strategy", "symbol", "signal_date", "rate", qty.alias("qty"))


@query
def risk_factor(t: Tables) -> DataFrame:
    """From bootstrapped ruin; a strategy without resamples (here: one that never traded) has no ruin estimate."""
    ruin = Q.ruin_bootstrap(_walked(t)).where(F.col("rate") == 0.02).select("strategy", F.col("ruin_probability").alias("ruin"), "drawdown95")
    idle = t.spark.range(1).select(F.lit("idle").alias("strategy"), F.lit(None).cast("double").alias("ruin"), F.lit(None).cast("double").alias("drawdown95"))
    return ruin.unionByName(idle).withColumn("risk_factor", X.risk_factor(F.col("ruin"), F.col("drawdown95")))


@query
def trade_confidence(t: Tables) -> DataFrame:
    return t.trades.groupBy("strategy", "symbol").agg(F.count(F.lit(1)).alias("trades")).withColumn(
        "trade_confidence", X.trade_confidence(F.col("trades")))


@query
def is_improvement(t: Tables) -> DataFrame:
    best = t.scores.agg(F.median("score").alias("best"))
    failed = F.when(F.col("drawdown_pct") > 30, 1).otherwise(0)
    return t.scores.select("strategy", "score").join(Q.drawdown_score(t.equity), "strategy").join(F.broadcast(best)).select(
        "strategy", "score", "best", X.is_improvement(F.col("score"), F.col("best"), 0.05, failed).alias("improved"))


@query
def direction_sign(t: Tables) -> DataFrame:
    return P.forecast_errors(t.forecasts, 0.1).select("symbol", "origin", "model", "horizon", "actual_dir", "forecast_dir")


@query
def predicted_return(t: Tables) -> DataFrame:
    return t.forecasts.select("symbol", "origin", "model", "horizon", X.predicted_return_pct(
        F.col("origin_price"), F.col("forecast_price")).alias("predicted_return_pct"))


@query
def confidence_norm(t: Tables) -> DataFrame:
    norm = X.normal_confidence(F.col("confidence"))
    return t.signals.select("strategy", "symbol", "signal_date", norm.alias("confidence_norm"),
                            F.when(norm.isNotNull(), X.logit(norm)).alias("log_odds")).withColumn(
        "back", F.when(F.col("log_odds").isNotNull(), X.sigmoid(F.col("log_odds"))))


@query
def time_exit(t: Tables) -> DataFrame:
    return t.outcomes.select(
        "strategy", "symbol", "seq", "days_open", X.time_exit(F.col("days_open"), F.col("max_hold_days")).alias("time_exit"))


@query
def adjust_open_long(t: Tables) -> DataFrame:
    path = O.signal_path(t.seq, O.entry_bars(t.seq, t.signals)).select("strategy", "symbol", "seq", "bar_seq", "bar_date", "stop_loss")
    new = t.signals.select("strategy", "symbol", F.col("seq").alias("bar_seq"), F.col("side").alias("s"),
                           F.col("stop_loss").alias("sl"), F.col("target").alias("tg"))
    action = X.adjust_open_long(F.col("stop_loss"), F.col("s"), F.col("sl"), F.col("tg"))
    return path.join(new, ["strategy", "symbol", "bar_seq"]).select("strategy", "symbol", "seq", "bar_date", action.alias("a")).select(
        "strategy", "symbol", "seq", "bar_date", "a.*")


# ---- joins ------------------------------------------------------------------------
@query
def align_market_index(t: Tables) -> DataFrame:
    return C.align_market_index(t.adjusted.select("symbol", "bar_date", "close"), t.market)


@query
def market_asof(t: Tables) -> DataFrame:
    return C.market_asof(t.bars.select("symbol", "bar_date"), t.market, F.col("close"))


@query
def market_asof_strict(t: Tables) -> DataFrame:
    return C.market_asof(t.bars.select("symbol", "bar_date"), t.market, F.col("close"), strict=True)


@query
def market_asof_window(t: Tables) -> DataFrame:
    joined = C.market_asof_window(t.bars.select("symbol", "bar_date"), t.market)
    total = F.aggregate("context", F.lit(0.0), lambda acc, x: acc + x["close"])
    return joined.select("symbol", "bar_date", "role", F.size("context").cast("bigint").alias("points"),
                         F.col("context")[0]["bar_date"].alias("first_date"), total.alias("total_close"))


@query
def forecast_exact_join(t: Tables) -> DataFrame:
    return C.forecast_exact_join(t.bars.select("symbol", "bar_date"), t.baselines, "momentum")


@query
def forecast_coverage(t: Tables) -> DataFrame:
    return C.forecast_coverage(t.baselines, t.bars, t.folds, "momentum")


@query
@precise(profit=7)
def assign_fold(t: Tables) -> DataFrame:
    return D.assign_fold(t.trades.drop("fold"), t.folds, "exit_date").select("strategy", "symbol", "exit_date", "profit", "fold")


def _training_signals(t: Tables) -> DataFrame:
    rows = rules.featured(t.adjusted.where(F.col("bar_date") <= F.lit(TRAINING_END).cast("date")))
    return G.signal_rule(rows, *rules.example_rules())


@query
def forward_return(t: Tables) -> DataFrame:
    return G.forward_return(t.training, _training_signals(t)).select("strategy", "symbol", "seq", "horizon", "forward_return")


@query
def signal_path(t: Tables) -> DataFrame:
    return O.signal_path(t.seq, O.entry_bars(t.seq, t.signals)).select(
        "strategy", "symbol", "seq", "offset", "bar_date", "open", "high", "low", "close")


OUTCOME = ["strategy", "symbol", "seq", "entry_date", "exit_date", "reason", "days_open", "qty", "entry_price",
           "exit_price", "profit", "r_multiple"]


@query
@precise(entry_price=10, exit_price=10)
def trade_outcomes(t: Tables) -> DataFrame:
    return O.trade_outcomes(t.seq, t.signals).select(*OUTCOME)


@query
def trade_outcomes_market_day(t: Tables) -> DataFrame:
    return O.trade_outcomes(t.seq, t.signals, "next_market_day").select(
        "strategy", "symbol", "seq", "entry_date", "exit_date", "reason", "profit")


@query
def pending_windows(t: Tables) -> DataFrame:
    lost = (F.col("model") == "momentum") & (F.col("horizon") == 20) & (F.year("origin") == 2000)
    return P.pending_windows(t.origins, t.baselines.where(~lost), MODELS, K.FORECAST_HORIZONS).select("symbol", "origin", "seq")


@query
def pair_lineages(t: Tables) -> DataFrame:
    return t.pairs.select("signature", "a", "b")


@query
def trade_overlap(t: Tables) -> DataFrame:
    return E.trade_overlap(t.trades, t.pairs)


@query
def plateau_neighbours(t: Tables) -> DataFrame:
    return E.plateau_neighbours(t.grid)


@query
def ensemble_weights(t: Tables) -> DataFrame:
    return G.ensemble_weights(t.longs, t.rule_correlations).select("strategy", "symbol", "signal_date", "weight")


@query
def same_basis(t: Tables) -> DataFrame:
    ranges = t.trades.select("strategy", "fold").distinct().join(t.folds, "fold").withColumn("model", F.lit("portfolio-v1"))
    basis = E.scoring_basis(ranges).join(ranges.groupBy("strategy").agg(F.count(F.lit(1)).alias("folds")), "strategy")
    return E.same_basis(basis, basis.where(F.col("strategy") == "Brand#1")).select("strategy", "folds")


# ---- aggregations -----------------------------------------------------------------
@query
@precise(traded_value=4)
def select_universe(t: Tables) -> DataFrame:
    return B.select_universe(t.bars, TRAINING_END, "1995-01-31", ["S00000", "S00007"])


@query
def price_status(t: Tables) -> DataFrame:
    name = lambda prefix, key: F.concat(F.lit(prefix), F.lpad(F.col(key).cast("string"), 5, "0")).alias("symbol")
    universe = t.raw("supplier").select(name("S", "s_suppkey")).union(t.raw("nation").select(name("M", "n_nationkey")))
    return B.price_status(t.bars, universe).select("symbol", "bars", "first_date", "last_date", "status")


@query
def price_quality(t: Tables) -> DataFrame:
    return B.price_quality(t.raw_bars)


@query
def coverage_report(t: Tables) -> DataFrame:
    symbols = B.symbol_coverage(t.bars, t.bars, TRAINING_END, "1999-01-01")
    return B.fold_coverage(t.bars, t.bars, t.folds).join(
        symbols.select("symbol", "training_rows", "enough_training", "has_evaluation"), "symbol")


@query
def missing_roles(t: Tables) -> DataFrame:
    roles = t.raw("part").select(F.col("p_type").alias("role")).union(t.market.select("role")).distinct()
    return B.missing_roles(t.market, roles)


@query
def training_range(t: Tables) -> DataFrame:
    return B.training_range(t.bars, TRAINING_END, "2001-06-30")


@query
@precise(baseline_return=8)
def forward_baseline(t: Tables) -> DataFrame:
    return G.forward_baseline(t.training, list(range(1, K.MAX_SCREEN_HORIZON + 1)))


@query
@precise(actual_mean=9, baseline_mean=9, alpha=9)
def signal_screen(t: Tables) -> DataFrame:
    return rules.screen(t.adjusted, TRAINING_END)


@query
def profile_score(t: Tables) -> DataFrame:
    return t.scores


@query
def concentration_factor(t: Tables) -> DataFrame:
    return S.concentration_factor(t.trades, t.scores)


@query
def symbol_factor(t: Tables) -> DataFrame:
    return S.symbol_factor(t.trades, t.scores)


@query
def top_trade_share(t: Tables) -> DataFrame:
    return S.top_trade_share(t.trades)


@query
def quarter_rate(t: Tables) -> DataFrame:
    return S.quarter_rate(t.trades)


@query
def combine_profiles(t: Tables) -> DataFrame:
    profile = F.when(F.col("setup") == "A", "conservative").when(F.col("setup") == "N", "moderate").otherwise("aggressive")
    scored = t.trades.groupBy("strategy", profile.alias("profile")).agg(F.sum("profit").alias("score")).withColumn(
        "failures", F.when(F.col("score") < 0, F.array(F.lit("loss"))).otherwise(F.array().cast("array<string>")))
    return S.combine_profiles(scored)


@query
def positive_fold_gate(t: Tables) -> DataFrame:
    return S.positive_fold_gate(t.periods)


@query
def sample_adequacy_gate(t: Tables) -> DataFrame:
    return S.sample_adequacy_gate(t.counts)


@query
def drawdown_gate(t: Tables) -> DataFrame:
    return S.drawdown_gate(t.fold_drawdowns)


@query
def aggregate_folds(t: Tables) -> DataFrame:
    return S.aggregate_folds(t.fold_results)


@query
def promotion_decision(t: Tables) -> DataFrame:
    return S.promotion_decision(t.periods, t.fold_drawdowns, t.full_period, t.counts)


@query
def evaluate(t: Tables) -> DataFrame:
    """Raw bars with splits to a promotion decision for each example strategy."""
    return evaluate_flow(t.bars, t.folds, rules.example_signals)


@query
def period_profits(t: Tables) -> DataFrame:
    return t.periods


@query
def evaluation_summary(t: Tables) -> DataFrame:
    return S.evaluation_summary(t.trades, t.fold_results, t.periods, t.scores)


@query
def strategy_attribution(t: Tables) -> DataFrame:
    return S.strategy_attribution(t.trades)


@query
def audit_sample(t: Tables) -> DataFrame:
    return E.audit_sample(t.trades, t.folds)


@query
def audit_concentration(t: Tables) -> DataFrame:
    return E.audit_concentration(t.trades, t.periods)


@query
def profit_gini(t: Tables) -> DataFrame:
    return E.profit_gini(t.trades)


@query
@with_cast
def audit_verdict(t: Tables) -> DataFrame:
    return t.verdicts.join(E.verdict_counts(t.verdicts), "verdict").select("strategy", "verdict", "strategies")


@query
def trial_summary(t: Tables) -> DataFrame:
    return artifacts.trial_summary(derived.trials(t.raw("events")))


@query
@precise(return_mae_pp=8, price_mae=8)
def forecast_metrics(t: Tables) -> DataFrame:
    return P.forecast_metrics(t.forecasts)


@query
def near_hits(t: Tables) -> DataFrame:
    return P.near_hits(t.forecasts, [0.5, 1, 2, 5])


@query
def quantile_calibration(t: Tables) -> DataFrame:
    return P.quantile_calibration(t.forecasts)


@query
def forecast_skill(t: Tables) -> DataFrame:
    return P.forecast_skill(P.forecast_metrics(t.forecasts))


@query
def forecast_completeness(t: Tables) -> DataFrame:
    return P.forecast_completeness(t.baselines, t.origins, MODELS, K.FORECAST_HORIZONS)


@query
@with_cast
def fold_signature(t: Tables) -> DataFrame:
    return E.fold_signature(t.fold_scores)


@query
@with_cast
def best_per_lineage(t: Tables) -> DataFrame:
    return E.best_per_lineage(t.scored.select(F.col("family").alias("lineage"), F.col("strategy").alias("entry"), "score"))


@query
def fold_correlation(t: Tables) -> DataFrame:
    return E.fold_correlation(t.pairs).select("a", "b", "r")


@query
def pbo(t: Tables) -> DataFrame:
    return E.pbo(E.fold_vectors(t.fold_scores))


@query
def trade_fingerprint(t: Tables) -> DataFrame:
    return E.trade_fingerprint(t.trades)


@query
def dataset_fingerprint(t: Tables) -> DataFrame:
    return E.dataset_fingerprint(t.bars, ["symbol"])


@query
def dataset_digest_tree(t: Tables) -> DataFrame:
    """Fingerprints of a table's second version from those of the first: only the year that a batch touched is read."""
    table = PriceTable(t.spark, t.folder_for("price-table"))
    first = table.overwrite(t.bars)
    known = written(E.price_sums(table.read(first)), "digests")
    late = t.raw_bars.where(F.col("bar_date") >= F.lit("2001-01-01").cast("date")).join(
        t.bars.select("symbol", "bar_date"), ["symbol", "bar_date"], "left_semi")
    return E.digest_tree(E.refreshed_sums(table, known, first, table.upsert(late)))


@query
def scoring_basis_changed(t: Tables) -> DataFrame:
    edited = t.bars.withColumn("close", F.when(
        F.col("bar_date") == F.lit("2000-01-03").cast("date"), F.col("close") + 1).otherwise(F.col("close")))
    return E.scoring_basis_changed(E.dataset_fingerprint(edited, ["symbol"]), E.dataset_fingerprint(t.bars, ["symbol"]), ["symbol"])


# ---- windows ----------------------------------------------------------------------
@query
def bar_seq(t: Tables) -> DataFrame:
    return t.seq.select("symbol", "bar_date", "seq")


@query
def rolling_traded_value(t: Tables) -> DataFrame:
    return W.rolling_traded_value(t.adjusted).select("symbol", "bar_date", "traded_value")


@query
def lookback_bars(t: Tables) -> DataFrame:
    rows = W.lookback_bars(t.adjusted)
    total = F.aggregate("history", F.lit(0.0), lambda acc, x: acc + x["close"])
    volume = F.aggregate("history", F.lit(0).cast("bigint"), lambda acc, x: acc + x["volume"])
    return rows.select("symbol", "bar_date", F.col("history")[0]["bar_date"].alias("first_date"),
                       (total / F.size("history")).alias("mean_close"), volume.alias("volume"))


@query
def warmup_slice(t: Tables) -> DataFrame:
    return D.warmup_slice(t.seq.select("symbol", "bar_date", "seq"), t.folds).select("symbol", "fold", "bar_date", "seq", "warmup")


@query
def drawdown_engine(t: Tables) -> DataFrame:
    return Q.drawdown_engine(t.equity)


@query
def drawdown_score(t: Tables) -> DataFrame:
    return Q.drawdown_score(t.equity)


@query
@precise(daily_return=9)
def daily_returns(t: Tables) -> DataFrame:
    return Q.daily_returns(t.equity)


@query
def sortino(t: Tables) -> DataFrame:
    return Q.sortino(Q.daily_returns(t.equity))


@query
@precise(segment_return=9)
def time_windows(t: Tables) -> DataFrame:
    return S.time_windows(t.equity)


@query
def time_factors(t: Tables) -> DataFrame:
    return S.time_factors(S.time_windows(t.equity))


@query
def rolling_windows(t: Tables) -> DataFrame:
    return t.origins


@query
def anchored_windows(t: Tables) -> DataFrame:
    return P.anchored_windows(t.seq, 64, 5, t.folds)


@query
def forecast_targets(t: Tables) -> DataFrame:
    return t.targets.drop("seq")


@query
def baseline_unchanged(t: Tables) -> DataFrame:
    return P.baseline_unchanged(t.targets).select("symbol", "origin", "horizon", "forecast_price")


@query
def baseline_momentum(t: Tables) -> DataFrame:
    return P.baseline_momentum(t.targets, t.seq).select("symbol", "origin", "horizon", "forecast_price")


@query
def trailing_stop(t: Tables) -> DataFrame:
    path = O.signal_path(t.seq, O.entry_bars(t.seq, t.signals))
    return O.trailing_stop(path, t.signals).select("strategy", "symbol", "seq", "offset", "stop_now", "target_now", "exit_pending")


@query
@precise(max_drawdown_r=8)
def eligibility(t: Tables) -> DataFrame:
    return S.eligibility(t.trades, Z.TRADE_ORDER, ["strategy", "setup", "regime"], "profit").select(
        "strategy", "setup", "regime", "pos", "sample_size", "expectancy_r", "win_rate", "max_drawdown_r", "reason", "actionable")


@query
@precise(equity=7)
def equity_curve(t: Tables) -> DataFrame:
    return O.equity_curve(t.trades).select("strategy", "bar_date", "equity")


@query
def marked_equity(t: Tables) -> DataFrame:
    return O.marked_equity(t.outcomes, t.seq)


@query
def fold_calendar(t: Tables) -> DataFrame:
    folds = D.fold_calendar(t.bars.agg(F.max("bar_date").alias("latest")), "1999-01-01", 6, TRAINING_END)
    counts = D.assign_fold(t.bars, folds, "bar_date").groupBy("fold").agg(F.count(F.lit(1)).alias("bars"))
    return folds.join(counts, "fold")


# ---- ranking and selection --------------------------------------------------------
@query
@precise(rank_r=9, evidence=9, votes=9)
def daily_top_k(t: Tables) -> DataFrame:
    snapped = t.candidates
    for name in ("expected_r", "evidence", "votes"):
        snapped = snapped.withColumn(name, F.round(name, 9))
    # The floor of real markets scaled to bars of some thirty shares a day: it keeps about three in four candidates.
    return G.daily_top_k(snapped, K.MAX_POSITIONS, liquidity_floor=K.MIN_AVG_TRADED_VALUE / 1000).select(
        "symbol", "signal_date", "strategy", "rank_r", "evidence", "votes", "rank")


@query
def ensemble_score(t: Tables) -> DataFrame:
    return G.ensemble_score(G.ensemble_weights(t.longs, t.rule_correlations))


@query
def ensemble_representative(t: Tables) -> DataFrame:
    return G.ensemble_representative(t.longs).select("symbol", "signal_date", "strategy", "entry_max", "stop_loss", "target")


@query
def stable_parameter(t: Tables) -> DataFrame:
    return E.stable_parameter(t.grid)


def _passes(t: Tables) -> DataFrame:
    by_rate = rules.risk_passes(t.seq, t.signals, K.RISK_RATES)
    return rules.pass_results(by_rate, Q.ruin_bootstrap(_walked(t)))


def _pool(t: Tables) -> DataFrame:
    return Q.r_pool(t.outcomes, rules.TRADE_ORDER)


def _walked(t: Tables) -> DataFrame:
    return Q.ruin_paths(_pool(t), K.RISK_RATES)


@query
def choose_risk_rate(t: Tables) -> DataFrame:
    return Q.choose_risk_rate(_passes(t))


@query
def risk_sensitivity(t: Tables) -> DataFrame:
    passes = _passes(t)
    return Q.risk_sensitivity(passes, Q.choose_risk_rate(passes))


@query
def best_survivor(t: Tables) -> DataFrame:
    return E.best_survivor(t.scored)


@query
@with_cast
def diverse_partner(t: Tables) -> DataFrame:
    return E.diverse_partner(t.scored, E.fold_correlation(t.pairs))


@query
def weakest_strategy(t: Tables) -> DataFrame:
    return E.weakest_strategy(t.scores)


def _intervals(t: Tables) -> DataFrame:
    return Z.correlation_ci(E.fold_correlation(t.pairs))


@query
def correlation_ci(t: Tables) -> DataFrame:
    return _intervals(t).select("a", "b", "r", "lower", "upper", "resamples")


@query
@with_cast
def redundant_pairs(t: Tables) -> DataFrame:
    return E.redundant_pairs(_intervals(t), E.trade_overlap(t.trades, t.pairs))


@query
@with_cast
def admit_candidate(t: Tables) -> DataFrame:
    prints = E.trade_fingerprint(t.trades).select(
        "strategy", F.sha2(F.concat(F.lit("rule-"), F.substring("strategy", -1, 1)), 256).alias("rule_hash"), "fingerprint")
    archived, vectors = F.col("strategy") < "Brand#15", E.fold_vectors(t.fold_scores)
    redundant = E.surely_redundant(E.pair_lineages(vectors.where(~archived), vectors.where(archived)), t.trades)
    return E.admit_candidate(prints.where(~archived), prints.where(archived), redundant)


# ---- resampling -------------------------------------------------------------------
@query
@precise(u=9)
def counter_uniform_draws(t: Tables) -> DataFrame:
    return with_uniform(t.seq, F.lit(42), F.col("seq") - 1).select("symbol", "bar_date", "u")


QUERIES["counter_uniform"] = QUERIES.pop("counter_uniform_draws")


@query
def block_bootstrap(t: Tables) -> DataFrame:
    return Z.block_bootstrap(t.trades)


def _gate_trades(t: Tables) -> DataFrame:
    """Incumbents, a copy of each as candidate (names ending in 3 skip a fold), and a strategy with few trades."""
    new = t.trades.where(~(F.col("strategy").endswith("3") & (F.col("fold") == "fold-3"))).withColumn(
        "profit", F.when(F.col("strategy").endswith("2"), F.abs("profit")).otherwise(F.col("profit"))).withColumn(
        "strategy", F.concat(F.lit("new "), "strategy"))
    few = t.trades.where((F.col("strategy") == "Brand#11") & (F.col("symbol") == "S00001") & (F.col("fold") == "fold-2")
                         & (F.day("exit_date") <= 10)).withColumn("strategy", F.lit("few"))
    return t.trades.unionByName(new).unionByName(few)


def _gate_folds(t: Tables) -> DataFrame:
    """Declared ranges: all folds, but six only for candidates ending in 5; one declares folds and never trades."""
    names = t.trades.select("strategy").distinct()
    extra = names.limit(1).select(F.explode(F.array(F.lit("few"), F.lit("new idle"))).alias("strategy"))
    names = names.union(names.select(F.concat(F.lit("new "), "strategy"))).union(extra)
    list_ = F.array_sort(F.collect_list(F.struct("fold", "start", "end")))
    every = names.join(F.broadcast(t.folds.agg(list_.alias("f")))).select("strategy", F.inline("f"))
    return every.where(~(F.col("strategy").startswith("new ") & F.col("strategy").endswith("5") & (F.col("fold") == "fold-7")))


@query
def significance_gate(t: Tables) -> DataFrame:
    best = t.scores.agg(F.max_by("strategy", "score").alias("best"))
    names = t.trades.select(F.concat(F.lit("new "), "strategy").alias("candidate")).distinct()
    names = names.union(names.limit(1).select(F.lit("new idle")))
    pairs = names.join(F.broadcast(best)).select(
        "candidate", F.explode(F.array(F.col("best"), F.lit("few"), F.lit("gone"))).alias("incumbent"))
    return Z.significance_gate(_gate_trades(t), pairs, _gate_folds(t))


@query
def ruin_bootstrap(t: Tables) -> DataFrame:
    return Q.ruin_bootstrap(_walked(t))


@query
def capital_envelope(t: Tables) -> DataFrame:
    trades = t.outcomes
    pool = Q.r_pool(trades, rules.TRADE_ORDER)
    dates = ordered_positions(trades.select("strategy", *rules.TRADE_ORDER), ["strategy"], rules.TRADE_ORDER)
    points = Q.capital_envelope(pool, dates, Q.ruin_paths(pool, [0.01]), [0.01])
    # Two engines' exponentials differ in the 16th digit: beyond 100 million, cents are not compared.
    return points.withColumn("capital", F.when(F.abs("capital") >= 1e8, F.round("capital")).otherwise(F.col("capital")))


@query
def perturb_prices(t: Tables) -> DataFrame:
    return Z.perturb_prices(t.seq, F.lit(7)).select("symbol", "bar_date", "open", "high", "low", "close")


def _replica_days(t: Tables) -> DataFrame:
    """Trades and profit per replica, strategy and exit date: what is left to cross of the replicas' trades."""
    def outcomes(bars: DataFrame) -> DataFrame:
        return O.asked_outcomes(rules.asked(bars.drop("seq")), rules.LONGEST_HOLD)

    return Z.plateau_replicas(t.seq_where_made, 2, outcomes).groupBy("replica", "strategy", "exit_date").agg(
        F.count(F.lit(1)).alias("trades"), F.sum("profit").alias("profit"))


@query
def plateau_replicas(t: Tables) -> DataFrame:
    keys = ["replica", "strategy", "fold"]
    days = written(D.assign_fold(_replica_days(t), t.folds, "exit_date", strict=True), "replica-days")
    curve = O.equity_curve(days, keys=keys).select(*keys, "bar_date", cents(F.col("equity")).alias("capital"))
    # A fold's score is what its profile earned: capital at its last exit, to the cent, less the initial one.
    scores = curve.groupBy(*keys).agg((F.max_by("capital", "bar_date") - F.lit(float(K.INITIAL_CAPITAL))).alias("score"))
    return days.groupBy(*keys).agg(F.sum("trades").alias("trades")).join(scores, keys)


@query
def parameter_grid(t: Tables) -> DataFrame:
    points = Z.parameter_grid(t.spark, rules.GRID)
    return points.join(t.grid.select("point", "signals"), "point")


# ---- sets -------------------------------------------------------------------------
@query
def calendar_union(t: Tables) -> DataFrame:
    return W.market_calendar(t.bars).select("bar_date")


@query
def window_dates(t: Tables) -> DataFrame:
    return D.window_dates(D.warmup_slice(t.seq.select("symbol", "bar_date", "seq"), t.folds))


@query
def fold_union(t: Tables) -> DataFrame:
    return D.fold_names(t.folds, t.trades)


@query
def symbol_union(t: Tables) -> DataFrame:
    context = t.market.select(F.concat(F.lit("^"), "role").alias("symbol"))
    return t.bars.select("symbol").distinct().union(context).distinct()


# ---- streams ----------------------------------------------------------------------
@query
def stream_pair_events(t: Tables) -> DataFrame:
    lines, out = t.folder_for("calls"), t.folder_for("paired")
    calls = derived.calls(t.raw("events")).withColumn("ts", F.col("ts").cast("timestamp"))
    as_line = F.to_json(F.struct("call_id", "kind", "ts", "tool", "status", "text"), streams.JSON_TIME).alias("value")
    later = calls.agg((F.max("ts") + F.expr("interval 30 days")).alias("ts")).select(
        F.lit(-1).alias("call_id"), F.explode(F.array(F.lit("start"), F.lit("end"))).alias("kind"), "ts").select(
        F.to_json(F.struct("call_id", "kind", "ts"), streams.JSON_TIME).alias("value"))
    broken = calls.where(F.col("status") == "error").select(F.lit('{"call_id": 1, "kind').alias("value"))
    # Heartbeats far ahead move the watermark, so that unmatched ends are released.
    calls.select(as_line).union(broken).union(later).write.text(lines)
    events = streams.parse_events(t.spark.readStream.text(lines))
    streams.run_to_table(streams.pair_events(events, "1 day"), out, t.folder_for("state"))
    plain = [F.col(name).cast("timestamp_ntz").alias(name) for name in ("started_at", "ended_at")]
    return t.spark.read.parquet(out).where(F.col("call_id") >= 0).select(
        "call_id", "tool", "status", *plain, "duration_ms", "error_text")


@query
@precise(**PRICES)
def stream_upsert_prices(t: Tables) -> DataFrame:
    incoming, table = t.folder_for("incoming"), t.folder_for("prices")
    late = t.raw_bars.where((F.col("bar_date") >= F.lit("2000-01-01").cast("date")) & (F.col("high") >= F.col("low"))
                            & (F.col("low") > 0)).join(t.bars.select("symbol", "bar_date"), ["symbol", "bar_date"], "left_semi")
    late.select("symbol", F.date_format("bar_date", "yyyy-MM-dd").alias("date"), *K.PRICE_COLUMNS[2:7],
                F.col("volume").cast("double").alias("volume")).repartition(3, "symbol").write.parquet(incoming)
    streams.stream_upsert_prices(t.spark, incoming, table, t.folder_for("state")).awaitTermination()
    return streams.current_prices(t.spark, table, t.bars)


@query
def stream_trials(t: Tables) -> DataFrame:
    incoming, out = t.folder_for("trials"), t.folder_for("counts")
    rows = derived.trials(t.raw("events")).withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(incoming)
    stream = t.spark.readStream.schema(rows.schema).parquet(incoming)
    streams.run_updates(streams.trial_counts(stream), out, t.folder_for("state"), ["source"])
    return streams.latest_updates(t.spark, out, ["source"])


@query
@precise(**PRICES)
def stream_price_table(t: Tables) -> DataFrame:
    """Price files into a table of versions, kept batches folded into the base on the way."""
    incoming, table = t.folder_for("incoming"), PriceTable(t.spark, t.folder_for("price-table"))
    table.overwrite(t.bars)
    late = t.raw_bars.where((F.col("bar_date") >= F.lit("2000-01-01").cast("date")) & (F.col("high") >= F.col("low"))
                            & (F.col("low") > 0)).join(t.bars.select("symbol", "bar_date"), ["symbol", "bar_date"], "left_semi")
    _as_sent(late).repartition(5, "symbol").write.parquet(incoming)
    streams.stream_into_table(t.spark, incoming, table, t.folder_for("state"), files_per_trigger=2, compact_every=2).awaitTermination()
    return table.read()


@query
def stream_pair_events_late(t: Tables) -> DataFrame:
    """Every start arrives after its end, in a later batch; the table is that of all calls at once."""
    lines, out = t.folder_for("calls"), t.folder_for("paired")
    calls = derived.calls(t.raw("events")).withColumn("ts", F.col("ts").cast("timestamp"))
    state = t.folder_for("state")
    for kind in ("end", "start"):  # all that has arrived, in one batch, before the next kind arrives
        calls.where(F.col("kind") == kind).write.parquet(f"{lines}/{kind}")
        events = t.spark.readStream.schema(calls.schema).option("recursiveFileLookup", True).parquet(lines)
        streams.run_to_table(streams.pair_changes(events), out, state)
    plain = [F.col(name).cast("timestamp_ntz").alias(name) for name in ("started_at", "ended_at")]
    return streams.pairs_of_changes(t.spark.read.parquet(out)).select(
        "call_id", "tool", "status", *plain, "duration_ms", "error_text", "reason")


@query
def stream_trials_late(t: Tables) -> DataFrame:
    """Trials in reverse order of time, so repeats come before the trial that they repeat."""
    incoming, out = t.folder_for("trials"), t.folder_for("changes")
    rows = derived.trials(t.raw("events")).withColumn("ts", F.col("ts").cast("timestamp"))
    rows.repartitionByRange(3, F.desc("ts")).sortWithinPartitions(F.desc("ts")).write.parquet(incoming)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(incoming)
    streams.run_to_table(streams.trial_changes(stream), out, t.folder_for("state"))
    return streams.counts_of_changes(t.spark.read.parquet(out))


# ---- rules ------------------------------------------------------------------------
@query
def signal_rule(t: Tables) -> DataFrame:
    return t.signals


@query
def signal_rule_pandas(t: Tables) -> DataFrame:
    def rule(history):
        close, mean = history["close"][-1], history["close"][-20:].mean()
        if close >= 0.94 * mean:
            return None
        return {"side": "long", "entry_min": close * 0.99, "entry_max": close * 1.01, "stop_loss": close * 0.95,
                "target": close * 1.06, "max_hold_days": 5, "setup": "deep", "regime": "any", "confidence": None}

    return G.signal_rule_pandas(t.seq, rule, "deep6")


@query
def ensemble_signals(t: Tables) -> DataFrame:
    rows = rules.featured(t.adjusted)
    return G.ensemble_signals(*[G.signal_rule(rows, rule) for rule in rules.example_rules()]).select(
        "strategy", "symbol", "signal_date", "side", "confidence")


@query
def forecast_scorer(t: Tables) -> DataFrame:
    q = F.col("quantiles")
    return t.empirical.select("symbol", "origin", "horizon", "forecast_price", q[0].alias("low"), q[8].alias("high"))
