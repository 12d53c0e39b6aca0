"""Hand values, boundaries, leakage and brute-force checks of the operators."""

import datetime as dt
import math
import random
import statistics
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfolio.functions.random import uniform_block
from sparkfolio.plans import rules
from sparkfolio.plans.queries import QUERIES
from sparkfolio.operators import context, evidence, features, folds, forecasts, outcomes, resample, risk, scoring, signals

DAY = dt.date(2024, 1, 1)


def day(i):
    return DAY + dt.timedelta(days=i)


def make_bars(spark, rows, symbol="AAA"):
    return spark.createDataFrame(
        [(symbol, day(i), *map(float, r), float(r[3]), 1000) for i, r in enumerate(rows)],
        "symbol string, bar_date date, open double, high double, low double, close double, adj_close double, volume bigint")


def make_trades(spark, rows):
    return spark.createDataFrame(
        [(s, f, sym, float(p), day(i), day(i + 1)) for i, (s, f, sym, p) in enumerate(rows)],
        "strategy string, fold string, symbol string, profit double, entry_date date, exit_date date")


def make_folds(spark, n):
    return spark.createDataFrame([(f"f{i}", day(i * 100), day(i * 100 + 99)) for i in range(1, n + 1)],
                                 "fold string, start date, end date")


# ---- gates and audits ---------------------------------------------------------------
def test_positive_fold_gate_needs_sixty_percent(spark):
    rows = [("a", str(i), 1.0 if i < 6 else -1.0) for i in range(10)] + [("b", str(i), 1.0 if i < 5 else 0.0) for i in range(10)]
    got = {r.strategy: r for r in scoring.positive_fold_gate(
        spark.createDataFrame(rows, "strategy string, fold string, profit double")).collect()}
    assert got["a"].passed and got["a"].minimum_positive_folds == 6 and not got["b"].passed


def test_drawdown_gate_is_inclusive(spark):
    df = spark.createDataFrame([("a", "f1", 30.0), ("b", "f1", 30.01)], "strategy string, fold string, drawdown_pct double")
    assert {r.strategy: r.passed for r in scoring.drawdown_gate(df).collect()} == {"a": True, "b": False}


def spread(name, n, profit):
    return [(name, f"f{i % 6 + 1}", f"S{i % 10}", profit) for i in range(n)]


def test_audits_kill_thin_and_lopsided_strategies(spark):
    rows = spread("fine", 60, 10.0) + spread("thin", 7, 10.0) + spread("lucky", 40, -1.0) + [("lucky", "f1", "S1", 41.0)]
    trades = make_trades(spark, rows)
    sample = {r.strategy: r for r in evidence.audit_sample(trades, make_folds(spark, 6)).collect()}
    assert {k: v.verdict for k, v in sample.items()} == {"fine": "survived", "thin": "killed", "lucky": "survived"}
    conc = {r.strategy: r for r in evidence.audit_concentration(trades).collect()}
    assert conc["fine"].verdict == "survived" and conc["lucky"].verdict == "killed"
    assert conc["lucky"].profit_without_best_trade == -40.0
    gini = {r.strategy: r.profit_gini for r in evidence.profit_gini(trades).collect()}
    assert gini["fine"] == pytest.approx(0.0) and gini["lucky"] == pytest.approx(0.0)


def test_exactly_thirty_trades_are_enough(spark):
    trades = make_trades(spark, spread("a", 30, 1.0) + spread("b", 29, 1.0))
    got = {r.strategy: r.verdict for r in evidence.audit_sample(trades, make_folds(spark, 6)).collect()}
    assert got == {"a": "survived", "b": "killed"}


def test_fold_median_and_combination(spark):
    rows = [("a", f"f{i}", s, s, 1.0) for i, s in enumerate([3.0, -1.0, 2.0, 10.0])]
    df = spark.createDataFrame(rows, "strategy string, fold string, score double, profit double, drawdown_pct double")
    got = scoring.aggregate_folds(df).first()
    assert (got.median_fold_score, got.losing_folds, got.gate_failures) == (2.5, 1, "")
    profiles = spark.createDataFrame([("a", "conservative", 1.0, []), ("a", "moderate", 2.0, ["x"]), ("a", "aggressive", 4.0, [])],
                                     "strategy string, profile string, score double, failures array<string>")
    both = scoring.combine_profiles(profiles).first()
    assert both.score == pytest.approx(2.0) and both.failures == "moderate:x"


def test_fold_calendar(spark):
    latest = spark.createDataFrame([(dt.date(2025, 6, 30),)], "latest date")
    got = folds.fold_calendar(latest, "2018-01-01", 6, "2017-12-31").collect()
    assert len(got) == 15 and got[-1].end == dt.date(2025, 6, 30) and got[0].end == dt.date(2018, 6, 30)
    with pytest.raises(ValueError):
        folds.fold_calendar(latest, "2018-01-01", 6, "2018-01-01")
    with pytest.raises(Exception, match="fixed folds"):
        folds.fold_calendar(latest, "2018-01-01", 6, "2017-12-31", fixed_count=14).collect()


def test_drawdowns_differ(spark):
    caps = [100.0, 150.0, 120.0, 300.0, 260.0]
    eq = spark.createDataFrame([("a", day(i), c) for i, c in enumerate(caps)], "strategy string, bar_date date, capital double")
    engine, score = risk.drawdown_engine(eq, 100.0).first(), risk.drawdown_score(eq, 100.0).first()
    assert (engine.max_drawdown, engine.max_drawdown_pct) == (40.0, 13.33)
    assert (score.max_drawdown, score.drawdown_pct) == (40.0, 20.0)


# ---- evidence -----------------------------------------------------------------------
def vectors(spark, rows):
    long = [(s, f"f{i}", float(v)) for s, values in rows.items() for i, v in enumerate(values)]
    return evidence.fold_vectors(spark.createDataFrame(long, "strategy string, fold string, score double"))


def test_pbo_of_a_dominant_candidate(spark):
    got = evidence.pbo(vectors(spark, {"stable": [5, 5, 5, 5], "weak": [1, 1, 1, 1]})).first()
    assert (got.probability, got.splits, got.candidates, got.folds) == (0.0, 6, 2, 4)


def test_correlation_and_interval(spark):
    df = vectors(spark, {"a": range(1, 11), "b": [2 * x + 1 for x in range(1, 11)], "c": [4] * 10})
    got = {(r.a, r.b): r for r in resample.correlation_ci(evidence.fold_correlation(evidence.pair_lineages(df, cell=1))).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    assert got["a", "b"].r == pytest.approx(1.0) and got["a", "b"].lower == pytest.approx(1.0)
    assert got["a", "c"].r is None and got["a", "c"].resamples == 0


def test_overlap_and_redundancy(spark):
    rows = [(s, "f1", "S1", 1.0) for s in ("a", "b")]
    trades = make_trades(spark, rows).withColumn("entry_date", F.lit(DAY)).withColumn("exit_date", F.lit(DAY)).unionByName(
        make_trades(spark, [("a", "f1", "S2", 1.0), ("b", "f1", "S3", 1.0)]))
    pairs = spark.createDataFrame([("a", "b")], "a string, b string")
    got = evidence.trade_overlap(trades, pairs).first()
    assert got.shared_trades == 1 and got.jaccard == pytest.approx(1 / 3)


def test_stable_parameter_prefers_the_plateau(spark):
    points = [(f"p{t}", {"threshold": str(t), "hold": "5"}, s) for t, s in [(1, 60.0), (2, 61.0), (3, 62.0), (10, 99.0)]]
    df = spark.createDataFrame([("c", p, v, s) for p, v, s in points],
                               "campaign string, point string, params map<string,string>, score double")
    best = evidence.stable_parameter(df).first()
    assert (best.point, best.neighbourhood_size, best.stability_score) == ("p3", 3, 62.0)


def test_fingerprint_ignores_order_only(spark):
    rows = spread("a", 20, 1.0)
    one = make_trades(spark, rows)
    two = one.orderBy(F.desc("entry_date")).repartition(5)
    three = one.withColumn("symbol", F.when(F.col("entry_date") == F.lit(day(3)), "S99").otherwise(F.col("symbol")))
    prints = [evidence.trade_fingerprint(df).first().fingerprint for df in (one, two, three)]
    assert prints[0] == prints[1] != prints[2]


# ---- eligibility and bootstraps against plain loops -----------------------------------
def test_eligibility_against_a_loop(spark, monkeypatch):
    rng = random.Random(5)
    values = [round(rng.uniform(-1.5, 1.6), 3) for _ in range(130)]
    df = spark.createDataFrame([("s", "long", "a", "b", i, v) for i, v in enumerate(values)],
                               "strategy string, side string, setup string, regime string, i int, r_multiple double")
    monkeypatch.setattr(scoring, "with_halo", lambda d, k, p, back: __import__(
        "sparkfolio.functions.ordering", fromlist=["with_halo"]).with_halo(d, k, p, back, block=25))
    got = {r.i: r for r in scoring.eligibility(df, ["i"]).collect()}
    for i in range(len(values)):
        last = values[max(0, i - 20):i]
        total = peak = drop = 0.0
        for v in last:
            total += v
            peak = max(peak, total)
            drop = max(drop, peak - total)
        mean = sum(last) / len(last) if last else 0.0
        rate = sum(v > 0 for v in last) / len(last) if last else 0.0
        want = ("warmup" if len(last) < 10 else "negative-expectancy" if mean <= 0 else "low-win-rate" if rate < 0.35
                else "drawdown" if drop > 5 else "eligible")
        assert got[i].reason == want and got[i].sample_size == len(last)
        assert got[i].max_drawdown_r == pytest.approx(drop)


def loop_bootstrap(fold_profits, draws):
    from test_functions import sequential

    per = sum(-(-len(p) // max(1, min(10, len(p) // 2))) for p in fold_profits)
    stream = iter(sequential(0xC0FFEE, draws * per))
    medians = []
    for _ in range(draws):
        sums = []
        for profits in fold_profits:
            n, total, done = len(profits), 0.0, 0
            size = max(1, min(10, n // 2))
            while done < n:
                start, take = int(next(stream) * n), min(size, n - done)
                total += sum(profits[(start + i) % n] for i in range(take))
                done += take
            sums.append(total)
        medians.append(statistics.median(sums))
    return sorted(medians)[int(0.9 * draws)]


@pytest.mark.parametrize("chunk, part", [(2, 131_072), (4096, 131_072), (3, 7), (4096, 23)])
def test_block_bootstrap_against_a_loop(spark, chunk, part):
    rng = random.Random(9)
    lists = [[round(rng.uniform(-5, 6), 2) for _ in range(n)] for n in (23, 1, 40)]
    rows = [("s", f"f{k}", f"S{i:03d}", p) for k, ps in enumerate(lists) for i, p in enumerate(ps)]
    sums = resample.bootstrap_fold_sums(make_trades(spark, rows), draws=60, chunk=chunk, part=part, draw_chunk=25)
    medians = sorted(r.m for r in sums.groupBy("draw").agg(F.median("fold_sum").alias("m")).collect())
    assert medians[54] == pytest.approx(loop_bootstrap(lists, 60))


def test_significance_gate_cases(spark):
    rows = []
    for name, profit, n in (("base", 1.0, 8), ("better", 5.0, 8), ("same", 1.0, 8), ("tiny", 1.0, 2), ("worse", -9.0, 8)):
        rows += [(name, f"f{k}", f"S{i}", profit + 0.01 * i) for k in range(3) for i in range(n)]
    rows += [("other", "f0", "S1", 9.0), ("skips", "f0", "S1", -400.0), ("skips", "f1", "S1", -400.0)]
    names = ["base", "better", "same", "tiny", "worse", "skips", "idle"]
    declared = [(s, f"f{k}", f"200{k}-01-01", f"200{k}-12-31") for s in names for k in range(3)] + [("other", "f0", "2000-01-01", "2000-12-31")]
    pairs = [("better", "base"), ("same", "base"), ("better", "tiny"), ("worse", "tiny"), ("other", "base"), ("skips", "base"),
             ("idle", "base"), ("better", "idle"), ("better", "gone")]
    got = {(r.candidate, r.incumbent): r for r in resample.significance_gate(
        make_trades(spark, rows), spark.createDataFrame(pairs, "candidate string, incumbent string"),
        spark.createDataFrame(declared, "strategy string, fold string, start string, end string"), 100).collect()}
    assert len(got) == len(pairs)
    verdict = {k: (r.passed, r.waived, r.inconclusive) for k, r in got.items()}
    assert verdict["better", "base"] == (True, False, False)
    assert verdict["same", "base"] == (False, False, False)
    assert verdict["better", "tiny"] == (True, False, True) and verdict["worse", "tiny"] == (False, False, True)
    assert verdict["other", "base"] == (True, True, False)
    # A candidate that skips a declared fold is tested, the fold being zero.
    assert verdict["skips", "base"] == (False, False, False) and got["skips", "base"].candidate_median == -400.0
    assert verdict["idle", "base"] == (True, True, False) and verdict["better", "gone"] == (True, True, False)
    assert verdict["better", "idle"] == (True, False, True) and got["better", "idle"].incumbent_q90 == 0


def test_every_verdict_of_the_gate_occurs(spark):
    rows = QUERIES["significance_gate"](spark, "/root/testdata/sf0.01").select("passed", "waived", "inconclusive").distinct().collect()
    assert {tuple(r) for r in rows} == {(True, False, False), (False, False, False), (True, True, False), (True, False, True), (False, False, True)}


def test_a_parameter_product_is_never_cut(spark):
    assert resample.parameter_grid(spark, {"a": [1, 2, 3], "b": list(range(5))}).count() == 15
    with pytest.raises(ValueError):
        resample.parameter_grid(spark, {"a": [1, 2, 3], "b": list(range(5))}, budget=8)


def test_ruin_paths_do_not_depend_on_chunks(spark):
    rng = random.Random(3)
    pool = spark.createDataFrame([("s", i, 30, rng.uniform(-1, 1.4)) for i in range(30)],
                                 "strategy string, pos bigint, group_rows bigint, r double")
    key = lambda df: {(r.rate, r.path): (r.final, r.max_drawdown) for r in df.collect()}
    whole = key(risk.ruin_paths(pool, [0.01, 0.2], paths=12, path_chunk=5))
    cut = key(risk.ruin_paths(pool, [0.01, 0.2], paths=12, step_chunk=7, pool_chunk=4))
    assert set(whole) == set(cut) and len(whole) == 24
    for k in whole:
        assert whole[k] == pytest.approx(cut[k])


@pytest.mark.parametrize("parts", [5, 50])
def test_picks_are_drawn_once_whatever_the_parts(spark, parts):
    """Requests hold each pick once, and their number grows with the pool only."""
    chunk, paths, rates = 20, 6, [0.01, 0.02]
    n = chunk * parts
    pool = spark.range(n).select(F.lit("s").alias("strategy"), F.col("id").alias("pos"), F.lit(n).cast("bigint").alias("group_rows"),
                                 F.sin("id").alias("r"))
    jobs = risk.ruin_jobs(pool, rates, paths, 4, 64)
    asked = risk.ruin_requests(jobs, chunk)
    assert asked.select(F.sum(F.size("at"))).first()[0] == paths * len(rates) * n
    assert asked.select("part").distinct().count() == parts
    assert asked.count() <= jobs.count() * parts
    whole = {(r.rate, r.path): r.final for r in risk.ruin_paths(pool, rates, paths=paths).collect()}
    cut = {(r.rate, r.path): r.final for r in risk.ruin_paths(pool, rates, paths=paths, path_chunk=4, step_chunk=64, pool_chunk=chunk).collect()}
    assert cut == pytest.approx(whole) and len(cut) == paths * len(rates)
    trades = spark.range(n).select(F.lit("s").alias("strategy"), F.lit("f").alias("fold"))
    blocks = resample.bootstrap_jobs(trades, 30, 8, 7)
    asked = resample.block_requests(blocks, 1, chunk)
    assert asked.select(F.sum(F.size("at"))).first()[0] == 30 * (n // 10)


def test_a_loss_beyond_the_capital_stays_a_loss(spark):
    pool = spark.createDataFrame([("s", i, 6, r) for i, r in enumerate([-60.0, 1.0, 2.0, 1.5, -0.5, 3.0])],
                                 "strategy string, pos bigint, group_rows bigint, r double")
    dates = spark.createDataFrame([("s", i, dt.date(2000, 1, 1 + i)) for i in range(6)], "strategy string, pos bigint, exit_date date")
    walked = risk.ruin_paths(pool, [0.02], paths=40)
    final = sorted(r.final for r in walked.collect())
    assert final[0] < 0
    rows = risk.capital_envelope(pool, dates, walked, [0.02]).where("step = 6").collect()
    got = {r.band: r.capital for r in rows}
    assert got == {b: pytest.approx(10_000 * final[int(q * 40)], abs=0.01) for b, q in (("p5", 0.05), ("p50", 0.5), ("p95", 0.95))}


def test_paths_beyond_the_doubles_keep_their_drawdown(spark):
    """Growth of 2 ** 1500 and then a loss of half: no capital is held as a double."""
    rows = [("s", i, 1600, 50.0 if i else -25.0) for i in range(1600)]
    pool = spark.createDataFrame(rows, "strategy string, pos bigint, group_rows bigint, r double")
    seed = risk.ruin_seeds(pool, [0.02]).first().seed
    for more in ({}, {"step_chunk": 70, "pool_chunk": 400}):
        got = {r.path: r.max_drawdown for r in risk.ruin_paths(pool, [0.02], paths=20, **more).collect()}
        for path, drawdown in got.items():
            power = top = depth = 0
            for u in uniform_block(seed, path * 1600, 1600):
                power += 1 if int(u * 1600) else -1
                top = max(top, power)
                depth = max(depth, top - power)
            assert drawdown == pytest.approx(1 - 0.5**depth)
        assert len(got) == 20


def test_envelope_counts_capital_beyond_a_bigint(spark):
    pool = spark.createDataFrame([("s", i, 200, 50.0) for i in range(200)], "strategy string, pos bigint, group_rows bigint, r double")
    dates = spark.createDataFrame([("s", i, day(i)) for i in range(200)], "strategy string, pos bigint, exit_date date")
    rows = risk.capital_envelope(pool, dates, risk.ruin_paths(pool, [0.02], paths=20), [0.02]).where("step IN (100, 200)").collect()
    assert {(r.step, r.capital) for r in rows} == {
        (step, 10_000 * math.exp(float(step * Decimal("0.693147180559945")))) for step in (100, 200)}


def test_overfitting_has_no_limit_of_folds(spark):
    rng = random.Random(1)
    many = {f"s{i}": [rng.random() for _ in range(17)] for i in range(2)}
    got = evidence.pbo(vectors(spark, many)).first()
    assert got.splits == 24310 and 0 <= got.probability <= 1


def test_capital_envelope_follows_its_path(spark):
    pool = spark.createDataFrame([("s", i, 9, [0.5, -1.0, 1.2][i % 3]) for i in range(9)],
                                 "strategy string, pos bigint, group_rows bigint, r double")
    dates = spark.createDataFrame([("s", i, day(i)) for i in range(9)], "strategy string, pos bigint, exit_date date")
    walked = risk.ruin_paths(pool, [0.02], paths=20)
    got = risk.capital_envelope(pool, dates, walked, [0.02]).collect()
    finals = sorted(r.final for r in walked.collect())
    last = {r.band: r.capital for r in got if r.step == 9}
    assert last == {b: pytest.approx(10_000 * finals[int(20 * q)], abs=0.01) for b, q in (("p5", .05), ("p50", .5), ("p95", .95))}
    assert sorted(r.step for r in got if r.band == "p5") == list(range(10))


def test_choose_risk_rate_tiers(spark):
    rows = [("s", 0.005, 0.2, 0.0, 0.10, 4.0, 5.0), ("s", 0.01, 0.5, 0.0, 0.20, 8.0, 6.0),
            ("s", 0.015, 0.505, 0.005, 0.30, 12.0, 7.0), ("s", 0.02, 0.4, 0.03, 0.50, 20.0, 9.0)]
    df = spark.createDataFrame(rows, "strategy string, rate double, sortino double, ruin_probability double, "
                                     "drawdown95 double, return_pct double, max_drawdown_pct double")
    got = {r.profile: r.rate for r in risk.choose_risk_rate(df).collect()}
    assert got == {"conservative": 0.005, "moderate": 0.01, "aggressive": 0.015}


def test_python_rules_see_each_window_once(spark):
    """Windows that cross batches and symbols, a rule that raises or writes, and short histories."""
    rng, rows = random.Random(5), []
    for symbol, n in (("A", 23), ("B", 4), ("C", 5), ("D", 1), ("E", 60)):
        for i in range(n):
            p = rng.uniform(90, 110)
            rows.append((symbol, dt.date(2020, 1, 1) + dt.timedelta(days=i), p, p + 1, p - 1, p + 0.5, i, i + 1))
    bars = spark.createDataFrame(rows, "symbol string, bar_date date, open double, high double, low double, close double, volume bigint, seq int")
    want = set()
    for symbol, day_, *_, seq in rows:
        closes = [r[5] for r in rows if r[0] == symbol][:seq][-5:]
        if len(closes) == 5 and closes[-1] < sum(closes) / 5:
            want.add((symbol, day_, seq, closes[0], round(sum(closes), 6)))

    def rule(history):
        close = history["close"]
        assert len(close) == 5
        if close[-1] >= close.mean():
            return None
        return {"side": "long", "entry_min": float(close[0]), "entry_max": round(float(sum(close)), 6), "stop_loss": 1.0, "target": None,
                "max_hold_days": 3, "setup": "x", "regime": "y", "confidence": None}

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        fired = signals.signal_rule_pandas(bars, rule, "r", lookback=5)
        assert {(r.symbol, r.signal_date, r.seq, r.entry_min, r.entry_max) for r in fired.collect()} == want and len(want) > 20
        assert "collect_list" not in fired._jdf.queryExecution().toString()
        for broken in (lambda h: h["none"], lambda h: h["close"].sort()):
            assert signals.signal_rule_pandas(bars, broken, "r", lookback=5).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_redundancy_without_resampling_every_pair(spark):
    """Same flags as the full report; pairs that are not alike stop early."""
    rng = random.Random(6)
    made = {f"s{i}": [rng.gauss(0, 1) for _ in range(9)] for i in range(24)}
    for i in range(6):
        made[f"n{i}"] = [v * (1 + i) + rng.gauss(0, 0.02 * (i + 1) ** 2) for v in made[f"s{i}"]]
    trades = spark.createDataFrame([(s, f"f{k}", "both" if s in ("s1", "n1") else s, p, day(k), day(k + 1)) for s, ps in made.items() for k, p in enumerate(ps)],
                                   "strategy string, fold string, symbol string, profit double, entry_date date, exit_date date")
    pairs = evidence.pair_lineages(vectors(spark, made))
    full = evidence.redundant_pairs(resample.correlation_ci(evidence.fold_correlation(pairs)), evidence.trade_overlap(trades, pairs))
    want = {(r.a, r.b) for r in full.where("flagged").collect()}
    got = {(r.a, r.b) for r in evidence.surely_redundant(pairs, trades).collect()}
    assert got == want and 1 <= len(want) < 6 and ("n1", "s1") not in want
    judged = resample.surely_correlated(evidence.fold_correlation(pairs), 0.9).collect()
    sure = {(r.a, r.b) for r in full.where("lower >= 0.9").collect()}
    assert {(r.a, r.b) for r in judged if r.sure} == sure
    assert sum(r.drawn for r in judged) < 0.2 * 2000 * len(judged)


def test_every_verdict_of_the_registered_checks_occurs(spark):
    folder = "/root/testdata/sf0.01"
    values = lambda name, column: {r[0] for r in QUERIES[name](spark, folder).select(column).distinct().collect()}
    assert values("admit_candidate", "decision") == {"same-rule", "same-trades", "redundant", "admitted"}
    assert values("audit_verdict", "verdict") == {"killed", "weakened", "survived"}
    assert values("fold_signature", "is_dominant") == {True, False}
    assert values("redundant_pairs", "flagged") == {True, False}
    assert QUERIES["diverse_partner"](spark, folder).count() == 1 and QUERIES["best_per_lineage"](spark, folder).count() > 5


# ---- bars, signals, outcomes ----------------------------------------------------------
def test_screen_finds_a_planted_jump(spark):
    rows, close = [], 100.0
    for i in range(300):
        opening = close
        close = close * (1.02 if i >= 2 and (i - 2) % 10 == 0 else 1.0)
        rows.append((opening, max(opening, close), min(opening, close), close))
    seq = features.bar_seq(make_bars(spark, rows))
    fired = seq.where((F.col("seq") >= 20) & ((F.col("seq") - 1) % 10 == 0)).select(
        F.lit("jump").alias("strategy"), "symbol", F.col("bar_date").alias("signal_date"), "seq",
        F.lit("long").alias("side"), F.lit(3).alias("max_hold_days"))
    got = signals.signal_screen(seq, fired, minimum=10, lookback=20).first()
    assert got.applies and got.passed and got.alpha > 0.01


def test_outcome_reasons_on_one_path(spark):
    flat = (100.0, 100.5, 99.5, 100.0)
    bars = features.bar_seq(make_bars(spark, [flat] * 95 + [(100, 107, 99, 106), flat, flat, flat, (100, 101, 94, 95)]))

    def proposals(rows):
        data = [("s", "AAA", day(s - 1), s, side, 99.0, 101.0, stop, target, hold, "a", "b", None) for s, side, stop, target, hold in rows]
        return spark.createDataFrame(data, "strategy string, symbol string, signal_date date, seq int, side string, entry_min double, "
                                           "entry_max double, stop_loss double, target double, max_hold_days int, setup string, regime string, confidence double")

    def run(rows):
        return {r.seq: r for r in outcomes.trade_outcomes(bars, proposals(rows)).collect()}

    assert run([(91, "long", 95.0, 106.0, 30)])[91].reason == "target"
    assert run([(96, "long", 95.0, 106.0, 30)])[96].reason == "stop"
    timed = run([(91, "long", 95.0, 120.0, 1)])[91]
    assert timed.reason == "time_stop" and timed.exit_date == day(92)  # leaves on its second bar
    left = run([(91, "long", 90.0, 120.0, 30), (93, "short", 105.0, 90.0, 5)])
    assert left[91].reason == "Short Signal" and left[91].exit_date == day(93)
    assert run([(91, "long", 90.0, 120.0, 30)])[91].reason == "open"
    trailed = run([(91, "long", 90.0, None, 30), (93, "long", 99.4, None, 30), (94, "long", 99.6, None, 30)])[91]
    assert trailed.reason == "stop" and trailed.exit_date == day(94)  # the raised stop works from the next bar


def test_outcomes_on_bars_are_those_of_joins(spark):
    """Stops that trail, targets that go, exits asked for, paths that the data ends, fills missed, no target, no hold."""
    rng = random.Random(5)
    rows, data = {}, []
    for symbol in ("AAA", "BBB", "CCC"):
        close, rows[symbol] = 100.0, []
        for _ in range(260):
            opening, close = close, close * (1 + rng.uniform(-0.03, 0.03))
            rows[symbol].append((opening, max(opening, close) * 1.005, min(opening, close) * 0.995, close))
        for s in range(80, 261):
            for name in rng.sample(["a", "b"], rng.choice([0, 1, 1, 2])):
                at = rows[symbol][s - 1][3]
                data.append((name, symbol, day(s - 1), s, rng.choice(["long", "long", "long", "short"]), at * 0.985, at * 1.01, at * rng.uniform(0.9, 0.98),
                             rng.choice([None, at * 1.05]), rng.choice([None, 0, 1, 2, 3, 12]), "x", "y", rng.choice([None, 0.5])))
    bars = features.bar_seq(make_bars(spark, rows["AAA"]).unionByName(make_bars(spark, rows["BBB"], "BBB")).unionByName(
        make_bars(spark, rows["CCC"], "CCC")))
    proposals = spark.createDataFrame(data, "strategy string, symbol string, signal_date date, seq int, side string, entry_min double, "
                                            "entry_max double, stop_loss double, target double, max_hold_days int, setup string, regime string, confidence double")
    proposals = proposals.where(F.col("seq") >= 90)
    mine = ["strategy", *signals.PROPOSAL_COLUMNS[4:]]
    asked = bars.join(proposals.groupBy("symbol", "seq").agg(F.collect_list(F.struct(*mine)).alias("asked")), ["symbol", "seq"], "left")
    want = outcomes.trade_outcomes(bars, proposals)
    got = outcomes.asked_outcomes(asked, 12).select(*want.columns).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want.collect()))
    assert {r.reason for r in got} == {"stop", "target", "time_stop", "Short Signal", "open"} and len(got) < proposals.where("side = 'long'").count()
    with pytest.raises(Exception, match="to be held for more than 11 bars: 12"):
        outcomes.asked_outcomes(asked, 11).collect()


def test_asked_bars_hold_the_rows_of_the_rules(spark):
    bars = features.bar_seq(make_bars(spark, [(100.0, 101.0, 99.0, 100.0 + i % 7) for i in range(100)]))
    rows = rules.featured(bars)
    asked = signals.asked_bars(rows, *rules.example_rules()).select(
        "symbol", F.col("bar_date").alias("signal_date"), "seq", F.explode("asked").alias("p")).select("symbol", "signal_date", "seq", "p.*")
    want = signals.signal_rule(rows, *rules.example_rules())
    assert sorted(map(repr, asked.select(*want.columns).collect())) == sorted(map(repr, want.collect())) != []


def test_asof_index_and_forecast_joins(spark):
    bars = make_bars(spark, [(1, 1, 1, 1)] * 6).where(F.dayofmonth("bar_date").isin(1, 3, 4, 6))
    market = spark.createDataFrame([("index", day(1), 7.0), ("index", day(2), 8.0), ("index", day(3), 9.0)],
                                   "role string, bar_date date, close double")
    aligned = [r.index_close for r in context.align_market_index(bars, market).orderBy("bar_date").collect()]
    assert aligned == [None, 8.0, 9.0, 9.0]
    asof = [r.context for r in context.market_asof(bars, market, F.col("close")).orderBy("bar_date").collect()]
    assert asof == [None, 8.0, 9.0, 9.0]
    strict = [r.context for r in context.market_asof(bars, market, F.col("close"), strict=True).orderBy("bar_date").collect()]
    assert strict == [None, 7.0, 8.0, 9.0]


def test_forecast_metrics_hand_values(spark):
    rows = [("A", day(0), "m", 1, 100.0, 102.0, 101.0, [97.0 + i for i in range(9)]),
            ("A", day(1), "m", 1, 100.0, 98.0, 99.0, [95.0 + i for i in range(9)])]
    df = spark.createDataFrame(rows, "symbol string, origin date, model string, horizon int, origin_price double, actual_price double, "
                                     "forecast_price double, quantiles array<double>")
    got = forecasts.forecast_metrics(df, 0.0).where("group = 'overall'").first()
    assert (got.n, got.direction_hits) == (2, 2) and got.return_mae_pp == pytest.approx(1.0)
    cal = forecasts.quantile_calibration(df).first()
    assert cal.interval_coverage_pct == 100.0 and cal.interval_width_pp == pytest.approx(8.0)


def test_scorer_rejects_crossed_quantiles(spark):
    windows = spark.createDataFrame([("A", day(0), [1.0, 2.0, 3.0])], "symbol string, origin date, history array<double>")
    bad = lambda h, horizon: (h[:, -1], np.tile(np.arange(9.0)[::-1], (len(h), 1)))
    with pytest.raises(Exception, match="crossed quantiles"):
        forecasts.forecast_scorer(windows, bad, "bad", [1]).collect()


def test_future_rows_change_nothing_before_them(spark):
    rows = [(99.0 + i, 102.0 + i, 98.0 + i, 100.0 + i) for i in range(92)]
    base = features.bar_seq(make_bars(spark, rows))
    cut = day(80)
    changed = base.withColumn("adj_close", F.when(F.col("bar_date") > F.lit(cut), F.col("adj_close") * 3).otherwise(F.col("adj_close")))

    def made(bars):
        origins = forecasts.rolling_windows(bars, 32, 2, [1, 5], "2024-02-01", "2024-03-31")
        targets = forecasts.forecast_targets(bars, origins, [1, 5])
        return forecasts.baseline_momentum(targets, bars).where(F.col("origin") <= F.lit(cut)).select(
            "origin", "horizon", "forecast_price").orderBy("origin", "horizon").collect()

    assert made(base) == made(changed) != []


def test_replicas_without_noise_equal_the_original(spark, monkeypatch):
    bars = features.bar_seq(make_bars(spark, [(100.0 + i, 101.0 + i, 99.0 + i, 100.5 + i) for i in range(6)]))
    monkeypatch.setattr(resample, "perturb_prices", lambda b, seed: b)
    got = resample.plateau_replicas(bars, 2, lambda b: b.groupBy("symbol").agg(F.sum("close").alias("c")))
    assert {(r.replica, r.symbol) for r in got.collect()} == {(1, "AAA"), (2, "AAA")}


def test_parameter_grid_keeps_order(spark):
    got = resample.parameter_grid(spark, {"a": [1, 2, 3], "b": ["x", "y", "z"]}, budget=9).orderBy("point").collect()
    assert [(r.a, r.b) for r in got] == [(a, b) for a in (1, 2, 3) for b in "xyz"]


def test_pairs_are_only_those_asked_for(spark):
    all_ = vectors(spark, {"a": [1, 2, 3], "b": [2, 3, 1], "c": [3, 1, 2], "d": [1, 1, 2]})
    old = F.col("strategy").isin("a", "d")
    got = {(r.a, r.b) for r in evidence.pair_lineages(all_.where(~old), all_.where(old), cell=1).collect()}
    assert got == {("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")}
    one = make_trades(spark, [("a", "f", "S1", 1.0)])
    trades = one.unionByName(one.withColumn("strategy", F.lit("b"))).unionByName(one.withColumn("strategy", F.lit("c")))
    overlap = evidence.trade_overlap(trades, spark.createDataFrame([("a", "b")], "a string, b string")).collect()
    assert [(r.a, r.b, r.shared_trades, r.jaccard) for r in overlap] == [("a", "b", 1, 1.0)]


def test_a_fold_of_many_trades_is_drawn_in_bounded_memory(spark):
    import tracemalloc

    import numpy as np
    import pyarrow as pa
    from sparkfolio.functions.ordering import packed, unpacked

    rng = random.Random(4)
    rows = [("s", f"f{k}", f"S{i:03d}", round(rng.uniform(-5, 6), 2)) for k, n in enumerate((23, 1, 40)) for i in range(n)]
    sums = lambda **how: {(r.fold, r.draw): r.fold_sum for r in resample.bootstrap_fold_sums(make_trades(spark, rows), draws=30, **how).collect()}
    assert sums(part=7, whole=1) == pytest.approx(sums(whole=100)) and len(sums(whole=23)) == 90
    frame = spark.range(1000).selectExpr("id % 2 AS k", "id DIV 2 AS pos", "sin(id) AS x").repartition(3)
    table = packed(frame.where("k = 1"), ["k"], ["x"]).toArrow()
    assert np.array_equal(unpacked(table, "x", 500), [r.x for r in frame.where("k = 1").sort("pos").collect()])
    n, one = 200_000, lambda x: pa.array([x], pa.int64())
    values = pa.array([np.ones(n)])
    table = pa.table({"strategy": ["s"], "fold": ["f"], "start": one(0), "full_sum": values, "last_sum": values, "_n": one(n),
                      "blocks": one(n // 10), "per_draw": one(n // 10), "before": one(0)})
    tracemalloc.start()
    got = resample._drawn_sums(200, 1, 4096, 25)(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["fold_sum"].to_pylist() == [n // 10] * 200 and peak < 20_000_000  # its 4,000,000 picks at once take 32 MB and more


def test_pools_of_any_size_walk_the_same_paths(spark):
    rng = random.Random(8)
    pool = spark.createDataFrame([(s, i, n, rng.uniform(-2, 2.2)) for s, n in (("a", 40), ("b", 7), ("c", 1)) for i in range(n)],
                                 "strategy string, pos bigint, group_rows bigint, r double").repartition(3)
    walk = lambda **how: {(r.strategy, r.rate, r.path): (r.final, r.max_drawdown) for r in risk.ruin_paths(
        pool, [0.01, 0.6], paths=11, path_chunk=4, step_chunk=8, **how).collect()}
    held, asked = walk(whole=40), walk(whole=0, pool_chunk=16)
    assert set(held) == set(asked) == set(walk(whole=7)) and len(held) == 66
    for key, value in held.items():
        assert value == pytest.approx(asked[key])


def test_histories_are_not_shuffled(spark):
    bars = features.bar_seq(make_bars(spark, [(i, i, i, i) for i in range(1, 9)]))
    origins = spark.createDataFrame([("AAA", day(i - 1), i, float(i), fold) for i, fold in ((2, "a"), (4, "a"), (4, "b"), (8, "a"))],
                                    "symbol string, origin date, seq int, origin_price double, fold string")
    got = forecasts.window_history(bars, origins, 3)
    assert sorted((r.seq, r.fold, r.origin, r.history) for r in got.collect()) == [
        (4, "a", day(3), [2.0, 3.0, 4.0]), (4, "b", day(3), [2.0, 3.0, 4.0]), (8, "a", day(7), [6.0, 7.0, 8.0])]
    above = got._jdf.queryExecution().sparkPlan().toString().split("Window")[0]
    assert "Join" not in above
