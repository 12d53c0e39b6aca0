"""Steps whose cost has to grow no faster than their input: what crosses, what is computed again, what meets in one task."""

import datetime as dt
import hashlib
import itertools
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from sparkfolio import session
from sparkfolio.operators import evidence
from sparkfolio.plans import queries
from sparkfolio.plans.queries import Tables, by_symbol
from sparkfolio.sources import artifacts, derived, forecast_store


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def above(text, pattern):
    """Plan lines on the way from the first line that matches to the root."""
    lines = [x for x in text.splitlines() if x.strip()]
    depth = lambda x: len(re.match(r"[\s:+\-]*", x).group())
    at = next(i for i, x in enumerate(lines) if re.search(pattern, x))
    out, level = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < level:
            out, level = [*out, line], depth(line)
    return out


@pytest.fixture
def merge_joins(spark):
    """Joins as of tables too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("build", [derived.bars, derived.raw_bars])
def test_line_items_cross_once_for_bars(spark, sf, build):
    text = plan(by_symbol(build(spark, sf)))
    assert text.count("Exchange hashpartitioning") == 1
    assert "Exchange" not in "".join(above(text, r"Aggregate\(")[:-1]) and "Aggregate" not in text.split("Exchange hashpartitioning")[1]


def test_folds_need_no_bars(spark, sf, monkeypatch):
    monkeypatch.setattr(session, "_STORED", {})
    by_bars = derived.calendar_folds(derived.bars(spark, sf)).collect()
    monkeypatch.setattr(Tables, "bars", property(lambda self: pytest.fail("bars were made for a calendar")))
    assert sorted(Tables(spark, sf).folds.collect()) == sorted(by_bars)


def test_sums_of_row_hashes_by_hand(spark):
    """Texts of doubles are no part of the plan's expressions, and parts of sums pass 64 bits."""
    values = [0.1, -1.5, 0.0, None, 2.0**-1074, 1.7e308, 123.456] * 30
    rows = spark.createDataFrame([("k", v, float(i)) for i, v in enumerate(values)], "k string, v double, w double")

    def text(v):
        if v is None or v == 0:
            return "~" if v is None else "0"
        part, power = Fraction(v), 0
        while abs(part) >= 2**53:
            part, power = part / 2, power - 1
        while abs(part) < 2**52:
            part, power = part * 2, power + 1
        return f"{part.numerator}p{power}"

    want = [0] * 4
    for i, v in enumerate(values):
        digest = hashlib.sha256(f"{text(v)}|{text(float(i))}".encode()).hexdigest()
        want = [w + int(digest[15 * k:15 * k + 15], 16) for k, w in enumerate(want)]
    sums = evidence.row_sums(rows, ["k"], ["v", "w"])
    got = sums.first()
    assert [int(got[name]) for name in evidence.DIGEST] == want and got.rows == len(values) and max(want) > 2**63
    assert "LOG2" not in plan(sums)
    with pytest.raises(Exception, match="not finite"):
        evidence.row_sums(rows.withColumn("v", F.lit(float("nan"))), ["k"], ["v"]).collect()


@pytest.mark.parametrize("few", [1, 3, 16])
def test_overlap_of_few_and_many_holders(spark, few):
    """Counted where trades lie or by the asked pairs, the same; missing values equal none; pairs in either order."""
    day = dt.date(2025, 1, 1)
    rows = [(s, f"S{k}", "f", day, day if k % 7 else None) for k in range(40) for i, s in enumerate("abcdef") if k % (i + 1) == 0]
    trades = spark.createDataFrame(rows * 2, "strategy string, symbol string, fold string, entry_date date, exit_date date")
    asked = [("b", "a"), *itertools.combinations("acdef", 2)]
    sets = {s: {r[1:] for r in rows if r[0] == s} for s in "abcdef"}
    want = set()
    for a, b in asked:
        shared = len({x for x in sets[a] & sets[b] if None not in x})
        want.add((a, b, shared, round(shared / (len(sets[a]) + len(sets[b]) - shared), 9)))
    got = evidence.trade_overlap(trades, spark.createDataFrame(asked, "a string, b string"), few=few).collect()
    assert {(r.a, r.b, r.shared_trades, round(r.jaccard, 9)) for r in got} == want and len(got) == len(asked)


def test_a_campaign_is_not_taken_to_one_task(spark, tmp_path, monkeypatch, merge_joins):
    batch = spark.createDataFrame(
        [("c", "A", dt.date(2025, 1, 2), "m", h, dt.date(2025, 1, 3), 1.0) for h in (1, 5)],
        "campaign string, symbol string, origin date, model string, horizon int, target_date date, forecast_price double")
    path, seen, merge = str(tmp_path / "store"), [], forecast_store.merge_forecasts
    monkeypatch.setattr(forecast_store, "merge_forecasts", lambda stored, *x: seen.append(plan(stored)) or merge(stored, *x))
    forecast_store.store_batch(spark, path, batch)
    forecast_store.store_batch(spark, path, batch.withColumn("forecast_price", F.lit(2.0)), replace=True)
    assert [r.forecast_price for r in forecast_store.read_forecasts(spark, path, batch).collect()] == [2.0, 2.0]
    assert "Exchange" not in "".join(above(seen[0], "FileScan|Scan parquet"))


def test_nested_trades_stay_where_they_were_nested(spark, tmp_path, monkeypatch, merge_joins):
    day = dt.date(2025, 1, 1)
    trades = spark.createDataFrame([("s", "f", f"S{k}", day, day, float(k)) for k in range(25)],
                                   "strategy string, fold string, symbol string, entry_date date, exit_date date, profit double")
    folds = spark.createDataFrame([("s", f, 1.0, day, day) for f in ("f", "empty")], "strategy string, fold string, profit double, start date, end date")
    scores = spark.createDataFrame([("s", 2.0)], "strategy string, score double")
    seen, path = [], str(tmp_path / "a")
    writer = type(trades.write)
    json = writer.json
    monkeypatch.setattr(writer, "json", lambda self, *x, **y: seen.append(plan(self._df)) or json(self, *x, **y))
    artifacts.write_artifacts(trades, folds, scores, path, part_rows=10)
    assert not [x for x in above(seen[0], r"(?<!partial_)collect_list\(") if "Exchange" in x]
    lines = artifacts.read_artifacts(spark, path)
    assert lines.count() == 4 and artifacts.artifact_trades(lines).count() == 25
    assert sorted(r.fold for r in artifacts.artifact_segments(lines).collect()) == ["empty", "f"]


def test_replicas_cross_by_symbol_only(spark, sf, monkeypatch, merge_joins):
    """Line items and symbols' numbers cross once for all replicas, then sums per day: no bar, proposal or path does."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan shows what is reused
    try:
        caught = []
        monkeypatch.setattr(queries, "written", lambda df, name: caught.append(df) or df)
        assert queries.QUERIES["plateau_replicas"](spark, sf).columns
        text = plan(caught[0])
        assert caught[0].count() > 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    crossed = [re.sub(r"#\d+", "", x) for x in re.findall(r"\+- Exchange hashpartitioning\(([^)]*?), \d+\)", text)]
    crossed = [x for x in crossed if "_all" not in x]  # the pieces of the symbols' numbering
    assert sorted(crossed) == ["replica, strategy, exit_date", "symbol", "symbol"] and text.count("ReusedExchange") == 2
