"""Files, stores, streams, and a few registered queries end to end."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparkfolio.sources import artifacts, forecast_store, prices
from sparkfolio.streaming import streams

HEADER = "volume,date,symbol,open,high,low,close,adj_close,provider_note\n"


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_csv_columns_in_any_order(spark, tmp_path):
    path = write(tmp_path, "a.csv", HEADER + '1000,2025-01-02,TEST.AX,10,11,9,10.5,10.4,"said ""hi"", twice"\n'
                 "1100,2025-01-03,TEST.AX,10.5,12,10,11,10.9,\n")
    rows = prices.require_valid(prices.read_prices_csv(spark, path)).orderBy("bar_date").collect()
    assert [(r.symbol, r.bar_date, r.close, r.volume) for r in rows] == [
        ("TEST.AX", dt.date(2025, 1, 2), 10.5, 1000), ("TEST.AX", dt.date(2025, 1, 3), 11.0, 1100)]


def test_csv_missing_column_and_bad_rows(spark, tmp_path):
    with pytest.raises(ValueError, match="adj_close"):
        prices.read_prices_csv(spark, write(tmp_path, "b.csv", "symbol,date,open,high,low,close,volume\nA,2025-01-02,1,1,1,1,1\n"))
    bad = HEADER + "".join(f"{v}\n" for v in (
        "1,2025-1-2,A,1,1,1,1,1,", "1,2025-02-30,A,1,1,1,1,1,", "1.5,2025-01-02,A,1,1,1,1,1,", "1,2025-01-02,A,1,1,2,1,1,",
        "1,2025-01-02,A,1,1,1,0,1,", "1,2025-01-02,,1,1,1,1,1,", "1,2025-01-02,A,x,1,1,1,1,"))
    rows = prices.read_prices_csv(spark, write(tmp_path, "c.csv", bad))
    assert [r.problems for r in rows.collect()] == [
        ["date"], ["date"], ["volume"], ["range"], ["price"], ["symbol"], ["price"]]
    with pytest.raises(Exception, match="invalid"):
        prices.require_valid(rows).collect()


def test_universe_rejects_ragged_rows(spark, tmp_path):
    good = write(tmp_path, "u.csv", "symbol,name,sector,status\nA,a,s,member\nB,b,s,no-yahoo-data\n")
    assert [r.symbol for r in prices.read_universe(spark, good).collect()] == ["A"]
    with pytest.raises(Exception):
        prices.read_universe(spark, write(tmp_path, "v.csv", "symbol,name,sector,status\nA,a\n")).collect()


def rows_of(spark, *rows):
    return spark.createDataFrame([(s, dt.date.fromisoformat(d), p, p, p, p, p, 1) for s, d, p in rows],
                                 "symbol string, bar_date date, open double, high double, low double, close double, adj_close double, volume bigint")


def test_sync_takes_newer_rows_and_checks_them_all(spark):
    target = rows_of(spark, ("A", "2025-01-03", 1.0))
    source = spark.createDataFrame([(s, d, p, p, p, p, p, 1.0) for s, d, p in [
        ("A", "2025-01-02", 9.0), ("A", "2025-01-04", 2.0), ("B", "2025-01-01", 3.0)]],
        "symbol string, date string, open double, high double, low double, close double, adj_close double, volume double")
    got = {(r.symbol, str(r.bar_date)) for r in prices.sync_newer_rows(source, target).collect()}
    assert got == {("A", "2025-01-04"), ("B", "2025-01-01")}
    broken = source.withColumn("close", F.when(F.col("symbol") == "B", -1.0).otherwise(F.col("close")))
    with pytest.raises(Exception, match="invalid"):
        prices.sync_newer_rows(broken, target).collect()
    old = source.withColumn("close", F.when(F.col("date") == "2025-01-02", -1.0).otherwise(F.col("close")))
    assert prices.sync_newer_rows(old, target).count() == 2


def test_upsert_last_write_wins(spark):
    base = rows_of(spark, ("A", "2025-01-02", 1.0), ("B", "2025-01-02", 5.0))
    batch = rows_of(spark, ("A", "2025-01-02", 2.0)).withColumn("batch_no", F.lit(1)).unionByName(
        rows_of(spark, ("A", "2025-01-02", 3.0)).withColumn("batch_no", F.lit(2)))
    assert {r.symbol: r.close for r in prices.upsert_prices(base, batch).collect()} == {"A": 3.0, "B": 5.0}


def test_forecast_store_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "store")
    make = lambda price: spark.createDataFrame(
        [("c", "A", dt.date(2025, 1, 2), "m", h, dt.date(2025, 1, 3), price) for h in (1, 5)],
        "campaign string, symbol string, origin date, model string, horizon int, target_date date, forecast_price double")
    for price, replace in ((1.0, False), (2.0, False), (3.0, True)):
        forecast_store.store_batch(spark, path, make(price), replace)
        got = [r.forecast_price for r in forecast_store.read_forecasts(spark, path, make(0.0)).collect()]
        assert got == ([3.0, 3.0] if replace else [1.0, 1.0])


def test_artifacts_drop_malformed_members(spark, tmp_path):
    path = write(tmp_path, "e.json", '{"strategy":"a","segments":[{"name":"f1","group":"fold","value":1.5},{"group":"fold","value":2}],'
                 '"trades":[{"fold":"f1","profit":1.0,"symbol":"S"},{"fold":"f1","profit":2.0},{"profit":3.0}]}\nnot json\n')
    rows = artifacts.read_artifacts(spark, path)
    assert [(r.symbol, r.profit) for r in artifacts.artifact_trades(rows).collect()] == [("S", 1.0), ("unknown", 2.0)]
    assert [r.fold for r in artifacts.artifact_segments(rows).collect()] == ["f1"]


def test_members_of_wrong_types_are_dropped_and_counted(spark, tmp_path):
    path = write(tmp_path, "f.json", "\n".join((
        '{"strategy":"a","trades":[{"fold":"f","profit":"1","symbol":"S"},{"fold":2,"profit":1},{"fold":"f","profit":3,"symbol":4},'
        '{"fold":"f","profit":1e400},null,5,{"fold":"f","profit":2.5,"entryDate":"2020-02-30","exitDate":"2020-01-02"}],"segments":7,"folds":[{"name":3},{"name":""},{}]}',
        '{"strategy":9,"trades":{"fold":"f"},"folds":null}', '[1]', 'no json', '{"strategy":"b","segments":[{"name":"s","group":"fold","value":true},'
        '{"name":"s","group":"fold","value":1}]}')))
    rows = artifacts.read_artifacts(spark, path)
    assert rows.count() == 5
    got = sorted((r.symbol, r.profit, str(r.entry_date), str(r.exit_date)) for r in artifacts.artifact_trades(rows).where("profit < 100").collect())
    assert got == [("unknown", 2.5, "None", "2020-01-02"), ("unknown", 3.0, "None", "None")]
    assert [(r.strategy, r.score) for r in artifacts.artifact_segments(rows).collect()] == [("b", 1.0)]
    assert [r.fold for r in artifacts.artifact_folds(rows).collect()] == ["3"]
    losses = {(r.strategy, r.list): (r.members, r.dropped) for r in artifacts.artifact_losses(rows).collect()}
    assert losses["a", "segments"] == (0, 1) and losses["a", "folds"] == (1, 2) and losses["b", "segments"] == (1, 1)
    assert losses[None, "trades"] == (0, 1) and losses[None, "line"] == (0, 2) and sum(losses["a", "trades"]) == 7


def test_trials_read_back_from_files(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    for source in ("agent", "manual", "agent"):
        artifacts.append_trials(spark.createDataFrame([("2025-01-01T00:00:00Z", source, 1.0, True)],
                                                      "timestamp string, source string, score double, accepted boolean"), ledger)
    got = {r.source: r.trials for r in artifacts.trial_summary(artifacts.read_ledger(spark, ledger)).collect()}
    assert got == {"agent": 2, "manual": 1, None: 3}


def test_price_stream_equals_batch(spark, tmp_path):
    base = rows_of(spark, ("A", "2025-01-02", 1.0))
    for i, price in enumerate((2.0, 3.0)):
        spark.createDataFrame([("A", "2025-01-02", price, price, price, price, price, 1.0)], streams.PRICE_FILE_SCHEMA).coalesce(
            1).write.parquet(str(tmp_path / "in" / f"{i}"))
    for _ in range(2):  # a second run finds nothing new
        streams.stream_upsert_prices(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "ck")).awaitTermination()
    assert [r.close for r in streams.current_prices(spark, str(tmp_path / "t"), base).collect()] == [3.0]


@pytest.mark.parametrize("name", ["stream_pair_events", "stream_trials", "signal_screen", "trade_outcomes", "promotion_decision"])
def test_registered_queries_match_their_sql(spark, sf, name):
    import duckdb

    from compare import TABLES, normal

    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    assert normal(entry.queries()[name](spark, sf).toPandas()) == normal(duck.execute(entry.oracle_sql()[name]).df())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_a_table_of_calls_is_paired_without_limit(spark):
    rows = [("a", "start", dt.datetime(2024, 1, 1)), ("a", "end", dt.datetime(2024, 1, 3)), ("b", "end", dt.datetime(2024, 1, 3))]
    events = spark.createDataFrame([(c, k, t, "tool", "ok", "x") for c, k, t in rows],
                                   "call_id string, kind string, ts timestamp, tool string, status string, text string")
    got = {r.call_id: r.duration_ms for r in streams.pair_events(events).collect()}
    assert got == {"a": 2 * 86_400_000, "b": None}


def test_bad_rows_fail_whatever_is_read(spark):
    rows = [("AAA", "2020-01-01", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), ("AAA", "2020-01-02", 1.0, 1.0, 1.0, -5.0, 1.0, 1.0)]
    frame = spark.createDataFrame(rows, "symbol string, date string, open double, high double, low double, close double, "
                                        "adj_close double, volume double")
    checked = prices.require_valid(prices.with_problems(frame))
    for action in (lambda: checked.select("close").collect(), checked.count, checked.collect):
        with pytest.raises(Exception, match="invalid"):
            action()


def test_a_broken_store_is_not_an_empty_one(spark, tmp_path):
    like = spark.createDataFrame([("c", 1.0)], "campaign string, v double")
    assert forecast_store.read_forecasts(spark, str(tmp_path / "none"), like).count() == 0
    like.write.parquet(str(tmp_path / "store"))
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN|v2"):
        forecast_store.read_forecasts(spark, str(tmp_path / "store"), like.withColumnRenamed("v", "v2")).select("missing").count()


def test_intermediate_tables_can_be_deleted(spark):
    from sparkfolio.session import clear_written, written, written_so_far

    first = written(spark.range(3), "one")
    mark = written_so_far(spark)
    second, third = written(spark.range(4), "two"), written(spark.range(5), "three")
    path = third.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://").removeprefix("file:")
    kept = next(x for x in _paths(spark) if x.endswith(path.rsplit("/", 1)[1]))
    assert clear_written(spark, mark, (kept,)) == 1
    assert first.count() == 3 and third.count() == 5
    with pytest.raises(Exception, match="(?i)exist|not found"):
        second.count()
    assert clear_written(spark, mark) == 1 and written_so_far(spark) == mark


def _paths(spark):
    from sparkfolio import session

    return session._WRITTEN[spark.sparkContext.applicationId]
