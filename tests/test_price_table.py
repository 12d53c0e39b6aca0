"""Price table versions, compaction, and streams that stay exact for late partners."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sparkfolio.operators import evidence
from sparkfolio.sources import prices
from sparkfolio.sources.price_table import Conflict, PriceTable
from sparkfolio.streaming import streams

BARS = "symbol string, bar_date date, open double, high double, low double, close double, adj_close double, volume bigint"


def bars(spark, *rows):
    return spark.createDataFrame([(s, dt.date.fromisoformat(d), p, p, p, p, p, 1) for s, d, p in rows], BARS)


def seen(frame):
    return sorted((r.symbol, str(r.bar_date), r.close) for r in frame.collect())


def test_versions_upserts_and_compaction(spark, tmp_path):
    table = PriceTable(spark, str(tmp_path / "t"))
    assert table.versions() == [] and table.read().count() == 0
    table.overwrite(bars(spark, ("A", "2024-01-02", 1.0), ("A", "2025-01-02", 2.0), ("B", "2025-01-02", 3.0)))
    table.upsert(bars(spark, ("A", "2025-01-02", 5.0), ("C", "2026-01-02", 6.0)))
    table.upsert(bars(spark, ("A", "2025-01-02", 7.0)))
    want = [("A", "2024-01-02", 1.0), ("A", "2025-01-02", 7.0), ("B", "2025-01-02", 3.0), ("C", "2026-01-02", 6.0)]
    assert seen(table.read()) == want and table.versions() == [1, 2, 3]
    assert seen(table.read(1)) == [("A", "2024-01-02", 1.0), ("A", "2025-01-02", 2.0), ("B", "2025-01-02", 3.0)]
    old = table.manifest()
    table.compact()
    new = table.manifest()
    assert seen(table.read()) == want and new["batches"] == []
    assert new["base"]["2024"] == old["base"]["2024"] and new["base"]["2025"] != old["base"]["2025"]  # untouched years stay
    assert seen(table.read(years=[2026])) == [want[3]]
    files = table.read(years=[2024]).inputFiles()
    assert files and all("year=2024" in f for f in files)
    assert table.compact() == new["version"]  # nothing to do
    assert table.vacuum(keep=1) > 0 and table.versions() == [4] and seen(table.read()) == want


def test_a_failed_write_or_merge_changes_nothing(spark, tmp_path, monkeypatch):
    table = PriceTable(spark, str(tmp_path / "t"))
    table.overwrite(bars(spark, ("A", "2025-01-02", 2.0)))
    bad = spark.createDataFrame([("A", "2025-01-03", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), ("A", "2025-01-04", 1.0, 1.0, 1.0, -1.0, 1.0, 1.0)],
                                streams.PRICE_FILE_SCHEMA)
    with pytest.raises(Exception, match="invalid"):
        table.upsert(prices.require_valid(prices.with_problems(bad)))
    assert table.versions() == [1] and seen(table.read()) == [("A", "2025-01-02", 2.0)]
    table.upsert(bars(spark, ("A", "2025-01-02", 9.0)))
    monkeypatch.setattr(PriceTable, "_commit", lambda *a, **b: (_ for _ in ()).throw(RuntimeError("driver lost")))
    with pytest.raises(RuntimeError, match="lost"):
        table.compact()
    monkeypatch.undo()
    assert table.versions() == [1, 2] and seen(table.read()) == [("A", "2025-01-02", 9.0)]
    assert table.vacuum(keep=2) >= 1  # what the failures left
    assert seen(table.read()) == [("A", "2025-01-02", 9.0)] and table.compact() == 3


def test_the_second_of_two_writers_fails(spark, tmp_path):
    table = PriceTable(spark, str(tmp_path / "t"))
    table.overwrite(bars(spark, ("A", "2025-01-02", 2.0)))
    stale = table.manifest()
    table.upsert(bars(spark, ("A", "2025-01-02", 3.0)))
    with pytest.raises(Conflict):
        table._commit(stale, batches=[])
    assert seen(table.read()) == [("A", "2025-01-02", 3.0)]


def test_stream_into_the_table(spark, tmp_path, monkeypatch):
    table = PriceTable(spark, str(tmp_path / "t"))
    table.overwrite(bars(spark, ("A", "2025-01-02", 1.0), ("B", "2024-01-02", 1.0)))

    def arrive(i, *rows):
        spark.createDataFrame([(s, d, p, p, p, p, p, 1.0) for s, d, p in rows], streams.PRICE_FILE_SCHEMA).coalesce(1).write.parquet(
            str(tmp_path / "in" / f"{i}"))

    run = lambda: streams.stream_into_table(spark, str(tmp_path / "in"), table, str(tmp_path / "ck"), files_per_trigger=1,
                                            compact_every=3).awaitTermination()
    arrive(0, ("A", "2025-01-02", 2.0))
    arrive(1, ("A", "2025-01-02", 3.0), ("C", "2025-01-02", 4.0))
    run()
    assert len(table.manifest()["batches"]) == 2
    known = table.versions()
    run()  # nothing new
    table.upsert(bars(spark, ("A", "2025-01-02", 99.0)), "prices", 1)  # a batch that is tried again
    assert table.versions() == known
    merge = PriceTable.compact
    monkeypatch.setattr(PriceTable, "compact", lambda self: (_ for _ in ()).throw(RuntimeError("lost")))
    arrive(2, ("A", "2025-01-02", 5.0))
    with pytest.raises(Exception, match="lost"):
        run()
    monkeypatch.setattr(PriceTable, "compact", merge)
    want = [("A", "2025-01-02", 5.0), ("B", "2024-01-02", 1.0), ("C", "2025-01-02", 4.0)]
    assert seen(table.read()) == want and len(table.manifest()["batches"]) == 3
    run()  # the batch is applied already; only the merge is made up for
    assert table.manifest()["batches"] == [] and seen(table.read()) == want
    arrive(3, ("A", "2025-01-02", 6.0), ("", "2025-01-03", 6.0))
    with pytest.raises(Exception, match="invalid"):
        run()
    assert seen(table.read()) == want


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def trickle(spark, tmp_path, name, frame, batches):
    """A stream that gets each batch in a trigger of its own, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, frame).coalesce(1).write.parquet(str(tmp_path / name / f"{i}"))
    return spark.readStream.schema(frame).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / name))


def test_trials_that_repeat_late(spark, tmp_path):
    frame = "ts timestamp, source string, run_record string"
    batches = [[(day(5), "a", "r1"), (day(5), "b", "r2")], [(day(40), "a", "r1"), (day(6), "a", "r3")],
               [(day(1), "c", "r2"), (day(90), "b", None)], [(day(95), "b", None), (day(0), "a", "r1")]]
    out = str(tmp_path / "out")
    streams.run_to_table(streams.trial_changes(trickle(spark, tmp_path, "in", frame, batches)), out, str(tmp_path / "ck"))
    got = {r.source: r.trials for r in streams.counts_of_changes(spark.read.parquet(out)).collect()}
    twin = streams.trial_counts(spark.createDataFrame(sum(batches, []), frame))
    assert got == {r.source: r.trials for r in twin.collect()} == {"a": 2, "b": 1, "c": 1}


def test_calls_whose_start_comes_days_late(spark, tmp_path):
    frame = "call_id bigint, kind string, ts timestamp, tool string, status string, text string"
    row = lambda c, k, d, s="ok": (c, k, day(d), "tool", s, " a  b " + "x" * 300)
    batches = [[row(1, "start", 0), row(2, "end", 9, "error")], [row(1, "end", 1), row(3, "end", 2)],
               [row(2, "start", 6), row(1, "end", 1)], [row(2, "start", 12), row(1, "start", 0.5), (4, "other", day(1), None, None, None)]]
    out = str(tmp_path / "out")
    streams.run_to_table(streams.pair_changes(trickle(spark, tmp_path, "in", frame, batches)), out, str(tmp_path / "ck"))
    changes = spark.read.parquet(out)
    got = streams.pairs_of_changes(changes)
    twin = streams.pair_events(spark.createDataFrame(sum(batches, []), frame))
    both = [sorted(map(str, x.select(*twin.columns).collect())) for x in (got, twin)]
    assert both[0] == both[1] and len(both[0]) == 6
    reasons = {(r.call_id, r.reason) for r in changes.collect()}
    assert {(1, "paired"), (2, "no-start"), (2, "late-start"), (3, "no-start")} <= reasons
    assert got.where("call_id = 2").select(F.max("reason")).first()[0] == "late-start"


def test_digests_read_changed_years_only(spark, tmp_path, monkeypatch):
    table = PriceTable(spark, str(tmp_path / "t"))
    first = table.overwrite(bars(spark, ("A", "2023-01-02", 1.0), ("A", "2024-01-02", 2.0), ("B", "2024-01-02", 3.0)))
    known = evidence.price_sums(table.read()).cache()
    second = table.upsert(bars(spark, ("B", "2024-01-02", 9.0), ("C", "2025-01-02", 1.0)))
    assert table.changed_years(first) == [2024, 2025] and table.changed_years(second) == []
    fresh, read = {}, []
    real = PriceTable.read
    monkeypatch.setattr(PriceTable, "read", lambda self, *a: (read.append(x := real(self, *a)), x)[1])
    tree = evidence.digest_tree(evidence.refreshed_sums(table, known, first, second)).collect()
    assert len(read) == 1 and not any("year=2023" in f for f in read[0].inputFiles())
    monkeypatch.undo()
    fresh = {tuple(r) for r in evidence.digest_tree(evidence.price_sums(table.read())).collect()}
    assert {tuple(r) for r in tree} == fresh
    before = {(r.level, r.symbol, r.year): r.fingerprint for r in evidence.digest_tree(known).collect()}
    after = {(r.level, r.symbol, r.year): r.fingerprint for r in tree}
    assert before["symbol", "A", None] == after["symbol", "A", None] and before["symbol", "B", None] != after["symbol", "B", None]
    assert before["table", None, None] != after["table", None, None]
    table.compact()
    assert evidence.refreshed_sums(table, known, second).where("symbol = 'A'").count() == 2


def test_exact_text_names_the_bits(spark):
    import math
    import struct

    from sparkfolio.functions.numbers import exact_text

    values = [1.0, -1.0, 0.1, 2.0**60, 2.0**-60, 3.0 * 2.0**1000, 5e-324, 1.7976931348623157e308, math.nextafter(8.0, 0), math.nextafter(8.0, 9), 0.0, -0.0, 123.456]
    values += [struct.unpack("d", struct.pack("Q", (i * 0x9E3779B97F4A7C15 + 12345) % 2**64 & ~(1 << 62)))[0] for i in range(500)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", exact_text(F.col("v")).alias("t")).collect()
    for r in got:
        mantissa, _, power = r.t.partition("p")
        from fractions import Fraction
        assert Fraction(int(mantissa)) / (Fraction(2) ** int(power or 0)) == Fraction(r.v), r


def test_many_keys_share_a_value_of_state(spark, tmp_path):
    """Late repeats of many records, and calls with large and missing ids, in few buckets; the store isn't asked key by key."""
    from sparkfolio.streaming import states

    asked = []

    class Known:
        exists = lambda self: False
        update = lambda self, value: asked.append(value)

    import pandas as pd
    rows = pd.DataFrame({"run_record": [f"r{i % 50}" for i in range(200)], "ts": pd.to_datetime(range(200), unit="D"), "source": "a"})
    one = states.FirstTrialsOfMany()
    one.state = Known()
    assert sum(f["change"].sum() for f in one.handleInputRows((1,), iter([rows]), None)) == 50 and len(asked) == 1
    frame = "call_id bigint, kind string, ts timestamp, tool string, status string, text string"
    big = 2 ** 62 + 1
    row = lambda c, k, d: (c, k, day(d), "tool", "ok", "x")
    batches = [[row(big, "end", 5), row(None, "end", 5), row(big + 1, "end", 6)], [row(big, "start", 1), row(big + 1, "start", 7), row(None, "start", 2)]]
    out = str(tmp_path / "out")
    streams.run_to_table(streams.pair_changes(trickle(spark, tmp_path, "in", frame, batches)), out, str(tmp_path / "ck"))
    changes = sorted((str(r.call_id), r.reason) for r in spark.read.parquet(out).collect())
    assert changes == sorted([(str(big), "no-start"), ("None", "no-start"), (str(big + 1), "no-start"), (str(big), "late-start"), ("None", "late-start")])
