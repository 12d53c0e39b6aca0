"""Three streaming jobs.  Each gives the same table as its batch twin on the same input."""

from __future__ import annotations

from pyspark.sql import DataFrame, GroupedData, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import constants as K
from ..sources.price_table import PriceTable
from ..sources.prices import require_valid, upsert_prices, with_problems
from .states import CallPairs, CallPairsOfMany, FirstTrials, FirstTrialsOfMany, PAIRED, TRIAL_CHANGES

BUCKETS = 4096  # values of state that keys are dealt to; fixed for a checkpoint
JSON_TIME = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


# ---- call events ------------------------------------------------------------------
def parse_events(lines: DataFrame) -> DataFrame:
    """Call records from JSON text lines; lines that do not parse are dropped."""
    parsed = F.from_json("value", "call_id bigint, kind string, ts timestamp, tool string, status string, text string",
                         JSON_TIME)
    return lines.select(parsed.alias("e")).where(F.col("e.call_id").isNotNull() & F.col("e.ts").isNotNull()).select("e.*")


def _paired(starts: DataFrame, ends: DataFrame, limit: str | None) -> DataFrame:
    begin = starts.select(F.col("call_id").alias("start_id"), F.col("ts").alias("started_at"))
    same_call = (F.col("call_id") == F.col("start_id")) & (F.col("started_at") <= F.col("ended_at"))
    if limit is not None:
        same_call = same_call & (F.col("started_at") >= F.col("ended_at") - F.expr(f"interval {limit}"))
    joined = ends.withColumnRenamed("ts", "ended_at").join(begin, same_call, "left_outer")
    error = F.substring(F.regexp_replace("text", r"\s+", " "), 1, K.ERROR_TEXT_LIMIT)
    return joined.select(
        "call_id", "tool", "status", "started_at", "ended_at",
        (F.unix_millis("ended_at") - F.unix_millis("started_at")).alias("duration_ms"),
        F.when(F.col("status") == "error", error).alias("error_text"))


def pair_events(events: DataFrame, limit: str | None = None) -> DataFrame:
    """Ends with their start, its duration and (for errors) the shortened text.

    A table is paired by call alone.  A stream needs ``limit``, the longest call it waits for: both sides carry
    it as watermark, so state is dropped once no partner can come, and an end whose start is older has no
    duration.
    """
    if events.isStreaming:
        if limit is None:
            raise ValueError("a stream needs the longest duration of a call")
        events = events.withWatermark("ts", limit)
    return _paired(events.where(F.col("kind") == "start"), events.where(F.col("kind") == "end"), limit)


# ---- prices -----------------------------------------------------------------------
PRICE_FILE_SCHEMA = ("symbol string, date string, open double, high double, low double, close double, "
                     "adj_close double, volume double")


def stream_upsert_prices(spark: SparkSession, incoming: str, table: str, checkpoint: str) -> StreamingQuery:
    """Upsert arriving price files.  A batch is checked as a whole, then kept under its number.

    ``table`` holds one folder per batch; writing batch n twice overwrites it, so a retry after a lost
    executor or driver changes nothing.  ``current_prices`` resolves the latest row of each key.
    """

    def keep(batch: DataFrame, number: int) -> None:
        rows = require_valid(with_problems(batch)).withColumn("batch_no", F.lit(number + 1))
        rows.write.mode("overwrite").parquet(f"{table}/batch={number:012d}")

    return (
        spark.readStream.schema(PRICE_FILE_SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
        .parquet(incoming).writeStream.foreachBatch(keep)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def current_prices(spark: SparkSession, table: str, base: DataFrame) -> DataFrame:
    """The base table with every kept batch applied, later batches winning."""
    return upsert_prices(base, spark.read.parquet(table).drop("batch"))


def stream_into_table(spark: SparkSession, incoming: str, table: PriceTable, checkpoint: str, name: str = "prices",
                      files_per_trigger: int = 100, compact_every: int = 20) -> StreamingQuery:
    """Upsert arriving price files into a price table, each batch as one version of it.

    A batch with a bad row commits nothing and stops the stream.  The table remembers the last batch of the stream
    called ``name``, so a batch that is tried again after a lost driver changes nothing.  Every ``compact_every`` batches
    the kept ones are folded into the base; a merge that fails leaves them, and the next one takes them along.
    """

    def keep(batch: DataFrame, number: int) -> None:
        table.upsert(require_valid(with_problems(batch)), name, number)
        if len(table.manifest()["batches"]) >= compact_every:
            table.compact()

    return (
        spark.readStream.schema(PRICE_FILE_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
        .option("recursiveFileLookup", True).parquet(incoming).writeStream.foreachBatch(keep)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


# ---- trials -----------------------------------------------------------------------
def distinct_trials(trials: DataFrame, delay: str = "1 day") -> DataFrame:
    """Trials with repeats of a run record dropped; on a stream, repeats within the watermark delay."""
    if trials.isStreaming:
        return trials.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["run_record"])
    return trials.withColumn("_first", F.row_number().over(
        Window.partitionBy("run_record").orderBy("ts", "source"))).where(F.col("_first") == 1).drop("_first")


def trial_counts(trials: DataFrame, delay: str = "1 day") -> DataFrame:
    """Distinct run records per source."""
    return distinct_trials(trials, delay).groupBy("source").agg(F.count(F.lit(1)).alias("trials"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available and append the results as Parquet."""
    query = stream.writeStream.format("parquet").outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_updates(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> None:
    """Process everything available in update mode; each batch is kept under its number."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_no", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()


def latest_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last kept value of each key."""
    rows = spark.read.parquet(path).drop("batch")
    values = [name for name in rows.columns if name not in [*keys, "batch_no"]]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_no").alias("v")).select(*keys, "v.*")


# ---- exact streams: state by key, no limit on how late a partner comes ---------------
def with_state_store(spark: SparkSession) -> None:
    """Keyed state needs the store that keeps it on disk rather than in memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def in_buckets(rows: DataFrame, key: str) -> GroupedData:
    """Rows by bucket of keys.  What is kept for good needs no clock of its own per key, so a bucket's keys share a value
    of the state: a batch reads and writes the values of the buckets that it touches, not one by one those of its keys.
    """
    return rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS))).groupBy("bucket")


def trial_changes(trials: DataFrame, days: int | None = None) -> DataFrame:
    """(source, change): +1 for the first trial of a run record, whenever its repeats come.

    An earlier trial that arrives later takes the record over: -1 for the source before, +1 for its own.  ``days`` drops
    what is known about a record so long after its last row; by default it is kept, and counts equal the batch twin's.
    """
    with_state_store(trials.sparkSession)
    rows = trials.select("run_record", "ts", "source")
    if days is None:
        return in_buckets(rows, "run_record").transformWithStateInPandas(FirstTrialsOfMany(), TRIAL_CHANGES, "Append", "None")
    return rows.groupBy("run_record").transformWithStateInPandas(FirstTrials(days), TRIAL_CHANGES, "Append", "ProcessingTime")


def counts_of_changes(changes: DataFrame) -> DataFrame:
    """Distinct run records per source from all changes so far."""
    return changes.groupBy("source").agg(F.sum("change").alias("trials")).where(F.col("trials") > 0)


def pair_changes(events: DataFrame, days: int | None = None) -> DataFrame:
    """Ends and their starts as they become known, however late either comes, with a ``reason``.

    ``paired``: the start was there; ``no-start``: none is there yet; ``late-start``: it came after its end, whose row
    without a start is thereby out of date.  ``days`` drops a call so long after its last record; by default it is kept.
    """
    with_state_store(events.sparkSession)
    if days is None:
        rows = events.select(F.col("call_id").cast("string").alias("call_id"), "kind", "ts", "tool", "status", "text")
        return in_buckets(rows, "call_id").transformWithStateInPandas(CallPairsOfMany(), PAIRED, "Append", "None")
    return events.groupBy("call_id").transformWithStateInPandas(CallPairs(days), PAIRED, "Append", "ProcessingTime")


def pairs_of_changes(changes: DataFrame) -> DataFrame:
    """The table that ``pair_events`` gives for the same records: rows without a start go once a start is known."""
    known = changes.groupBy("call_id", "end_no").agg(F.max(F.col("started_at").isNotNull()).alias("known"))
    rows = changes.join(known, ["call_id", "end_no"]).where(F.col("started_at").isNotNull() | ~F.col("known"))
    error = F.substring(F.regexp_replace("text", r"\s+", " "), 1, K.ERROR_TEXT_LIMIT)
    return rows.select(
        "call_id", "tool", "status", "started_at", "ended_at",
        (F.unix_millis("ended_at") - F.unix_millis("started_at")).alias("duration_ms"),
        F.when(F.col("status") == "error", error).alias("error_text"), "reason")
