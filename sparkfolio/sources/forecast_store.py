"""Idempotent Parquet store of forecasts, keyed (campaign, symbol, origin, model, horizon)."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["campaign", "symbol", "origin", "model", "horizon"]


def read_forecasts(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Stored forecasts, or none (with the columns of ``like``) before the first write."""
    try:
        return spark.read.schema(like.schema).parquet(path).select(*like.columns)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":  # a store that is there but can't be read isn't empty
            raise
        return like.limit(0)


def _once(batch: DataFrame) -> DataFrame:
    """One row per key, the last by target date; rows cross once and are grouped where the joins on the key want them."""
    values = [name for name in batch.columns if name not in KEY]
    return batch.repartition(*KEY).groupBy(*KEY).agg(F.max_by(F.struct(*values), "target_date").alias("v")).select(*KEY, "v.*")


def merge_forecasts(stored: DataFrame, batch: DataFrame, replace: bool) -> DataFrame:
    """Both tables with one row per key: the batch replaces stored rows, or is ignored where present.

    Repeats inside the batch count once, the last by target date.
    """
    once = _once(batch)
    if replace:
        return stored.join(once.select(*KEY), KEY, "left_anti").unionByName(once)
    return stored.unionByName(once.join(stored.select(*KEY), KEY, "left_anti"))


def store_batch(spark: SparkSession, path: str, batch: DataFrame, replace: bool = False) -> None:
    """Write a batch so that a failed or repeated run leaves no half-written or doubled windows.

    Ignore mode appends only unseen keys.  Replace mode writes merged partitions beside the store and
    swaps them in by campaign (dynamic partition overwrite).
    """
    stored = read_forecasts(spark, path, batch)
    if not replace:
        _once(batch).join(stored.select(*KEY), KEY, "left_anti").select(*batch.columns).write.mode("append").partitionBy(
            "campaign").parquet(path)
        return
    # A campaign is a folder of the store, so their names are few; a join by them would take each campaign to one task.
    touched = stored.join(F.broadcast(batch.select("campaign").distinct()), "campaign", "left_semi")
    merged = merge_forecasts(touched, batch, True).select(*batch.columns)
    # The merge reads the folder it replaces, so it is written aside first.
    aside = f"{path.rstrip('/')}_next-{uuid.uuid4().hex}"
    merged.write.parquet(aside)
    spark.read.parquet(aside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "campaign").parquet(path)
