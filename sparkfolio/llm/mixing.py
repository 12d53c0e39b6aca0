"""Mixing sources to target weights by pivotal dependent rounding.

Every source has a target in words; every document of it has the same real number of copies, target / source size.
The whole part is certain, the fraction is rounded so that the words taken stay at the target: two documents with
fractions move words from one to the other, in a random direction that keeps both expectations, until one fraction is
0 or 1.  A bucket of documents ends with at most one fraction left; buckets' remainders meet in a tree whose levels
are Spark jobs, and the last remainder of a source is drawn.  So a source misses its target by less than one document.

Draws are functions of the seed, the document id and its size, and documents meet in the order of those, so reruns agree.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.llm.common import staged, word_count

MASK = (1 << 64) - 1


def uniform(h: int, level: int) -> float:
    """A draw in [0, 1) that a 64-bit hash and the level of the tree decide (one round of a public 64-bit mixer)."""
    z = (h + (level + 1) * 0x9E3779B97F4A7C15) & MASK
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK
    return ((z ^ (z >> 31)) >> 11) / (1 << 53)


def pivot(fractions: list[float], sizes: list[int], draws: list[float]) -> list[float]:
    """Fractions after pairing each document with the one left over before: all 0 or 1, but for one at most.

    ``sum(fraction * size)`` stays as it is.
    """
    out, left = list(fractions), -1
    for j, p in enumerate(out):
        if p <= 0 or p >= 1:
            continue
        if left < 0:
            left = j
            continue
        i, wi, wj = left, sizes[left], sizes[j]
        up = min((1 - out[i]) * wi, p * wj)  # words that can go from j to i
        down = min(out[i] * wi, (1 - p) * wj)
        if draws[j] * (up + down) < down:
            full_i, full_j = (1 - out[i]) * wi <= p * wj, p * wj <= (1 - out[i]) * wi
            out[i] = 1.0 if full_i else out[i] + up / wi
            out[j] = 0.0 if full_j else p - up / wj
        else:
            full_i, full_j = out[i] * wi <= (1 - p) * wj, (1 - p) * wj <= out[i] * wi
            out[i] = 0.0 if full_i else out[i] - down / wi
            out[j] = 1.0 if full_j else p + down / wj
        left = next((k for k in (i, j) if 0 < out[k] < 1), -1)
    return out


def targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0) -> DataFrame:
    """Adds ``target`` to (source, source_size, ...): one row per source.

    Sources by code point, null last, take the weights in turn and share ``share`` times the sum of sizes; a target
    stops at ``ceiling`` times its source's size and the excess goes to the others by weight.  Solved at once: sorted by
    ceiling / weight, the sources that stop are a prefix.  Runs over the table of distinct sources only.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    before = Window.orderBy("_ratio", "source").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("_all") * share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.col("_weights") - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
    whole = Window.orderBy("_ratio", "source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        sources.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(turn, F.lit(len(weights))) + 1).cast("double"))
        .withColumn("_cap", F.col("source_size") * ceiling)
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_all", F.sum("source_size").over(everything))
        .withColumn("_weights", F.sum("_weight").over(everything))
        .withColumn("_level", level)
        .withColumn("_stops", F.col("_ratio") <= F.col("_level"))
        .withColumn("_shared", F.first(F.when(~F.col("_stops"), F.col("_level")), ignorenulls=True).over(whole))
        .withColumn("target", F.when(F.col("_stops"), F.col("_cap")).otherwise(F.col("_weight") * F.col("_shared")))
        .drop("_weight", "_cap", "_ratio", "_all", "_weights", "_level", "_stops", "_shared")
    )


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", row: Column | None = None,
        weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, ceiling: float = 2.0, seed: int = 17,
        bucket_rows: int = 20_000, fan_in: int = 1_000) -> DataFrame:
    """(row, key, source, size, source_size, target, copies, taken) per row of ``docs``.

    ``row`` numbers the rows (default: any unique number), so repeated and null keys keep their own decision.  Null
    text has size 0; documents of size 0 and all-zero sources get copies of the whole part only, taken 0.  Null sources
    are one source.  Empty table: no rows.  Extra columns are left out.

    A source of any size is spread over buckets of about ``bucket_rows`` documents; ``fan_in`` buckets meet a level up.
    """
    rows = staged(docs.select(
        (F.monotonically_increasing_id() if row is None else row).alias("row"), F.col(key).alias("key"),
        F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size")), "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    sources = (targets(sources, weights, share, ceiling)
               .withColumn("_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
               .withColumn("_buckets", F.ceil(F.col("_n") / F.lit(float(bucket_rows)))))
    sources = staged(sources, "sources")
    h = F.xxhash64(F.lit(seed), F.col("key"), F.col("size"))
    spread = F.xxhash64(h, F.when(F.col("key").isNull(), F.col("row")))
    known = F.col("source").isNotNull()
    joined = (rows.withColumn("_s", F.concat(known.cast("string"), F.coalesce("source", F.lit(""))))
              .join(sources.withColumn("_s", F.concat(known.cast("string"), F.coalesce("source", F.lit("")))).drop("source"), "_s")
              .withColumn("whole", F.floor("_rate")).withColumn("part", F.col("_rate") - F.col("whole"))
              .withColumn("h", h).withColumn("bucket", F.pmod(spread, F.col("_buckets"))))
    columns = ["row", "key", "source", "size", "source_size", "target", "whole"]
    drawn = (F.col("part") > 0) & (F.col("size") > 0)
    decided = joined.filter(~drawn).select(*columns, F.lit(0.0).alias("part"))
    most = sources.agg(F.max("_buckets")).first()[0] or 0
    open_rows = joined.filter(drawn).select(*columns, "h", "bucket", "_s", "part")
    level = 0
    while most:
        last = most == 1
        open_rows = staged(open_rows.groupBy("_s", "bucket").applyInPandas(_round(level, last), open_rows.schema), "rounded")
        done = F.col("part").isin(0.0, 1.0)
        decided = decided.union(open_rows.filter(done).select(*columns, "part"))
        if last:
            break
        open_rows = open_rows.filter(~done).withColumn("bucket", F.floor(F.col("bucket") / F.lit(fan_in)))
        most, level = -(-most // fan_in), level + 1
    copies = (F.col("whole") + F.col("part")).cast("long")
    return decided.select(*columns[:-1], copies.alias("copies"), (copies * F.col("size")).alias("taken")).withColumnRenamed("key", key)


def _round(level: int, last: bool):
    """Rounds one bucket; the last level draws what is left."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h", "key", "size", "row"], kind="stable").reset_index(drop=True)
        draws = [uniform(int(h) & MASK, level) for h in rows["h"]]
        got = pivot(rows["part"].tolist(), rows["size"].tolist(), draws)
        if last:
            got = [p if p in (0.0, 1.0) else float(uniform(int(h) & MASK, level + 64) < p)
                   for p, h in zip(got, rows["h"], strict=True)]
        return rows.assign(part=got)

    return run
