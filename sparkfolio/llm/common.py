"""Helpers that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.session import record_written, shared_folder

#: White space that separates words: space and U+0009..U+000D.  ``bytes.split()`` splits at the same bytes.
BLANK = "[\\x20\\x09-\\x0D]"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to a new folder beneath the shared folder, and read from there.

    Cuts the lineage: what follows survives lost executors with a re-read, and Catalyst prunes columns of it.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    with without_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def without_shuffles(spark: SparkSession, name: str = "spark.sql.classic.shuffleDependency.fileCleanup.enabled") -> Iterator[None]:
    """Shuffle files of queries that end inside are deleted when they end, not when the driver collects its garbage."""
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path beneath the shared folder, recorded so that ``session.clear_written`` can delete it."""
    return record_written(spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; null text: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK + "+"), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame, first: str = "a", second: str = "b") -> DataFrame:
    """Connected components of undirected edges: (node, label), label the smallest node of the component.

    Rounds of large-star and small-star, each an aggregation over edges; a round is written to the shared folder.
    Rows are the edges only, so a star of any size is one group of partial minima and is never gathered.  Rounds
    grow with the logarithm of the longest path, and end when every edge points from a node to its root.
    """
    current = staged(edges.select(F.col(first).alias("a"), F.col(second).alias("b")).filter("a <> b").distinct(), "edges")
    while True:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: every larger neighbour of a node points to the node's smallest neighbour (or itself).
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        # Small star: every smaller neighbour, and the node, points to the smallest of them.
        down = staged(large.filter("a <> b").distinct(), "large")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        current = staged(small, "small")
        ends = current.select("a", F.lit(1).alias("up"), F.lit(0).alias("root")).union(
            current.select("b", F.lit(0), F.lit(1))).groupBy("a").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
        if ends.filter((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("root") > 0))).isEmpty():
            break
    labels = current.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.union(current.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
