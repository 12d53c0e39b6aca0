"""Exact positions inside groups of any size.

A plain ``row_number`` puts a whole group into one task.  That is fine where a group is
bounded (bars of a symbol: one row per calendar day) but not for, say, all trades of a
strategy.  Here the rows are range-partitioned by (keys, order), so that a large group is
cut over many tasks, and positions are completed from a small per-partition summary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def ordered_positions(df: DataFrame, keys: list[str], order: list[str], position: str = "pos",
                      size: str = "group_rows") -> DataFrame:
    """Add 0-based ``position`` in each group by ``order``, and the group's row count ``size``.

    The tagged rows are written to the shared folder: range bounds come from a sample, so the two uses
    below must read one materialised result, also when an executor is lost.
    """
    if not keys:
        return ordered_positions(df.withColumn("_all", F.lit(0)), ["_all"], order, position, size).drop("_all")
    sort = [F.col(name) for name in keys + order]
    tagged = written(
        df.repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright(F.col("_row"), 33)), "positions")
    pieces = tagged.groupBy(*keys, "_part").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    # At most one row per (group, partition): this window is small by construction.
    by_group = Window.partitionBy(*keys)
    before = by_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        *keys, "_part", "_first",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(by_group).alias(size),
    )
    return (
        tagged.join(offsets, [*keys, "_part"])
        .withColumn(position, F.col("_before") + F.col("_row") - F.col("_first"))
        .drop("_row", "_part", "_first", "_before")
    )


def packed(df: DataFrame, keys: list[str], values: list[str], position: str = "pos") -> DataFrame:
    """Rows as arrays: (keys, start, an array of doubles per value) for each run of positions in a batch.

    Nothing is gathered for it: runs end where a batch does, so a group is as many rows as it had batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]).sort_by([(name, "ascending") for name in [*keys, position]])
            at = rows[position].to_numpy()
            new = np.ones(len(at), bool)
            new[1:] = np.diff(at) != 1
            for key in keys:
                column = rows[key].combine_chunks()
                new[1:] |= ~pc.fill_null(pc.equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(new)
            offsets = pa.array(np.append(first, len(at)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, rows[name].combine_chunks()) for name in values]
            yield pa.RecordBatch.from_arrays([*[rows[key].combine_chunks().take(pa.array(first)) for key in keys], pa.array(at[first]), *lists],
                                             names=[*keys, "start", *values])

    kinds = [f"{name} {df.schema[name].dataType.simpleString()}" for name in keys]
    rows = df.select(*keys, F.col(position).cast("bigint").alias(position), *[F.col(name).cast("double").alias(name) for name in values])
    return rows.mapInArrow(run, ", ".join([*kinds, "start bigint", *[f"{name} array<double>" for name in values]]))


def unpacked(table: pa.Table, value: str, size: int) -> np.ndarray:
    """A value of all positions of one group, from its runs."""
    out = np.zeros(size)
    for start, batch in zip(table["start"].to_pylist(), (x.values for x in table[value]), strict=True):
        out[start:start + len(batch)] = batch.to_numpy(zero_copy_only=False)
    return out


def with_halo(df: DataFrame, keys: list[str], position: str, back: int, block: int = 50_000) -> DataFrame:
    """Cut each group into blocks of positions and lend every block the ``back`` rows before it.

    Adds ``_block`` and ``_own``; a frame of up to ``back`` preceding rows over
    ``partitionBy(keys, _block)`` is then exact, and only rows with ``_own`` are kept afterwards.
    """
    pos = F.col(position)
    home = F.floor(pos / block)
    lend = (pos % block >= block - back) & (F.lit(back) > 0)
    return df.withColumn(
        "_block", F.explode(F.when(lend, F.array(home, home + 1)).otherwise(F.array(home)))
    ).withColumn("_own", F.floor(pos / block) == F.col("_block"))


def interpolated_quantile(values: Column, q: float) -> Column:
    """Linear-interpolated quantile of a short sorted array column."""
    place = F.lit(float(q)) * (F.size(values) - 1)
    low = F.floor(place).cast("int")
    high = F.least(low + 1, F.size(values) - 1)
    first = F.try_element_at(values, low + 1)
    return first + (place - low) * (F.try_element_at(values, high + 1) - first)
