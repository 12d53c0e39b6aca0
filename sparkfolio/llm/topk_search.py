"""Exact top-k search by inner product with distributed histogram selection.

Vectors become integers, so scores are exact and so are their histograms.  All candidates are scored against a block of
queries; each task counts scores in the bins of each query's range and sends only the bins that can hold its k best.
The sums tell the bin of each query's kth score, which is the range of the next round, until the bin is one score wide
or ends exactly at the kth.  A last pass keeps the scores from there on; equal scores are settled by smaller id, and a
task sends k rows of a query at most, which is exact.

Query blocks have a bounded number of rows, so what is broadcast doesn't grow; a query set of any size is a number of
passes over the candidates, each doing the block's arithmetic.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.llm.common import staged

LAST = np.iinfo(np.int64).max


def matrix(vectors: pa.Array, scale: float, width: int) -> np.ndarray:
    """floor(scale * x) of each component as float64, shorter vectors filled up with 0."""
    offsets, flat = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(offsets)
    out = np.zeros((len(lengths), width))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    flat = flat[offsets[0]:offsets[-1]]
    out[rows, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], lengths)] = np.floor(scale * flat)
    return out


class Block:
    """A block of queries: vectors, and for each the range low..high, in bins of ``step``, in which its kth score lies.

    Scores above ``high`` are no longer in ``need``: the last bin may reach beyond it, but they aren't counted again.
    """

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray, step: np.ndarray, need: np.ndarray):
        self.rows, self.vectors, self.low, self.high, self.step, self.need = rows, vectors, low, high, step, need

    def scores(self, batches: Iterator[pa.RecordBatch], scale: float, exact: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, which of them are null, score matrix candidates x queries, own-row mask) of small groups of candidates."""
        rows_at_once = max(1, 4_000_000 // max(1, len(self.rows)))
        order = np.argsort(self.rows)
        for batch in batches:
            for at in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(at, rows_at_once)
                x = matrix(part.column(2), scale, self.vectors.shape[1])
                s = (x @ self.vectors.T).astype(np.int64) if exact else x.astype(np.int64) @ self.vectors.astype(np.int64).T
                row = part.column(0).to_numpy()
                spot = np.minimum(np.searchsorted(self.rows[order], row), len(order) - 1)
                own = self.rows[order[spot]] == row
                mask = np.ones(s.shape, bool)
                mask[np.flatnonzero(own), order[spot[own]]] = False
                ids = part.column(1).fill_null(LAST).to_numpy(zero_copy_only=False)
                yield ids, part.column(1).is_null().to_numpy(zero_copy_only=False), s, mask


def histogram(block: Block, bins: int, scale: float, exact: bool):
    """Counts of scores by query and bin: those bins from the top that can hold the ``need`` best of this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = len(block.rows)
        count = np.zeros(q * bins, np.int64)
        base = np.arange(q) * bins
        for _, _, s, mask in block.scores(batches, scale, exact):
            mask &= (s >= block.low) & (s <= block.high)
            at = ((s - block.low).view(np.uint64) // block.step.astype(np.uint64)).view(np.int64)  # the gap may pass 63 bits
            count += np.bincount((at + base)[mask], minlength=q * bins)
        count = count.reshape(q, bins)
        above = count[:, ::-1].cumsum(1)[:, ::-1] - count
        query, bin_ = np.nonzero((count > 0) & (above < block.need[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int64)), pa.array(bin_.astype(np.int64)), pa.array(count[query, bin_])], names=["q", "bin", "n"])

    return run


def best(block: Block, floor: np.ndarray, k: int, scale: float, exact: bool):
    """(q, id, score) of scores from each query's floor on; of one task at most k of a query, by score and then id."""

    def cut(q: np.ndarray, ids: np.ndarray, s: np.ndarray, void: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((ids, void, -s, q))
        q, ids, s, void = q[order], ids[order], s[order], void[order]
        starts = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        keep = place < k
        return q[keep], ids[keep], s[keep], void[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (*(np.empty(0, np.int64) for _ in range(3)), np.empty(0, bool))
        for ids, void, s, mask in block.scores(batches, scale, exact):
            row, query = np.nonzero(mask & (s >= floor))
            if len(row):
                held = cut(*(np.concatenate(x) for x in zip(held, (query, ids[row], s[row, query], void[row]), strict=True)))
        q, ids, s, void = held
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids, mask=void), pa.array(s)], names=["q", "id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: float = 1024.0,
          block_rows: int = 2_048, bins: int = 256) -> DataFrame:
    """(query_id, rank, key, score): the k best candidates of each query row, all rows but its own being candidates.

    Score: inner product of floor(scale * component), ties to the smaller key (null last).  Vectors that are null or
    hold null or non-finite components take no part; vectors of other lengths count as filled up with 0.  Rows that
    repeat a key are separate rows, as queries and as candidates.  Fewer candidates than k: all of them.  Extra columns
    are left out.  Scores must fit in 64 bits.
    """
    good = F.col(vector).isNotNull() & F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = staged(vectors.filter(good).select(
        F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.col(vector).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("is_query")), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(F.floor(F.lit(scale) * x.cast("double")), F.lit(2)))
    norm, width, queries = rows.agg(F.coalesce(F.max(F.sqrt(square)), F.lit(0.0)), F.coalesce(F.max(F.size("v")), F.lit(0)), F.count(F.when(F.col("is_query"), 1))).first()
    blocks = -(-queries // block_rows)
    out, spark = None, vectors.sparkSession
    exact = norm * norm < 2 ** 52
    candidates = rows.select("row", "id", "v")
    for number in range(blocks):
        got = rows.filter(F.col("is_query") & (F.pmod(F.xxhash64("row"), F.lit(blocks)) == number)).select("row", "id", "v").toArrow()
        if not got.num_rows:
            continue
        x = matrix(got.column(2).combine_chunks(), scale, width)
        # No score is above the product of the norms; a margin for their rounding.
        limit = np.array([min(LAST, math.ceil(v * (1 + 1e-12)) + 1) for v in np.linalg.norm(x, axis=1) * norm], np.int64)
        n = len(limit)
        low, high, step = -limit, limit.copy(), np.array([-(-(2 * int(v) + 1) // bins) for v in limit], np.int64)
        floor, need, open_ = np.full(n, -LAST), np.full(n, k), np.arange(n)
        while len(open_):
            block = Block(got.column(0).to_numpy()[open_], x[open_], low[open_], high[open_], step[open_], need[open_])
            counted = candidates.mapInArrow(histogram(block, bins, scale, exact), "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
            above = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin")))
            needs = spark.createDataFrame([(i, int(v)) for i, v in enumerate(need[open_])], "q long, need long")
            found = (counted.withColumn("_to", above).join(F.broadcast(needs), "q").filter("_to - n < need").groupBy("q")
                     .agg(F.min_by(F.struct("bin", "n", "_to"), "bin").alias("b")).select("q", "b.*").collect())  # a row a query of the block
            left = []
            for q, bin_, n_bin, to in found:
                i = open_[q]
                if to < need[i]:  # fewer scores than asked for, in the first round only
                    continue
                need[i] -= to - n_bin
                at = int(low[i]) + bin_ * int(step[i])
                low[i], high[i] = at, min(int(high[i]), at + int(step[i]) - 1)
                floor[i] = low[i]
                if step[i] > 1 and need[i] < n_bin:
                    step[i] = -(-step[i] // bins)
                    left.append(i)
            open_ = np.array(left, np.int64)
        block = Block(got.column(0).to_numpy(), x, low, high, step, need)
        kept = candidates.mapInArrow(best(block, floor, k, scale, exact), "q long, id long, score long")
        ids = spark.createDataFrame(list(enumerate(got.column(1).to_pylist())), "q long, query_id long")
        ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id")))).filter(F.col("rank") <= k)
        part = ranked.join(F.broadcast(ids), "q").select("query_id", "rank", F.col("id").alias(key), "score")
        part = staged(part, "best") if blocks > 1 else part
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], f"query_id long, rank int, {key} long, score long")
