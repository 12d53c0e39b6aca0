"""Ranked lexical search: every document against a set of stated query texts, the best few of each, exactly.

Documents are indexed once by the queries' terms only: a row holds a document's length and its counts of those terms, and
is written to the shared folder.  Corpus statistics are sums over these rows.  Then each task inverts its own documents in
chunks of bounded size and answers every query on them in two modes:

- term at a time: the posting lists of a query's rare terms are summed into accumulators, one list of (document, sum);
- document at a time: that list counts as one more iterator, bounded by its highest sum, beside the long lists, each
  bounded by its highest impact.  Lists whose bounds together can't reach the query's kth score so far are never walked:
  the others name candidates, window by window, and the rest are probed for those that still can get there.

A task keeps k documents of a query and carries the kth score from chunk to chunk, so later chunks skip more.  What leaves
a task is k rows a query.  Impacts are integers that depend on the document and term only, so sums have no order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.llm.common import staged

#: A-Z in lower case and every other ASCII character but digits and letters a blank; bytes of other letters stay.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Postings that a task inverts at once, documents of a window, and the share of a chunk's documents that short lists sum to.
POSTINGS, WINDOW, SHORT = 4_000_000, 8_192, 1 / 8
LAST = np.iinfo(np.int64).max
#: Saturation and length normalisation: m = 100 - B + B * length / average length (in percent).
B = 50


def terms(text: bytes | None) -> list[bytes]:
    """Maximal runs of letters and digits, only A-Z lower-cased; everything beyond ASCII is a letter."""
    return text.translate(LETTERS).split() if text else []


def index(docs: DataFrame, wanted: list[bytes], key: str, text: str) -> DataFrame:
    """(key, n, ids, tfs): terms of a document with repeats, and the counts of those in ``wanted`` by their place in it."""
    lookup = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {term: i for i, term in enumerate(lookup.value)}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sizes, starts, ids, tfs = [], [0], [], []
                for raw in part.column(1).to_pylist():
                    found = terms(raw)
                    sizes.append(len(found))
                    hits = np.fromiter((place[x] for x in found if x in place), np.int64)
                    hit, tf = np.unique(hits, return_counts=True)
                    ids.append(hit)
                    tfs.append(tf)
                    starts.append(starts[-1] + len(hit))
                flat = lambda x: pa.array(np.concatenate(x).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(starts, flat(ids)),
                     pa.ListArray.from_arrays(starts, flat(tfs))], names=["key", "n", "ids", "tfs"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text")).mapInArrow(
        run, "key long, n long, ids array<int>, tfs array<int>")


class Best:
    """The k best (score, key) of each query that a task has met; equal scores by smaller key."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = [np.empty(0, np.int64)] * queries
        self.key = [np.empty(0, np.int64)] * queries

    def floor(self, q: int) -> int:
        """A score below this can't enter."""
        return int(self.score[q][-1]) if len(self.score[q]) == self.k else 1

    def add(self, q: int, score: np.ndarray, key: np.ndarray) -> None:
        score, key = np.concatenate((self.score[q], score)), np.concatenate((self.key[q], key))
        order = np.lexsort((key, -score))[:self.k]
        self.score[q], self.key[q] = score[order], key[order]


class Chunk:
    """Inverted documents: for each term its documents in order, their impacts, and the highest one."""

    def __init__(self, key: np.ndarray, m: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray):
        order = np.argsort(term, kind="stable")
        self.key, self.doc = key, doc[order]
        self.impact = (weight[term] * ((1_000_000_000 * tf) // (1_000 * tf + 20 * m[doc])))[order]
        self.at = np.searchsorted(term[order], np.arange(len(weight) + 1))

    def search(self, q: int, query: np.ndarray, best: Best, window: int = WINDOW, share: float = SHORT) -> None:
        lists = sorted(((self.doc[a:b], self.impact[a:b]) for a, b in zip(self.at[query], self.at[query + 1], strict=True) if b > a),
                       key=lambda x: len(x[0]))
        # Term at a time: short lists become one list of sums.
        sizes = np.cumsum([len(x[0]) for x in lists])
        short = int(np.searchsorted(sizes, share * len(self.key), side="right"))
        if short > 1:
            doc, where = np.unique(np.concatenate([x[0] for x in lists[:short]]), return_inverse=True)
            total = np.zeros(len(doc), np.int64)
            np.add.at(total, where, np.concatenate([x[1] for x in lists[:short]]))
            lists = [(doc, total), *lists[short:]]
        # Document at a time: lists by their bounds; reach[i] is what the first i lists can give together.
        bounds = [int(x[1].max()) for x in lists]
        by_bound = sorted(range(len(lists)), key=bounds.__getitem__)
        lists, reach = [lists[i] for i in by_bound], np.concatenate(([0], np.cumsum([bounds[i] for i in by_bound]))).astype(np.int64)
        for low in range(0, len(self.key), window):
            floor = best.floor(q)
            first = int(np.searchsorted(reach[1:], floor))  # the lists before this one can't reach the floor by themselves
            if first == len(lists):
                return
            partial = np.zeros(min(window, len(self.key) - low), np.int64)
            for doc, impact in lists[first:]:
                a, b = np.searchsorted(doc, (low, low + window))
                partial[doc[a:b] - low] += impact[a:b]
            left = np.flatnonzero((partial > 0) & (partial + reach[first] >= floor))
            score = partial[left]
            for i in range(first - 1, -1, -1):
                if not len(left):
                    break
                doc, impact = lists[i]
                spot = np.searchsorted(doc, left + low)
                spot[spot == len(doc)] = 0
                score = score + np.where(doc[spot] == left + low, impact[spot], 0)
                able = score + reach[i] >= floor
                left, score = left[able], score[able]
            if len(left):
                best.add(q, score, self.key[left + low])


def scan(queries: list[np.ndarray], weight: np.ndarray, documents: int, length: int, k: int,
         most: int, window: int, share: float):
    """Task that answers all queries on its documents: (q, key, score), k rows of a query at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(queries), k)

        def answer(held: list[tuple[np.ndarray, ...]]) -> None:
            key, n, size, term, tf = (np.concatenate(x) for x in zip(*held, strict=True))
            m = 100 - B + (B * n * documents) // length
            chunk = Chunk(key, m, np.repeat(np.arange(len(key)), size), term, tf, weight)
            for q, query in enumerate(queries):
                chunk.search(q, query, best, window, share)

        held, postings = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids, tfs = part.column(2), part.column(3)
                held.append((part.column(0).fill_null(LAST).to_numpy(), part.column(1).to_numpy(), np.diff(ids.offsets.to_numpy()).astype(np.int64),
                             ids.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy().astype(np.int64)))
                postings += len(held[-1][3]) + part.num_rows
                if postings >= most:
                    answer(held)
                    held, postings = [], 0
        if held:
            answer(held)
        q = np.repeat(np.arange(len(queries)), [len(x) for x in best.score])
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.concatenate([*best.key, np.empty(0, np.int64)])),
                                          pa.array(np.concatenate([*best.score, np.empty(0, np.int64)]))], names=["q", "key", "score"])

    return run


def search(docs: DataFrame, queries: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text", query_key: str = "item_id",
           query_text: str = "text", block_bytes: int = 4_000_000,
           postings: int = POSTINGS, window: int = WINDOW, share: float = SHORT) -> DataFrame:
    """(query_key, rank, key, score): the k documents of highest score above 0 for each query row.

    A score sums w * ((10^9 * tf) div (1000 * tf + 20 * m)) over the query's terms, once each; w = floor(1000 * ln((2N + 2) /
    (2df + 1))), m = 50 + (50 * n * N) div L, with N documents that have a term and L terms in all.  Equal scores go by
    smaller key, null keys last.  Null and empty texts have no terms: such queries give no rows, such documents never
    match.  Repeated rows are documents, or queries, of their own; extra columns are left out; empty tables give no rows.
    Query texts come to the driver in blocks of about ``block_bytes``, each a pass over all documents, so neither terms
    nor queries that are broadcast grow with either table.  ``postings``, ``window`` and ``share`` steer a task's work only.
    """
    spark = docs.sparkSession
    asked = staged(queries.select(F.monotonically_increasing_id().alias("row"), F.col(query_key).alias("name"),
                                  F.col(query_text).cast("binary").alias("text")).filter("length(text) > 0"), "queries")
    size = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks, out = -(-size // block_bytes), None
    for number in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == number).orderBy("row").toArrow()
        texts = [sorted(set(terms(x))) for x in block.column("text").to_pylist()]
        wanted = sorted(set().union(*texts)) if texts else []
        if not wanted:
            continue
        indexed = staged(index(docs, wanted, key, text), "postings")
        documents, length = indexed.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not length:
            break
        df = np.zeros(len(wanted), np.int64)
        for row in indexed.select(F.explode("ids").alias("id")).groupBy("id").count().collect():  # a row per term of the block
            df[row.id] = row["count"]
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        place = {term: i for i, term in enumerate(wanted)}
        picked = [np.array([place[x] for x in names], np.int64) for names in texts]
        found = indexed.filter("size(ids) > 0").mapInArrow(scan(picked, weight, documents, length, k, postings, window, share), "q long, key long, score long")
        order = [F.desc("score"), F.asc("key")]
        some = found.withColumn("_r", F.row_number().over(Window.partitionBy("q", F.pmod(F.xxhash64("key"), F.lit(64))).orderBy(*order)))
        ranked = some.filter(F.col("_r") <= k).withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order)))
        names = spark.createDataFrame(list(enumerate(block.column("name").to_pylist())), f"q long, {query_key} {asked.schema['name'].dataType.simpleString()}")
        part = ranked.filter(F.col("rank") <= k).join(F.broadcast(names), "q").select(
            query_key, "rank", F.when(F.col("key") != LAST, F.col("key")).alias(key), "score")
        part = staged(part, "found") if blocks > 1 else part
        out = part if out is None else out.union(part)
    kind = queries.schema[query_key].dataType.simpleString()
    return out if out is not None else spark.createDataFrame([], f"{query_key} {kind}, rank int, {key} long, score long")
