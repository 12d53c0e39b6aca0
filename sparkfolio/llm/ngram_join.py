"""Jaccard join of documents on word n-grams with PartEnum signatures, and the classes that its links form.

A document is the set of its distinct word n-grams (64-bit hashes).  Sets of equal content are one node, so copies
cost nothing later.  Sizes are cut into bands so that similar sets lie in one band or in neighbouring ones; an
instance of the scheme serves two neighbouring bands and knows the largest symmetric difference k of a similar pair.
Features are dealt to ``first`` parts, each cut into ``second`` parts, and a signature is the content of ``second -
spare`` of them: with k differences, some part has at most ``spare``, so a similar pair shares a signature.

A part without any rare feature says little: empty parts, and those with frequent features only (licence lines), would
gather documents that have nothing else in common.  There are more parts than needed, so a set with few such weak
parts may leave them out and still shares a strong signature with every similar set; a set with too many adds its weak
signatures, which meet those of other such sets only.  The choice of frequent features changes the work, never the result.

Groups of one signature are not expanded into pairs.  A sorted stream gives each member the group's first node; those
links are verified on the full sets and merged into classes.  Only groups that still hold several classes go on: their
members are verified against other hubs, a different one in each round, and at last pairs of nodes of different classes
are.  Hubs are drawn by node and round, so groups of much the same members share one, and a round makes a few pairs a
member (about the logarithm of the group), however many signatures the members share.  So every pair that could join two classes has been verified.

Before full sets are fetched, sketches are compared: the parity of the number of features in each of ``64 * WORDS``
buckets.  A feature that only one of two sets holds changes one bit, so sets differ in at least as many features as their
sketches do in bits; a pair whose sketches differ too much can't be similar, and the join that meets the members of a
group drops it without making a row.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.bpe import small
from sparkfolio.llm.common import components, staged

A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Largest number of frequent features (bounds what each task holds), rounds of other hubs before the remaining pairs,
#: and 64-bit words of a sketch.
FREQUENT, HUB_ROUNDS, WORDS = 50_000, 2, 16
#: Members of a group that a cell of the last round takes from each side.
CELL = 500
SKETCH = [f"s{i}" for i in range(WORDS)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * B
    x = (x ^ (x >> np.uint64(29))) * A
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a text, A-Z in lower case; fewer words: one for all of them."""
    tokens = (text or "").encode().lower().split()  # bytes: ASCII letters and the six blanks only
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    width = min(n, len(tokens))
    gram = np.full(len(tokens) - width + 1, width, np.uint64)
    for i in range(width):
        gram = mixed(gram * A + h[i:len(h) - width + 1 + i])
    return np.unique(gram)


def node_of(grams: np.ndarray) -> int | None:
    """64-bit digest of a set, the identity of equal sets; None for the empty set."""
    if not len(grams):
        return None
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


@dataclass(frozen=True)
class Instance:
    """One PartEnum scheme for sets of two neighbouring size bands."""

    number: int
    first: int
    second: int
    spare: int
    slack: int


@lru_cache(maxsize=100_000)
def instances(size: int, percent: int) -> tuple[Instance, ...]:
    """The two instances of a set size; none where k is 0, since then only equal sets are similar."""
    low, number = 1, 0
    while low * 100 // percent < size:
        low, number = low * 100 // percent + 1, number + 1
    top = low * 100 // percent
    found = []
    for i, high in ((number, top), (number + 1, (top + 1) * 100 // percent)):
        k = 2 * high * (100 - percent) // (100 + percent)
        if k:
            spare, second = (1, 3) if k <= 12 else (0, 1)
            least = k // (spare + 1)
            slack = math.ceil(0.15 * least) + 1
            found.append(Instance(i, least + 1 + slack, second, spare, slack))
    return tuple(found)


def signatures(grams: np.ndarray, percent: int, frequent: np.ndarray) -> np.ndarray:
    """PartEnum signatures of a set, without the weak ones where those aren't needed."""
    out = []
    rare = np.ones(len(grams), bool)
    if len(frequent) and len(grams):
        rare = frequent[np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)] != grams
    spread, content = mixed(grams ^ B), mixed(grams + A)
    for x in instances(len(grams), percent) if len(grams) else ():
        part = ((spread >> np.uint64(20)) % np.uint64(x.first * x.second)).astype(np.int64)
        total = np.zeros(x.first * x.second, np.uint64)
        np.add.at(total, part, content)
        strong = np.bincount(part[rare], minlength=len(total)) > 0
        total, strong = total.reshape(x.first, x.second), strong.reshape(x.first, x.second)
        if x.spare:  # every choice of second - 1 of the second-level parts
            total = total.sum(axis=1, keepdims=True, dtype=np.uint64) - total
            strong = (strong.sum(axis=1, keepdims=True) - strong) > 0
        place = np.arange(total.size, dtype=np.uint64).reshape(total.shape) + np.uint64(x.number << 32)
        sign = mixed(total + mixed(place * A + B))
        out.append(sign[strong])
        if (~strong).any(axis=1).sum() > x.slack:
            out.append(mixed(sign[~strong] ^ A))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def frequent_grams(docs: DataFrame, n: int, one_in: int = 16, share: float = 0.001) -> np.ndarray:
    """Sorted hashes of n-grams in ``share`` or more of every ``one_in``-th document, at most ``FREQUENT``.

    Only steers which signatures are weak; any choice gives the same links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[int] = Counter()
        seen = 0
        for batch in small(batches):
            for text in batch.column(0).to_pylist():
                count.update(shingles(text, n).tolist())
                seen += 1
            if len(count) > 2_000_000:  # rare ones go; a frequent one comes again
                count = Counter({g: c for g, c in count.items() if c > 1})
        kept = [(g, c) for g, c in count.items() if c > 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array([0] + [g for g, _ in kept], np.uint64).view(np.int64)), pa.array([seen] + [c for _, c in kept], pa.int64())],
            names=["gram", "n"])

    picked = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0)
    counted = picked.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counted = staged(counted, "grams")
    seen = (counted.filter("gram = 0").first() or [0, 0])[1]
    rows = counted.filter((F.col("gram") != 0) & (F.col("n") >= max(4.0, share * seen))).orderBy(F.desc("n"), "gram").limit(FREQUENT).collect()
    return np.sort(np.array([r.gram for r in rows], np.int64).view(np.uint64))


def classes(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_hash, node, n_shingles, component_id, keeper) per row of ``docs``.

    Two documents link when 100 * |intersection| >= percent * |union| of their n-grams; ``component_id`` is the
    smallest key that links lead to.  A row without words has n_shingles 0 and is linked with nothing: its component is
    its own key.  Rows that repeat a key are separate documents; a null key is never the smallest while there is
    another, and a class of null keys only has a null component.  ``keeper`` marks the rows to keep if one of each
    class stays: rows without words, and those of the class's smallest (key, text hash); rows equal in both are one
    document, repeated.  Extra columns are left out; an empty table gives no rows.
    """
    docs = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = docs.schema["key"].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sets = [shingles(x, n) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(map(node_of, sets), pa.int64()), pa.array(map(len, sets), pa.int64())],
                names=["key", "text_hash", "node", "n_shingles"])

    hashed = docs.select("key", F.xxhash64("text").alias("text_hash"), "text")
    described = staged(hashed.mapInArrow(describe, f"key {kind}, text_hash long, node long, n_shingles long"), "nodes")
    order = F.struct(F.col("key").isNull().alias("null"), F.col("key"), F.col("text_hash"))
    nodes = staged(described.filter("node IS NOT NULL").groupBy("node").agg(F.min(order).alias("rep"), F.max("n_shingles").alias("n")), "reps")

    labels = _labels(docs, nodes, n, percent)
    named = nodes.join(labels, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("rep").alias("least"))
    named = staged(named.join(least, "label").select("node", "least"), "classes")
    same = F.col("least.key").eqNullSafe(F.col("key")) & (F.col("least.text_hash") == F.col("text_hash"))
    return (described.join(named, "node", "left").select(
        F.col("key").alias(key), "text_hash", "node", "n_shingles",
        F.when(F.col("node").isNull(), F.col("key")).otherwise(F.col("least.key")).alias("component_id"),
        (F.col("node").isNull() | same).alias("keeper")))


def _labels(docs: DataFrame, nodes: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, label) of the nodes that share a signature with another: label is the smallest node of the class."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_grams(docs, n))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed: set[int | None] = set()  # copies that a task has signed already
        for batch in small(batches):
            sig, node = [], []
            for text in batch.column(0).to_pylist():
                grams = shingles(text, n)
                if (name := node_of(grams)) in signed:
                    continue
                if len(signed) >= 1_000_000:
                    signed.clear()
                signed.add(name)
                found = signatures(grams, percent, frequent.value)
                if len(found):
                    sig.append(found.view(np.int64))
                    node.append(np.full(len(found), name, np.int64))
            if sig:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig)), pa.array(np.concatenate(node))], names=["sig", "node"])

    signed = docs.select("text").mapInArrow(sign, "sig long, node long")
    groups = staged(signed.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(_stars, "sig long, hub long, node long"), "groups")
    sets = staged(_sets(docs, nodes, groups.select("node").union(groups.select("hub")).distinct(), n), "sets")
    members = groups.select("sig", "node").union(groups.select("sig", "hub").distinct())

    labels = sets.select("node", F.col("node").alias("label"))
    fresh = tried = staged(groups.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "tried")
    turn, last = 0, False
    while True:
        links = _verified(fresh, sets, percent)
        for end in ("a", "b"):  # links between classes, named by their labels
            links = links.join(labels.toDF(end, f"_{end}"), end)
        merged = components(links.select(F.col("_a").alias("a"), F.col("_b").alias("b")))
        labels = staged(labels.join(merged.toDF("label", "_label"), "label", "left").select("node", F.coalesce("_label", "label").alias("label")), "labels")
        if last:
            return labels
        marked = members.select("sig", "node").join(labels, "node")
        several = marked.groupBy("sig").agg(F.min("label").alias("_l"), F.max("label").alias("_h")).filter("_l <> _h").select("sig")
        members = staged(marked.join(several, "sig", "left_semi"), "open")
        if members.isEmpty():
            return labels
        last = turn == HUB_ROUNDS
        if last:
            # A group is cut into a grid of cells, so that a large one is spread over many tasks.
            grid = members.groupBy("sig").agg(F.ceil(F.count("*") / F.lit(float(CELL))).alias("grid"))
            known = members.join(sets.select("node", "n", *SKETCH), "node").join(grid, "sig").withColumn("own", F.pmod(F.xxhash64("node"), F.col("grid")))
            every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("grid") - 1))
            one, two = (known.select("sig", F.col("own").alias(own), every.alias(other), *[F.col(c).alias(f"{side}{c}") for c in ("node", "label", "n", *SKETCH)])
                        for side, own, other in (("a", "row", "column"), ("b", "column", "row")))
            pairs = one.join(two, (one.sig == two.sig) & (one["row"] == two["row"]) & (one["column"] == two["column"])
                             & (F.col("alabel") < F.col("blabel")) & _close(percent))
            pairs = pairs.select(F.least("anode", "bnode").alias("a"), F.greatest("anode", "bnode").alias("b"))
        else:
            hubs = members.groupBy("sig").agg(F.min_by(F.struct("node", "label"), F.xxhash64("node", F.lit(turn))).alias("hub"))
            pairs = members.join(hubs, "sig").filter(F.col("label") != F.col("hub.label")).select(
                F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"))
        fresh = staged(pairs.distinct().join(tried, ["a", "b"], "left_anti"), "fresh")
        tried, turn = tried.union(fresh), turn + 1


def _close(percent: int) -> Column:
    """Whether sets a and b can be similar, by their sizes an, bn and sketches as0, bs0 and so on."""
    differ = F.lit(0)
    for c in SKETCH:
        differ = differ + F.bit_count(F.col(f"a{c}").bitwiseXOR(F.col(f"b{c}")))
    return ((100 * F.least("an", "bn") >= percent * F.greatest("an", "bn"))
            & ((100 + percent) * differ <= (100 - percent) * (F.col("an") + F.col("bn"))))


def sketch(grams: np.ndarray) -> np.ndarray:
    """Parity of the number of features in each bucket, as 64-bit words."""
    odd = np.bincount((mixed(grams ^ A) >> np.uint64(20)).astype(np.int64) % (64 * WORDS), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (sig, node): (sig, first node of the group, node) for the others of each group, once each."""
    last_sig = last_node = hub = None
    for batch in batches:
        if not batch.num_rows:
            continue
        sig, node = (batch.column(i).to_numpy() for i in (0, 1))
        if last_sig is None:
            last_sig, last_node = ~sig[0], node[0]
        before_sig, before_node = np.concatenate(([last_sig], sig[:-1])), np.concatenate(([last_node], node[:-1]))
        starts = sig != before_sig
        at = np.maximum.accumulate(np.where(starts, np.arange(len(sig)), -1))
        hubs = np.where(at >= 0, node[at], hub if hub is not None else node[0])
        keep = ~starts & (node != before_node)
        last_sig, last_node, hub = sig[-1], node[-1], hubs[-1]
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(hubs[keep]), pa.array(node[keep])], names=["sig", "hub", "node"])


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(node, n, grams, sketch) of the wanted nodes, from the text of one document of each."""
    reps = nodes.join(wanted, "node", "left_semi").select("node", "n", F.col("rep.text_hash").alias("_h"), F.col("rep.key").alias("_key"))
    texts = (docs.withColumn("_h", F.xxhash64("text")).join(reps, "_h").filter(F.col("key").eqNullSafe(F.col("_key")))
             .select("node", "n", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            grams = [shingles(x, n) for x in batch.column(2).to_pylist()]
            sketches = np.stack([sketch(g) for g in grams], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([g.view(np.int64) for g in grams], pa.list_(pa.int64())), *map(pa.array, sketches)],
                names=["node", "n", "grams", *SKETCH])

    kinds = ", ".join(f"{c} long" for c in SKETCH)
    return texts.mapInArrow(run, f"node long, n long, grams array<long>, {kinds}").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, per_task: int = 500) -> DataFrame:
    """The pairs (a, b) whose full sets are similar.  A node in many pairs (a hub) is copied, so its pairs spread."""
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("node").alias(side), *[F.col(c).alias(f"{side}{c}") for c in ("n", *SKETCH)]), side)
    pairs = staged(pairs.filter(_close(percent)).select("a", "b", F.col("an").alias("na"), F.col("bn").alias("nb")), "close")
    # The node with more pairs is fetched last, in copies.
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(float(per_task))).alias("copies"))
    dealt = pairs.join(many, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("copies")))
    copied = (sets.join(many, sets.node == many.a).select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("salt"),
                                                          F.col("grams").alias("ga")))
    full = dealt.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b").join(copied, ["a", "salt"])
    shared = F.size(F.array_intersect("ga", "gb"))
    return full.filter(100 * shared >= percent * (F.col("na") + F.col("nb") - shared)).select("a", "b")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest key.  Documents without words all stay.

    Columns stay as they are.  Rows equal in key and text count as one document and one of them stays.
    """
    kept = classes(docs, n, percent, key, text).filter("keeper").select(F.col(key).alias("_key"), F.col("text_hash").alias("_hash"), "n_shingles")
    empty = kept.filter("n_shingles = 0").select("_key", "_hash")
    kept = staged(kept.filter("n_shingles > 0").select("_key", "_hash").distinct().union(empty.distinct()), "kept")
    marked = docs.withColumn("_hash", F.xxhash64(text))
    joined = marked.join(kept.withColumnRenamed("_hash", "_kept"), (F.col("_hash") == F.col("_kept")) & F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    blank = F.coalesce(F.col(text), F.lit("")).rlike("^[\\x20\\x09-\\x0D]*$")
    return joined.filter(blank).drop("_hash").unionByName(joined.filter(~blank).dropDuplicates([key, "_hash"]).drop("_hash"))
