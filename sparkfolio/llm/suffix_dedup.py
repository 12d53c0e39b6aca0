"""Removal of repeated byte strings with deep-shallow suffix sorting.

A byte goes when a string of ``length`` bytes that covers it starts anywhere else too.  Sorting every suffix of a corpus
is not needed to know that: each string of ``length`` bytes has an anchor, the leftmost of its grams (half its length)
with the smallest hash, which depends on the string only.  Strings of one document with the same anchor are
neighbours; together they span a context, the bytes around the anchor.  Equal strings have equal anchors at the same
place in them, so only contexts with equal anchor grams are compared, and of equal contexts one.

Of such contexts the suffixes that start at the anchor are sorted, and so are the reversed prefixes that end there:
multikey quicksort down to a shallow depth, then a blind trie for each group that is still equal.  With both orders and
their common prefixes, two contexts that agree on L bytes to the left and R to the right of the anchor share the
strings in between; merging the suffix order from its longest common prefix down, and keeping each merged set in prefix
order, finds the best L for every R from neighbours alone, without pairs.

A gram with more than ``most`` different contexts isn't gathered: its contexts are expanded to their strings' hashes,
which are counted by an aggregation.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.bpe import small
from sparkfolio.llm.common import staged

BASE = 0x9E3779B97F4A7C15 | 1
C1, C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: String starts that are hashed at once; an index in a block fits in INDEX bits.
BLOCK, INDEX = 1 << 19, 20
SHALLOW, STEP = 64, 8


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * C1
    x = (x ^ (x >> np.uint64(27))) * C2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of BASE, of its inverse modulo 2^64, and a value for each byte."""
    n = BLOCK + (1 << 16)
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down), mixed(np.arange(1, 257, dtype=np.uint64))


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def anchors(data: bytes, length: int) -> tuple[np.ndarray, ...]:
    """(gram hash, context hash, first string start, last, anchor) of each anchor of a text."""
    found = []
    gram = length // 2
    for begin in range(0, max(0, len(data) - length + 1), BLOCK):
        raw = np.frombuffer(data, np.uint8)[begin:begin + BLOCK + length - 1]
        up, down, value = powers()
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(value[raw] * up[:len(raw)], out=total[1:])
        h = mixed((total[gram:] - total[:-gram]) * down[:len(raw) - gram + 1])
        mask = np.uint64((1 << INDEX) - 1)
        packed = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
        anchor = (least(packed, length - gram + 1) & mask).astype(np.int64)
        first = np.flatnonzero(np.diff(anchor, prepend=-1))
        last = np.append(first[1:], len(anchor)) - 1
        at = anchor[first]
        end = last + length
        context = mixed((total[end] - total[first]) * down[first] + ((end - first) * 1024 + (at - first)).astype(np.uint64) * C1)
        found.append((h[at].view(np.int64), context.view(np.int64), first + begin, last + begin, at + begin))
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class BlindTrie:
    """Orders strings by branching bytes only; a string is compared with one leaf, once.

    A node is [depth, {byte at that depth or -1 at the end: node or string number}].
    """

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None

    def add(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = i
            return
        node = self.root  # blind descent to a leaf that shares as much as any
        while isinstance(node, list):
            depth, below = node
            c = s[depth] if depth < len(s) else -1
            node = below[c] if c in below else next(iter(below.values()))
        other = self.strings[node if isinstance(node, int) else node[0]]
        n = common(s, other)
        parent, edge, node = None, None, self.root
        while isinstance(node, list) and node[0] < n:
            parent, edge = node, s[node[0]] if node[0] < len(s) else -1
            if edge not in node[1]:
                break
            node = node[1][edge]
        c, d = (s[n] if n < len(s) else -1), (other[n] if n < len(other) else -1)
        if isinstance(node, list) and node[0] == n:
            node[1].setdefault(c, i)
            if node[1][c] != i:
                self._same(node[1], c, i)
            return
        if c == d:  # equal strings
            if parent is None:
                self.root = self._joined(self.root, i)
            else:
                self._same(parent[1], edge, i)
            return
        split = [n, {c: i, d: node}]
        if parent is None:
            self.root = split
        else:
            parent[1][edge] = split

    @staticmethod
    def _joined(leaf, i: int):
        return (*leaf, i) if isinstance(leaf, tuple) else (leaf, i)

    def _same(self, below: dict, edge: int, i: int) -> None:
        below[edge] = self._joined(below[edge], i)

    def ordered(self) -> tuple[list[int], list[int]]:
        """String numbers in order, and the common prefix of each with the one before (0 for the first)."""
        order, lcp, stack = [], [], [(self.root, 0)]
        while stack:
            node, depth = stack.pop()
            if isinstance(node, list):
                parts = [node[1][c] for c in sorted(node[1])]
                stack += [(p, node[0]) for p in reversed(parts[1:])]
                stack.append((parts[0], depth))
            else:
                for k, i in enumerate(node if isinstance(node, tuple) else (node,)):
                    order.append(i)
                    lcp.append(len(self.strings[i]) if k else depth)
        return order, lcp


def deep_shallow(strings: list[bytes], depth: int = 0, shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Order of the strings, equal ones by number, and the common prefix of each with the one before.

    All share their first ``depth`` bytes.  Multikey quicksort compares ``STEP`` bytes at a time until ``shallow``
    further bytes; groups that are still equal go to blind tries.
    """
    order: list[int] = []
    limit = depth + shallow
    stack = [(list(range(len(strings))), depth)]
    groups = []
    while stack:
        group, at = stack.pop()
        if len(group) < 2 or at >= limit:
            groups.append(group)
            continue
        key = [strings[i][at:at + STEP] for i in group]
        pivot = sorted((key[0], key[len(key) // 2], key[-1]))[1]
        less = [i for i, k in zip(group, key, strict=True) if k < pivot]
        same = [i for i, k in zip(group, key, strict=True) if k == pivot]
        more = [i for i, k in zip(group, key, strict=True) if k > pivot]
        if more:
            stack.append((more, at))
        # A short key means that the strings end here, and are equal.
        stack.append((same, at + STEP if len(pivot) == STEP else limit))
        if less:
            stack.append((less, at))
    lcp: list[int] = []
    for group in groups:
        if len(group) > 1:
            trie = BlindTrie(strings)
            for i in group:
                trie.add(i)
            part, inner = trie.ordered()
        else:
            part, inner = group, [0]
        if part:
            inner[0] = common(strings[order[-1]], strings[part[0]]) if order else 0
            order += part
            lcp += inner
    return order, lcp


def shared_strings(bodies: list[bytes], places: list[int], lasts: list[int], length: int) -> list[list[tuple[int, int]]]:
    """Of contexts with equal anchor grams: spans of each context that strings shared with another one cover.

    ``places``: where the anchor is in a context; ``lasts``: the last string start.
    """
    spans: list[list[tuple[int, int]]] = [[] for _ in bodies]
    right = [b[p:] for b, p in zip(bodies, places, strict=True)]
    left = [b[:p][::-1] for b, p in zip(bodies, places, strict=True)]
    order, lcp = deep_shallow(right, min(common(right[0], r) for r in right))
    rank = [0] * len(bodies)
    for r, i in enumerate(deep_shallow(left)[0]):
        rank[i] = r
    of_rank = [0] * len(bodies)
    for i, r in enumerate(rank):
        of_rank[r] = i
    owner, sets = list(range(len(bodies))), {i: [rank[i]] for i in range(len(bodies))}

    def find(i: int) -> int:
        while owner[i] != i:
            owner[i] = owner[owner[i]]
            i = owner[i]
        return i

    def note(i: int, before: int, after: int) -> None:
        """Context i agrees with another on ``before`` bytes to the left and ``after`` to the right of the anchor."""
        most, fewest = min(before, places[i]), max(length - after, places[i] - lasts[i])
        if most >= fewest:
            spans[i].append((places[i] - most, places[i] - fewest + length))

    for k in sorted(range(1, len(order)), key=lambda k: -lcp[k]):
        after = lcp[k]
        one, two = find(order[k - 1]), find(order[k])
        if len(sets[one]) < len(sets[two]):
            one, two = two, one
        held = sets[one]
        for r in sets.pop(two):
            at = bisect_left(held, r)
            for other in held[max(0, at - 1):at + 1]:
                i, j = of_rank[r], of_rank[other]
                before = common(left[i], left[j])
                note(i, before, after)
                note(j, before, after)
            held.insert(at, r)
        owner[two] = one
    return spans


def merged(spans) -> list[tuple[int, int]]:
    """Sorted disjoint spans; touching ones become one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            parts, docs = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = anchors((text or "").encode(), length)
                if len(got[0]):
                    parts.append(got)
                    docs.append(np.full(len(got[0]), doc, np.int64))
            if parts:
                gram, context, first, last, at = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram), pa.array(context), pa.array(np.concatenate(docs)), pa.array(first),
                     pa.array((last - first).astype(np.int32)), pa.array((at - first).astype(np.int32))], names=ANCHOR)

    return run


ANCHOR = ["gram", "context", "doc", "first", "reach", "place"]
ANCHOR_KIND = "gram long, context long, doc long, first long, reach int, place int"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted contexts of each document."""
    for batch in small(batches, 64):
        out: list[tuple] = []
        for packed, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = zstandard.decompress(packed)
            out += [(w["gram"], w["context"], w["n"], w["contexts"], w["reach"], w["place"], data[w["first"]:w["end"]]) for w in wanted]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=BODY)


BODY = ["gram", "context", "n", "contexts", "reach", "place", "body"]
BODY_KIND = "gram long, context long, n long, contexts long, reach int, place int, body binary"
SPAN_KIND = "gram long, context long, a int, b int"


def _compare(length: int):
    """Of bodies sorted by gram: spans that strings shared within the gram's contexts cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        out: list[tuple] = []

        def finish() -> None:
            found = shared_strings([r[6] for r in group], [r[5] for r in group], [r[4] for r in group], length)
            for r, spans in zip(group, found, strict=True):
                if r[2] == 1:  # a context that occurs twice is covered as a whole
                    out.extend((r[0], r[1], a, b) for a, b in merged(spans))

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            columns = zip(*out, strict=True) if out else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["gram", "context", "a", "b"])

        for batch in small(batches, 512):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][0] != row[0]:
                    finish()
                    group = []
                group.append(row)
            if len(out) > 20_000:
                yield flush()
                out.clear()
        if group:
            finish()
        yield flush()

    return run


def _strings(length: int):
    """(gram, context, a, hash) of every string of a context; contexts that occur twice are marked by n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 64):
            gram, context, start, sign, n = [], [], [], [], []
            for g, c, times, _, reach, place, body in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                for a in range(reach + 1):
                    gram.append(g)
                    context.append(c)
                    start.append(a)
                    n.append(times)
                    # The place of the anchor is part of the string's name: equal strings have it in the same place.
                    sign.append(hashlib.blake2b(body[a:a + length] + (place - a).to_bytes(4, "big"), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(context), pa.array(start, pa.int32()), pa.array(sign), pa.array(n)],
                                             names=["gram", "context", "a", "sign", "n"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, so that half as much is shuffled as by the shuffle's own compression."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in small(batches):
        texts = [pack.compress((t or "").encode()) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.binary())], names=["doc", "key", "packed"])


def repeated_spans(docs: DataFrame, length: int = 400, most: int = 1_000) -> DataFrame:
    """(doc, spans array<struct<a, b>>): byte spans of ``docs`` (doc, key, text) that repeated strings cover.

    Documents without any are left out; rows with equal doc are one document that occurs as often.
    """
    rows = docs.select("doc", "text").mapInArrow(_anchor_rows(length), ANCHOR_KIND)
    rows = staged(rows, "anchors")
    # Counted before the shuffle, then joined: Spark can split the partition of a gram that a third of all texts hold.
    twice = rows.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram")
    found = staged(rows.join(twice, "gram", "left_semi"), "repeated")
    where = F.struct("doc", "first", "reach", "place")
    contexts = found.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(where).alias("where"))
    grams = contexts.groupBy("gram").agg(F.count("*").alias("contexts")).filter("contexts > 1")
    compared = staged(contexts.join(grams, "gram").select("gram", "context", "n", "contexts", "where.*"), "contexts")

    end = (F.col("first") + F.col("reach") + length).alias("end")
    wanted = compared.groupBy("doc").agg(F.collect_list(F.struct("gram", "context", "n", "contexts", "reach", "place", "first", end)).alias("wanted"))
    kind = docs.schema["key"].dataType.simpleString()
    packed = docs.select("doc", "key", "text").mapInArrow(_packed, f"doc long, key {kind}, packed binary")
    bodies = packed.join(wanted, "doc").select("packed", "wanted").mapInArrow(_cut, BODY_KIND)
    # Rows that repeat a document give its contexts again.
    bodies = staged(bodies.dropDuplicates(["gram", "context"]) if _repeats(docs) else bodies, "bodies")

    few = bodies.filter(F.col("contexts") <= most).repartition("gram").sortWithinPartitions("gram").mapInArrow(_compare(length), SPAN_KIND)
    strings = bodies.filter(F.col("contexts") > most).mapInArrow(_strings(length), "gram long, context long, a int, sign binary, n long")
    shared = strings.groupBy("gram", "sign").agg(F.count("*").alias("c")).filter("c > 1").select("gram", "sign")
    many = strings.filter("n = 1").join(shared, ["gram", "sign"]).select("gram", "context", "a", (F.col("a") + length).alias("b"))
    whole = found.groupBy("gram", "context").agg(F.count("*").alias("n"), F.max("reach").alias("reach")).filter("n > 1").select(
        "gram", "context", F.lit(0).alias("a"), (F.col("reach") + length).alias("b"))
    covers = few.union(many).union(whole).groupBy("gram", "context").agg(F.collect_list(F.struct("a", "b")).alias("s"))
    placed = found.join(covers, ["gram", "context"]).select("doc", F.explode("s").alias("s"), "first").select(
        "doc", F.struct((F.col("first") + F.col("s.a")).alias("a"), (F.col("first") + F.col("s.b")).alias("b")).alias("s"))
    return placed.groupBy("doc").agg(F.collect_set("s").alias("spans"))


def _repeats(docs: DataFrame) -> bool:
    """Whether rows repeat a document."""
    total, distinct = docs.select("doc").groupBy("doc").agg(F.count("*").alias("n")).agg(F.sum("n"), F.count("*")).first()
    return total != distinct


def remove_repeated(docs: DataFrame, length: int = 400, most: int = 1_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept bytes, spans) per row of ``docs``.

    Texts are UTF-8 bytes, null is empty.  A byte is removed when a string of ``length`` bytes that covers it starts
    anywhere else, in the same text too; strings are judged on the texts as they came in.  Rows that repeat a document
    repeat its strings.  What is kept may cut a character in two, so it is bytes.  Extra columns are left out.
    """
    named = docs.select(F.xxhash64(F.col(key), F.col(text)).alias("doc"), F.col(key).alias("key"), F.col(text).alias("text"))
    spans = staged(repeated_spans(named, length, most), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 64):
            rows = []
            for packed, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = zstandard.decompress(packed)
                found = merged((s["a"], s["b"]) for s in spans or ())
                kept, at = [], 0
                for a, b in found:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                rows.append((len(data), sum(b - a for a, b in found), len(found), b"".join(kept), [{"a": a, "b": b} for a, b in found]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]],
                                             names=["key", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    kind = named.schema["key"].dataType.simpleString()
    packed = named.mapInArrow(_packed, f"doc long, key {kind}, packed binary")
    return packed.join(spans, "doc", "left").select("key", "packed", "spans").mapInArrow(
        run, f"key {kind}, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<a: long, b: long>>").withColumnRenamed("key", key)
