"""Secret scans: patterns, and runs of characters that look random.

Base kinds are patterns.  What they miss is judged by two character Markov models, one of random strings and one of
ordinary identifiers: the log-likelihood ratio of a run decides.  Both are trained from labelled samples; ``samples``
labels those of a corpus (values that a base pattern found against other long runs), ``random_strings`` adds seeded
strings over the alphabets that keys use, because a corpus may hold one kind of secret only.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.llm.bpe import small

#: Kinds in the order in which spans with equal start are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: A text without any of these (in lower case) holds no assignment.
HINTS = ("passw", "secret", "token", "api")
#: Characters of a run; a Markov model has these states and one for the start.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
STATE = {c: i for i, c in enumerate(ALPHABET)}
START = len(ALPHABET)
IN_RUN = np.zeros(129, np.bool_)
IN_RUN[[ord(c) for c in ALPHABET if c != "."]] = True


def long_runs(text: str, least: int) -> list[tuple[int, int]]:
    """(start, end) of the maximal runs of run characters with ``least`` or more of them."""
    if len(text) < least:
        return []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = IN_RUN[np.minimum(codes, 128)]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    keep = ends - starts >= least
    return list(zip(starts[keep].tolist(), ends[keep].tolist(), strict=True))


def base_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds; ``runs``: the text's runs of 32 or fewer characters' minimum."""
    found = []
    lower = text.lower()
    if any(hint in lower for hint in HINTS):
        found += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(*m.span(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    for a, b in runs:  # hex characters are run characters, so a long hex run lies within a long run
        if b - a >= 32:
            found += [(*m.span(), 2) for m in HEX.finditer(text, a, b) if m.end() - m.start() >= 32]
    return sorted((start, kind, end) for start, end, kind in found)


def free_runs(runs: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs that no span overlaps."""
    return [r for r in runs if not any(s < r[1] and r[0] < e for s, _, e in spans)] if spans else runs


def random_strings(spark: SparkSession, n: int = 6_000, seed: int = 11) -> DataFrame:
    """Labelled samples (value, is_random = true): seeded strings of 20 to 64 characters over usual key alphabets."""
    alphabets = ("0123456789abcdef", ALPHABET[:36] + ALPHABET[52:62], ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + "_-")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in batch.column(0).to_pylist():
                rng = random.Random(seed * 1_000_003 + i)
                out.append("".join(rng.choices(alphabets[i % len(alphabets)], k=rng.randint(20, 64))))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array([True] * len(out))], names=["value", "is_random"])

    return spark.range(n).mapInArrow(run, "value string, is_random boolean")


def samples(docs: DataFrame, text: str = "text", least: int = 8) -> DataFrame:
    """Labelled samples of all whole texts: (value, is_random, n), summed within a batch of texts.

    Values of base patterns are random, other runs of ``least`` or more characters are ordinary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: Counter[tuple[str, bool]] = Counter()
            for value in batch.column(0).to_pylist():
                value = value or ""
                runs = long_runs(value, least)
                spans = base_spans(value, runs)
                for start, kind, end in spans:
                    got = ASSIGN.match(value, start)[2] if kind == 0 else value[start:end]
                    count[got, True] += 1
                for a, b in free_runs(runs, spans):
                    count[value[a:b], False] += 1
            keys = list(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()),
                 pa.array([count[k] for k in keys], pa.int64())], names=["value", "is_random", "n"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "value string, is_random boolean, n long")


def transitions(labelled: DataFrame) -> DataFrame:
    """(is_random, state, following, n): counts of character pairs, at most 2 x 69 x 68 rows however many samples.

    ``labelled``: value, is_random and optionally n.  Null values and characters outside the alphabet are skipped.
    Each task sums its own samples before the shuffle.
    """
    n = F.col("n") if "n" in labelled.columns else F.lit(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, START + 1, START), np.int64)
        for batch in batches:
            for value, label, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                state, table = START, total[int(bool(label))]
                for c in value or "":
                    after = STATE.get(c)
                    if after is not None:
                        table[state, after] += times
                        state = after
        at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at[0] == 1), pa.array(at[1].astype(np.int32)), pa.array(at[2].astype(np.int32)), pa.array(total[at])],
            names=["is_random", "state", "following", "n"])

    counted = labelled.select("value", "is_random", n.cast("long").alias("n")).mapInArrow(
        run, "is_random boolean, state int, following int, n long")
    return counted.groupBy("is_random", "state", "following").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, smoothing: float = 0.5) -> np.ndarray:
    """Log-likelihood ratio of each (state, following): random over ordinary.  Without samples all are 0."""
    total = np.full((2, START + 1, START), smoothing)
    for r in transitions(labelled).collect():  # bounded by the alphabet
        total[int(r.is_random), r.state, r.following] += r.n
    chance = total / total.sum(axis=2, keepdims=True)
    return np.log(chance[1]) - np.log(chance[0])


def ratio(value: str, table: np.ndarray) -> float:
    """Log-likelihood ratio of a string."""
    state, total = START, 0.0
    for c in value:
        total += table[state, STATE[c]]
        state = STATE[c]
    return total


def scan(docs: DataFrame, table: np.ndarray, key: str = "doc_id", text: str = "text", least: int = 16,
         odds: float = 1e6) -> DataFrame:
    """(key, spans array<struct<kind, start, end>>) per row: where secrets are, in code points, end exclusive.

    A run of ``least`` or more characters outside base spans is ``random`` when its likelihood ratio is ``odds`` or
    more.  Null text counts as empty; repeated and null keys keep their rows; extra columns are left out.
    """
    limit = math.log(odds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            out = []
            for value in batch.column(1).to_pylist():
                value = value or ""
                runs = long_runs(value, least)
                spans = base_spans(value, runs)
                spans += [(a, 3, b) for a, b in free_runs(runs, spans) if ratio(value[a:b], table) >= limit]
                out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(spans)])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["key", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"key {kind}, spans array<struct<kind: string, start: long, end: long>>").withColumnRenamed("key", key)


def digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and digests of the spans of ``scan``."""
    base = F.filter("spans", lambda s: s.kind != "random")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS[:3]]
    return scanned.select(key, *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def base_sha256(text: str) -> str:
    """Digest of the base spans of one text."""
    spans = base_spans(text, long_runs(text, 16))
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def redact(docs: DataFrame, table: np.ndarray, text: str = "text", mark: str = "<secret>", least: int = 16,
           odds: float = 1e6) -> DataFrame:
    """``docs`` with each found span of the text replaced by ``mark``; overlapping spans become one mark.

    Other columns, null texts and the order of columns stay.
    """
    limit, at = math.log(odds), docs.columns.index(text)

    def clean(value: str | None) -> str | None:
        if not value:
            return value
        runs = long_runs(value, least)
        spans = base_spans(value, runs)
        spans += [(a, 3, b) for a, b in free_runs(runs, spans) if ratio(value[a:b], table) >= limit]
        out, done = [], 0
        for a, _, b in sorted(spans):
            if a >= done:
                out += [value[done:a], mark]
            done = max(done, b)
        return "".join(out) + value[done:] if out else value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = pa.array([clean(x) for x in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), texts)

    return docs.mapInArrow(run, docs.schema)
