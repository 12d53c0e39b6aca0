"""Byte-level BPE encoding and decoding with a contiguous rank array per word.

A vocabulary file of a public tokenizer (``tokenizers`` JSON) is read on each worker; its path is a parameter.
Text is cut into special tokens and words; a word's bytes are merged by rank.  A short word holds its part
boundaries and the ranks of adjacent parts in two small lists: find the smallest rank, delete that boundary, refresh
the two ranks beside it, until no pair has a rank.  Scanning is quadratic, so words over ``SHORT`` bytes keep the
same parts in a linked list with a heap of ranks, which gives the same merges in n log n.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Word pattern of byte-level BPE (fixed value of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes up to which a word is merged by scanning.
SHORT = 96
#: Distinct words that a worker remembers, and the longest that it remembers.
CACHE, CACHE_BYTES = 200_000, 48
NO_RANK = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 for itself, others from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, letter = spec["model"], byte_letters()
        if model.get("type", "BPE") != "BPE" or spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("a byte-level BPE without normalizer is needed")
        ids = model["vocab"]
        self.first = {letter[token]: i for token, i in ids.items() if token in letter}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault((ids[left], ids[right]), len(self.made))
            self.made.append(ids[left + right])
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        self.bytes = {i: bytes(letter[c] for c in token) for token, i in ids.items() if token not in self.special}
        self.bytes |= {i: content.encode() for content, i in self.special.items()}
        tokens = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, tokens)) + ")") if tokens else None
        self.word = regex.compile(PATTERN)
        self.known: dict[str, tuple[str, int]] = {}

    def merge_short(self, word: bytes) -> list[int]:
        parts = [self.first[b] for b in word]
        rank = self.rank
        ranks = [rank.get(pair, NO_RANK) for pair in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            at = ranks.index(least)
            parts[at] = self.made[least]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank.get((parts[at - 1], parts[at]), NO_RANK)
            if at < len(ranks):
                ranks[at] = rank.get((parts[at], parts[at + 1]), NO_RANK)
        return parts

    def merge_long(self, word: bytes) -> list[int]:
        parts = [self.first[b] for b in word]
        n, rank = len(parts), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1)
                if (r := rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:  # one of the parts has changed since
                continue
            parts[i], parts[j] = self.made[r], -1
            after[i] = j = after[j]
            if j < n:
                before[j] = i
                if (new := rank.get((parts[i], parts[j]))) is not None:
                    heapq.heappush(heap, (new, i, parts[i], parts[j]))
            h = before[i]
            if h >= 0 and (new := rank.get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (new, h, parts[h], parts[i]))
        return [p for p in parts if p >= 0]

    def merge(self, word: bytes) -> list[int]:
        return self.merge_short(word) if len(word) <= SHORT else self.merge_long(word)

    def entry(self, word: str) -> tuple[int, ...]:
        """Ids of a word, remembered if the word is short."""
        raw = word.encode()
        got = tuple(self.merge(raw))
        if len(raw) <= CACHE_BYTES:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[word] = got
        return got

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        known, entry = self.known, self.entry
        for k, piece in enumerate(self.cut.split(text) if self.cut else (text,)):
            if k % 2:
                ids.append(self.special[piece])
                continue
            for word in self.word.findall(piece):
                ids += known.get(word) or entry(word)
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) per row; null text encodes as the empty text, with no ids.  Rows are kept one by one, so
    repeated and null keys stay.  The whole text is encoded; extra columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path)
        for batch in small(batches):
            ids = [coder.encode(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) per row: digests of the decimal ids joined by commas and of the text
    that the ids decode to.  Ids never leave the task.  Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path)
        for batch in small(batches):
            counts, coded, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                ids = coder.encode(text or "")
                counts.append(len(ids))
                coded.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()),
                 pa.array(decoded, pa.string())], names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)


def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of a few rows, so that Python objects of few texts live at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
