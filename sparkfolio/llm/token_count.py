"""Token counts of whole texts with a map-side lookup in two tiers.

A text's tokens are the sum of its pre-tokens' tokens, and few pre-tokens make up most of a corpus.  A first pass keeps
sketches of frequent pre-tokens, of fixed size whatever the corpus, over all texts; the most frequent ones are encoded
once and their lengths are broadcast as one table.  The second pass cuts each text into pre-tokens and adds up lengths:
from the table, else from the worker's own cache, which encodes what it hasn't met.  Pre-tokens never are shuffled; only
sketches are.  The table and the caches decide where a length comes from, not what it is, so a sketch may be approximate.

A vocabulary file of a public tokenizer (``tokenizers`` JSON: NFC, white space, lower case, word pattern, byte-level BPE
with word ends) is read on each worker; its path is a parameter.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from unicodedata import category, normalize

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkfolio.llm.common import staged

#: Pre-tokens in the broadcast table, and the items that a sketch tracks.
FREQUENT, TRACKED = 10_000, 40_000
#: Lengths that a worker remembers beside the table, and the longest pre-token that it remembers.
CACHE, CACHE_LETTERS = 400_000, 48
#: Groups in which sketches are merged before they meet, so that the last merge has few of them at any size.
GROUPS = 64


class Cutter:
    """Pre-tokens of a text, and the length of one in tokens, as the vocabulary file defines them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        cut, bytes_ = spec["pre_tokenizer"]["pretokenizers"]
        if steps != ["NFC", "Replace", "Lowercase"] or cut["behavior"] != "Removed" or not cut["invert"] or bytes_["type"] != "ByteLevel":
            raise ValueError("a tokenizer with NFC, white space, lower case and a word pattern is needed")
        self.word = regex.compile(cut["pattern"]["Regex"])
        special = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.known, self.whole = set(map(chr, range(128))), Tokenizer.from_file(path)
        # What is left to the library is one pre-token: no normalizer, no cutting, no special tokens.
        self.coder = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": bytes_, "added_tokens": []}))

    def length(self, word: str) -> int:
        return len(self.coder.encode(word, add_special_tokens=False).ids)

    def words(self, piece: str) -> list[str]:
        # Lower case letter by letter, so a final sigma is a sigma like others.
        return self.word.findall(normalize("NFC", piece).replace("Σ", "σ").lower())

    def newer(self, text: str) -> bool:
        """Has the text a character that this Python's Unicode data doesn't know, though the library's may?"""
        letters = set(text)
        if letters <= self.known:
            return False
        if any(category(x) == "Cn" for x in letters - self.known):
            return True
        self.known |= letters
        return False

    def count(self, text: str, length: Callable[[str], int]) -> int:
        """Tokens of a whole text; a special token's string is one token.

        A text with letters newer than this Python's Unicode data is left to the library, whose data may differ.
        """
        if not text.isascii() and self.newer(text):
            return len(self.whole.encode(text, add_special_tokens=False).ids)
        if self.special is None:
            return sum(map(length, self.words(text)))
        pieces = self.special.split(text)
        return len(pieces) - 1 + sum(sum(map(length, self.words(piece))) for piece in pieces)


@lru_cache(maxsize=2)
def load(path: str) -> Cutter:
    return Cutter(path)


class Lengths(dict):
    """The second tier: lengths of the words of a worker, on top of the broadcast table; misses are encoded."""

    def __init__(self, table: dict[str, int], encode: Callable[[str], int]):
        super().__init__(table)
        self.table, self.encode, self.misses = table, encode, 0

    def __missing__(self, word: str) -> int:
        self.misses += 1
        got = self.encode(word)
        if len(word) <= CACHE_LETTERS:
            if len(self) >= len(self.table) + CACHE:
                self.clear()
                self.update(self.table)
            self[word] = got
        return got


def pieces(text: Column) -> Column:
    """Pre-tokens in the JVM, near enough to find the frequent ones."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"('s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+)"), F.lit(1))


def frequent(docs: DataFrame, text: str = "text", most: int = FREQUENT, tracked: int = TRACKED) -> list[str]:
    """About the ``most`` most frequent pre-tokens of all texts, from mergeable sketches of bounded size."""
    word = docs.select(F.pmod(F.spark_partition_id(), F.lit(GROUPS)).alias("part"), F.explode(pieces(F.col(text))).alias("word"))
    sketches = staged(word.filter(F.length("word") <= CACHE_LETTERS).groupBy("part")
                .agg(F.expr(f"approx_top_k_accumulate(word, {tracked})").alias("sketch")), "sketches")
    if sketches.isEmpty():  # the merge of no sketch at all is an error
        return []
    top = sketches.agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {tracked}), {most})").alias("top")).first()
    return [x.item for x in top.top]


def table(words: list[str], path: str) -> dict[str, int]:
    """Length in tokens of each word."""
    cutter = load(path)
    return {word: cutter.length(word) for word in words}


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 2048,
                 known: list[str] | None = None) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) per row: UTF-8 bytes, tokens, and whether these are more than ``limit``.

    Null text counts as empty, with no tokens.  Whole texts are counted, of any length.  Rows are kept one by one, so
    repeated and null keys stay; an empty table gives no rows; extra columns are left out.  ``known`` are the words of
    the first tier, by default the frequent ones of ``docs``; any words give the same counts.
    """
    spark = docs.sparkSession
    lengths = spark.sparkContext.broadcast(table(frequent(docs, text) if known is None else known, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = load(path)
        length = Lengths(lengths.value, cutter.length).__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts = [cutter.count(x, length) if x else 0 for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64())],
                                                 names=["key", "n_bytes", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    whole = F.coalesce(F.col(text), F.lit(""))
    counted = docs.select(F.col(key).alias("key"), F.octet_length(whole).cast("long").alias("n_bytes"), whole.alias("text")).mapInArrow(
        run, f"key {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
