"""Phrase collocations: frequent contiguous phrases by Toivonen's sampling method, scored by how their parts attract.

A sample of documents proposes phrases.  A pass over all texts then counts, exactly, the proposals and their negative
border: phrases that weren't proposed though all shorter phrases within them were.  All words belong to one of the two.
Border phrases that turn out frequent join the proposals, which widens the border, and another pass counts what it
gained.  When no border phrase shorter than the longest is frequent, every frequent phrase has been counted.  Phrases have
a few words, so that is so after as many expansions as a phrase has words, less one, at the latest.

Proposals travel as a bit filter of fixed size, which says yes to every proposed phrase and to a few others.  Those count
as proposed too, always and everywhere, so they widen the border and are counted exactly; on corpora that fill the filter
more is counted than needed, up to all phrases, and nothing is missed.  Counts are by the words themselves, not by hash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.llm.common import staged

#: Bytes after which a piece ends; 0xFF stands for them, as no UTF-8 text has it.  A-Z in lower case, a tab is a blank.
ENDS = b".,;:!?\n\x0b\x0c\r"
LETTERS = bytes(0xFF if c in ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words of one language that a task counts together.
BLOCK = 700_000
#: Bits of the filter, its 32,768-bit rows, and bits that a phrase sets.
BITS, ROW, MARKS = 1 << 27, 1 << 15, 3


def mixed(x: np.ndarray) -> np.ndarray:
    """Bit mixer of 64-bit numbers (fixed constants of the finaliser)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def marks(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bits of each phrase, of a filter of ``bits`` bits (a power of 2)."""
    step = mixed(hashes) | np.uint64(1)
    return [((hashes + step * np.uint64(i)) >> np.uint64(20)) & np.uint64(bits - 1) for i in range(MARKS)]


def holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for at in marks(hashes, 8 * len(bits)):
        found &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def word_hash(word: bytes, lang: str) -> int:
    return xxhash.xxh64_intdigest(word, zlib.crc32(lang.encode()))


def longer_hash(shorter: np.ndarray, last: np.ndarray) -> np.ndarray:
    return mixed(shorter + np.uint64(0x9E3779B97F4A7C15)) + last


class Places(dict):
    """Words by order of appearance; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({b"\xff": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self)
        return place


class Text:
    """Words of one language in a task, pieces apart."""

    def __init__(self, lang: str):
        self.lang, self.places, self.parts, self.size = lang, Places(), [], 0

    def add(self, text: bytes) -> None:
        words = (text.translate(LETTERS).replace(b"\xff", b" \xff ") + b" \xff").split()
        self.parts.append(np.fromiter(map(self.places.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def count(self, longest: int, known: np.ndarray | None, before: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        """(lang, phrase, n) of phrases whose shorter phrases are ``known`` and weren't all in ``before``.

        Without ``known``, every phrase counts.  Without ``before``, words count too, and the empty phrase is their sum.
        """
        ids = np.concatenate(self.parts).astype(np.int64)
        names = list(self.places)
        vocabulary = pa.array([b"", *names[1:]], pa.binary()).cast(pa.string())
        hashes = np.array([word_hash(x, self.lang) for x in names], np.uint64)
        total = np.bincount(ids, minlength=len(names))
        if before is None:
            yield from self.rows(pc.take(vocabulary, pa.array(np.arange(1, len(names)))), total[1:])
            yield from self.rows(pa.array([""]), np.array([total[1:].sum()]))
        # Of each phrase length: where phrases start, which phrase each is, and the hashes of the distinct ones.
        starts, which, of_phrase, words = np.flatnonzero(ids), ids[ids > 0] - 1, hashes[1:], len(names)
        for size in range(2, longest + 1):
            has = np.ones(len(of_phrase), bool) if known is None else holds(known, of_phrase)
            had = np.zeros(len(of_phrase), bool) if before is None else holds(before, of_phrase)
            follows = np.zeros(len(starts), bool)  # both shorter phrases are there, and known
            follows[:-1] = (np.diff(starts) == 1) & has[which[:-1]] & has[which[1:]]
            at = np.flatnonzero(follows)
            old = had[which[at]] & had[which[at + 1]]
            key, first, which_next, n = np.unique(which[at] * words + ids[starts[at] + size - 1], return_index=True, return_inverse=True, return_counts=True)
            new = np.flatnonzero(~old[first])
            at_first = starts[at[first]]
            for part in np.array_split(new, len(new) // 100_000 + 1):
                text = [pc.take(vocabulary, pa.array(ids[at_first[part] + i])) for i in range(size)]
                yield from self.rows(pc.binary_join_element_wise(*text, " "), n[part])
            of_phrase = longer_hash(of_phrase[which[at[first]]], hashes[ids[at_first + size - 1]])
            starts, which = starts[at], which_next

    def rows(self, phrases: pa.Array, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(counts):
            yield pa.RecordBatch.from_arrays([pa.array([self.lang]).take(pa.array(np.zeros(len(counts), np.int32))), phrases,
                                              pa.array(counts.astype(np.int64))], names=["lang", "phrase", "n"])


def counted(docs: DataFrame, longest: int, known: np.ndarray | None = None, before: np.ndarray | None = None, block: int = BLOCK) -> DataFrame:
    """(lang, phrase, n): exact sums over all texts of what ``Text.count`` finds in blocks of a task."""
    context = docs.sparkSession.sparkContext
    now, earlier = context.broadcast(known), context.broadcast(before)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Text] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if text:
                        words = held.setdefault(lang, Text(lang))
                        words.add(text)
                        if words.size >= block:
                            yield from held.pop(lang).count(longest, now.value, earlier.value)
            while sum(x.size for x in held.values()) >= 2 * block:  # many languages: the largest goes first
                yield from held.pop(max(held, key=lambda x: held[x].size)).count(longest, now.value, earlier.value)
        for lang in list(held):
            yield from held.pop(lang).count(longest, now.value, earlier.value)

    return docs.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def bit_filter(phrases: DataFrame, size: int = BITS) -> np.ndarray:
    """The filter that holds the given phrases: its bits are set by Spark, and of fixed size where they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                first, *others = [word_hash(x.encode(), lang) for x in phrase.split(" ")]
                got = np.array([first], np.uint64)
                for other in others:
                    got = longer_hash(got, np.array([other], np.uint64))
                hashes.append(got)
            if hashes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(marks(np.concatenate(hashes), size)).astype(np.int64))], names=["bit"])

    bits = phrases.select("lang", "phrase").mapInArrow(run, "bit long")
    rows = bits.groupBy((F.col("bit").bitwiseAND(F.lit(size - ROW)) / ROW).cast("int").alias("row")).agg(
        F.expr(f"bitmap_construct_agg(bit & {ROW - 1})").alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    for row in rows.toLocalIterator():  # at most size / ROW rows of 4 KB
        out[row.row * ROW // 8:(row.row + 1) * ROW // 8] = np.frombuffer(row.bits, np.uint8)
    return out


def frequent_phrases(docs: DataFrame, least: int = 10, longest: int = 3, fraction: float = 0.1, seed: int = 11,
                     lang: str = "lang", text: str = "text", block: int = BLOCK, bits: int = BITS) -> DataFrame:
    """(lang, phrase, n) of every phrase of 1..``longest`` words that occurs ``least`` times or more, and n of all words as "".

    ``fraction`` is the share of documents that propose phrases, at a threshold lowered to below their share of
    ``least``.  It, ``seed``, the words that a task counts at once and the filter's bits steer the work and leave results
    alone.
    """
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).cast("binary").alias("text"))
    lowered = max(2, int(fraction * least * 0.8))
    proposed = counted(texts.sample(fraction, seed), longest - 1, block=block).filter((F.col("n") >= lowered) & (F.col("phrase") != ""))
    known, before, out = bit_filter(proposed, bits), None, None
    while True:
        found = staged(counted(texts, longest, known, before, block).filter((F.col("n") >= least) | (F.col("phrase") == "")), "phrases")
        out = found if out is None else out.union(found)
        inner = found.filter((F.col("phrase") != "") & (F.size(F.split("phrase", " ")) < longest))
        wider = known | bit_filter(inner, bits)
        if (wider == known).all():  # no frequent phrase of the border is news
            return out
        known, before = wider, known


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, most: int = 2000, share: int = 50, fraction: float = 0.1,
                 block: int = BLOCK, bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language.

    Texts are cut into pieces at ``.,;:!?`` and line breaks, pieces into words at blanks and tabs, A-Z in lower case.
    Score: floor(10^6 * a^2 / (l * r)) of the cut with the lowest one (ties: the first), a, l and r the occurrences of the
    phrase and its two parts.  Phrases within a longer frequent one that makes up ``share`` percent of their occurrences or
    more are dropped.  Null language is ``und``; null and empty texts have no words; repeated rows count each; extra
    columns are left out; an empty table gives no rows.  Equal scores: more occurrences first, then byte order.
    """
    return ranked(staged(frequent_phrases(docs, least, longest, fraction, block=block, bits=bits), "frequent"), longest, most, share)


def ranked(found: DataFrame, longest: int, most: int, share: int) -> DataFrame:
    """The best phrases by language, from all frequent ones and their counts."""
    words = F.split("phrase", " ")
    total = found.filter(F.col("phrase") == "").select("lang", F.col("n").alias("total"))  # a row per language
    phrases = found.filter(F.col("phrase") != "").withColumn("words", words)
    candidates = phrases.filter(F.size("words") > 1).select("lang", "phrase", "words", F.col("n").alias("a"))
    cut = lambda start, length: F.concat_ws(" ", F.slice("words", start, length))
    size = F.size("words")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).select(
        "lang", "phrase", "a", "k", cut(F.lit(1), F.col("k")).alias("left"), cut(F.col("k") + 1, size - F.col("k")).alias("right"))
    part = phrases.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    cuts = (cuts.join(part.withColumnsRenamed({"part": "left", "f": "l"}), ["lang", "left"])
            .join(part.withColumnsRenamed({"part": "right", "f": "r"}), ["lang", "right"]))
    # 128-bit decimals: exact for counts below 10^15, which the casts check.
    wide = lambda name: f"cast({name} AS decimal(15, 0))"
    cuts = cuts.withColumn("score", F.expr(f"cast(1000000 AS decimal(7, 0)) * {wide('a')} * {wide('a')} div ({wide('l')} * {wide('r')})"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("b")).select("lang", "phrase", "a", "b.*")
    # Phrases within longer ones, of any length in between.
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(
        F.sequence(F.lit(1), size - m + 1), lambda i: F.concat_ws(" ", F.slice("words", i, m)))))
    within = candidates.filter(size > 2).select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer")).groupBy(
        "lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = best.join(within, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    top = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= most)
    return top.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
