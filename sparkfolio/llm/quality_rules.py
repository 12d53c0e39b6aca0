"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

A rule rejects a document whose measure is above a cutoff.  Cutoffs are chosen per stratum (language) from labelled
holdout documents: among a fixed grid, the strictest cutoff is taken for which an exact binomial test shows that good
documents are rejected at a rate below the limit.  A cutoff with k of n good documents rejected passes when
P(Binomial(n, limit) <= k) is at most the error chance divided by the number of tests (Bonferroni over strata,
measures and cutoffs), which is the exact upper confidence bound being below the limit.  The limit of a stratum is
split over its measures.  A stratum with too few labelled documents gets no cutoff, and its documents are kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.llm.common import staged, words

#: Grids of cutoffs of each measure.
GRIDS: dict[str, tuple[float, ...]] = {
    "symbols": (0.01, 0.02, 0.03, 0.05, 0.07, 0.1, 0.15, 0.2, 0.3, 0.5),
    "dup_lines": (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.7),
    "repeat_words": (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.5),
    "long_words": (8.0, 9.0, 10.0, 12.0, 14.0, 16.0, 20.0, 30.0),
}
WINDOW = 8


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` names it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def repeated_words(tokens: Column) -> Column:
    """Words in windows of ``WINDOW`` words that occur twice or more in the text, the first included.

    Windows are compared by 64-bit hash.  Texts without a repeated window, nearly all, stop after a distinct count.
    """
    n = F.size(tokens)
    windows = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(tokens, i, WINDOW)))

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(p: Column) -> Column:
            last = F.size(p) - 1
            at = F.filter(F.sequence(F.lit(0), last), lambda j: (
                F.when(j > 0, p[F.greatest(j - 1, F.lit(0))].h == p[j].h).otherwise(F.lit(False))
                | F.when(j < last, p[F.least(j + 1, last)].h == p[j].h).otherwise(F.lit(False))))
            return F.array_sort(F.transform(at, lambda j: p[j].i))

        def length(s: Column) -> Column:
            end = F.size(s) - 1
            steps = F.transform(s, lambda x, j: F.when(j < end, F.least(s[F.least(j + 1, end)] - x, F.lit(WINDOW))).otherwise(WINDOW))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return let(pairs, lambda p: let(twice(p), length))

    return F.when(n < WINDOW + 1, 0).otherwise(
        let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w)))).cast("long")


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """(key, stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) per row, narrow.

    Null text: all 0.  Null stratum: the stratum ''.  Repeated and null keys keep their rows.
    """
    value = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(value, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return (
        docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"))
        .select("key", "stratum", F.regexp_count(value, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
                words(F.col("text")).alias("_words"), lines.alias("_lines"))
        .select("key", "stratum", F.size("_words").cast("long").alias("n_words"),
                F.length(F.array_join("_words", "")).cast("long").alias("word_chars"), "n_symbols",
                F.size("_lines").cast("long").alias("n_lines"),
                (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
                repeated_words(F.col("_words")).alias("n_repeat_words"))
        .withColumnRenamed("key", key)
    )


def ratio(top: str, bottom: str) -> Column:
    return F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(0.0)


def measures() -> dict[str, Column]:
    """The measure of each rule, from the columns of ``measure``."""
    return {"symbols": ratio("n_symbols", "word_chars"), "dup_lines": ratio("n_dup_lines", "n_lines"),
            "repeat_words": ratio("n_repeat_words", "n_words"), "long_words": ratio("word_chars", "n_words")}


def log_gamma(x: Column) -> Column:
    """ln gamma(x) for x >= 1: Stirling's series ten further, and the recurrence back."""
    y = x + 10
    back = F.lit(0.0)
    for i in range(10):
        back = back + F.log(x + i)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - back


def binomial_tail(k: Column, n: Column, chance: float) -> Column:
    """P(Binomial(n, chance) <= k) for k up to the mean, 1 beyond it (no cutoff with so many passes).

    Terms from k downwards fall faster than a geometric row; 12 standard deviations of them are summed.
    """
    k, n = k.cast("double"), n.cast("double")
    first = F.exp(log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * math.log(chance) + (n - k) * math.log1p(-chance))
    terms = F.least(k, F.ceil(12 * F.sqrt(n)) + 60).cast("long")
    start = F.struct(first.alias("term"), F.lit(0.0).alias("sum"), k.alias("i"))
    step = lambda s, _: F.struct((s.term * s.i * (1 - chance) / ((n - s.i + 1) * chance)).alias("term"), (s.sum + s.term).alias("sum"), (s.i - 1).alias("i"))
    total = F.aggregate(F.sequence(F.lit(0).cast("long"), terms), start, step, lambda s: s["sum"])
    return F.when(k > n * chance, 1.0).otherwise(total)


def cutoffs(measured: DataFrame, labels: DataFrame, key: str = "doc_id", good: str = "quality", limit: float = 0.04,
            error: float = 0.05) -> DataFrame:
    """(stratum, n_good, one cutoff per measure): the chosen cutoffs; null where none passes.

    ``labels``: key and 0/1.  A key with several labels is good when all say so; null labels and keys are left out.
    """
    share, values = limit / len(GRIDS), measures()
    marked = labels.filter(F.col(key).isNotNull() & F.col(good).isNotNull()).groupBy(F.col(key)).agg(F.min(good).alias("_good")).filter("_good = 1")
    counts = (
        measured.join(marked.select(key), key).groupBy("stratum")
        .agg(F.count("*").alias("n_good"), *[F.count(F.when(values[m] > c, 1)).alias(f"{m}_{i}") for m, grid in GRIDS.items() for i, c in enumerate(grid)])
    )
    # Over the table of strata, a row each.
    tests = counts.withColumn("_tests", F.count("*").over(Window.partitionBy(F.lit(0))) * sum(map(len, GRIDS.values())))
    picked = []
    for m, grid in GRIDS.items():
        passed = [F.when(binomial_tail(F.col(f"{m}_{i}"), F.col("n_good"), share) <= error / F.col("_tests"), c) for i, c in enumerate(grid)]
        picked.append(F.array_min(F.array(*passed)).alias(f"max_{m}"))
    return tests.select("stratum", "n_good", *picked)


def judge(measured: DataFrame, chosen: DataFrame, key: str = "doc_id") -> DataFrame:
    """``measured`` with base_failed, and kept: no base rule failed and no measure above its stratum's cutoff."""
    values = measures()
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rejected = F.lit(False)
    for m in GRIDS:
        rejected = rejected | F.coalesce(values[m] > F.col(f"max_{m}"), F.lit(False))
    return (measured.join(chosen.drop("n_good"), "stratum", "left").withColumn("base_failed", failed)
            .withColumn("kept", ~failed & ~rejected).drop(*[f"max_{m}" for m in GRIDS]))


def apply(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang",
          good: str = "quality", limit: float = 0.04, error: float = 0.05) -> DataFrame:
    """Measures every whole text once, chooses cutoffs over all labelled rows and judges every row.

    Columns as ``measure``, base_failed and kept.  Empty tables: no rows, or no cutoffs and so base rules only.
    """
    measured = staged(measure(docs, key, text, stratum), "measures")
    return judge(measured, staged(cutoffs(measured, labels, key, good, limit, error), "cutoffs"), key)
