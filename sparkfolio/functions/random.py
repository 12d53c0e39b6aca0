"""Counter-based uniform numbers: draw k depends on (seed, k) only.

The 32-bit generator advances its state by a constant, so any draw can be computed
alone.  Bootstraps therefore need no ordered stream and no state between tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import COUNTER_STEP

_MASK = 0xFFFFFFFF


def _mask(value: Column) -> Column:
    return value.bitwiseAND(F.lit(_MASK))


def _times32(left: Column, right: Column) -> Column:
    """Low 32 bits of a product, in 16-bit halves so that 64 bits never overflow."""
    low = left * right.bitwiseAND(F.lit(0xFFFF))
    high = (left * F.shiftrightunsigned(right, 16)).bitwiseAND(F.lit(0xFFFF))
    return _mask(low + F.shiftleft(high, 16))


def with_uniform(df: DataFrame, seed: Column, k: Column, name: str = "u") -> DataFrame:
    """Add a uniform double in [0, 1): draw ``k`` (from 0) of the stream ``seed``.

    The mixing steps are separate projections, so each is evaluated once and compiled small.
    """
    step = _mask(k.cast("bigint") + F.lit(1)) * F.lit(COUNTER_STEP)
    a, t = F.col("_a"), F.col("_t")
    mixed = _times32(a.bitwiseXOR(F.shiftrightunsigned(a, 15)), a.bitwiseOR(F.lit(1)))
    more = _times32(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61)))
    return (
        df.withColumn("_a", _mask(_mask(seed.cast("bigint")) + _mask(step)))
        .withColumn("_t", mixed)
        .withColumn("_t", t.bitwiseXOR(_mask(t + more)))
        .withColumn(name, t.bitwiseXOR(F.shiftrightunsigned(t, 14)) / F.lit(4294967296.0))
        .drop("_a", "_t")
    )


def with_draw(df: DataFrame, seed: Column, k: Column, n: Column, name: str = "pos") -> DataFrame:
    """Add a position drawn from 0 .. n-1.

    It is never null, which keeps the optimizer from copying the whole mixing expression into a
    null filter below a join on the position.
    """
    return with_uniform(df, seed, k, "_u").withColumn(name, F.coalesce(F.floor(F.col("_u") * n), F.lit(-1))).drop("_u")


def uniform_block(seed: int, first: int, count: int) -> np.ndarray:
    """Draws first .. first+count-1 of one stream as a numpy vector (used inside tasks)."""
    return uniform_at(seed, np.arange(first, first + count, dtype=np.uint64))


def uniform_at(seed: int, k: np.ndarray) -> np.ndarray:
    """Draws ``k`` (from 0) of one stream, an array of the same shape."""
    a = (np.uint64(seed) + (k.astype(np.uint64) + np.uint64(1)) * np.uint64(COUNTER_STEP)).astype(np.uint32)
    t = (a ^ (a >> np.uint32(15))) * (a | np.uint32(1))
    t = t ^ (t + (t ^ (t >> np.uint32(7))) * (t | np.uint32(61)))
    return (t ^ (t >> np.uint32(14))) / 4294967296.0
