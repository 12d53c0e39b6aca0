"""Rounding, clamping and safe division."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))


def ratio(top: Column, bottom: Column, empty: float | None = None) -> Column:
    """top / bottom, or ``empty`` where bottom is zero."""
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(empty).cast("double"))


def cents(value: Column) -> Column:
    """Money to cents, halves toward plus infinity.

    ``floor`` answers a bigint, which ends at 9.2e18; doubles from 2 ** 53 on are whole anyway.
    """
    moved = value * 100 + F.lit(0.5)
    return F.when(F.abs(moved) < F.lit(2.0**53), F.floor(moved).cast("double")).otherwise(moved) / F.lit(100.0)


def _exp(value: float) -> float:
    try:
        return math.exp(value)
    except OverflowError:
        return math.inf


@F.pandas_udf(T.DoubleType())
def c_log(value: pd.Series) -> pd.Series:
    """Natural logarithm of the C library, as SQL engines compute it; the JVM's may differ in the last digit."""
    return pd.Series([None if x != x else math.log(x) for x in value.astype("float64")], dtype="float64")


@F.pandas_udf(T.DoubleType())
def c_exp(value: pd.Series) -> pd.Series:
    """Exponential of the C library, infinite beyond the doubles."""
    return pd.Series([_exp(x) for x in value.astype("float64")], dtype="float64")


def fixed(value: Column, places: int = 2) -> Column:
    """Report rounding, halves away from zero."""
    return F.round(value, places)


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def sign_with_deadband(value: Column, deadband: float = 0.0) -> Column:
    """+1 above the band, -1 below it, 0 inside."""
    return (
        F.when(value > F.lit(float(deadband)), F.lit(1))
        .when(value < F.lit(-float(deadband)), F.lit(-1))
        .otherwise(F.lit(0))
    )


def guard(rows: DataFrame, ok: Column, message: Column) -> DataFrame:
    """``rows``, failing the job on the first row that isn't ok.

    The check is a filter, so it also runs where later steps read few columns or only count.  The row number in it keeps
    the optimizer from moving it below earlier joins and filters, where it would see rows that those leave out.
    """
    return rows.where(F.when(ok, F.monotonically_increasing_id() >= 0).otherwise(F.raise_error(message).cast("boolean")))


@F.arrow_udf(T.StringType())
def exact_text(value: pa.Array) -> pa.Array:
    """A double as text that names its bits: 53-bit whole mantissa, ``p``, negated power of two; zero of either sign is 0.

    Scaling by powers of two is exact, so equal texts mean equal numbers, whatever an engine's way to print doubles.
    Whole columns at a time: as one expression on several columns it passes the size that the JVM compiles.
    """
    known = pc.fill_null(value.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    if not np.isfinite(known).all():
        raise ValueError("not finite")
    part, power = np.frexp(known)
    mantissa = pa.array((part * 2.0**53).astype(np.int64)).cast(pa.string())
    text = pc.binary_join_element_wise(mantissa, pa.array(53 - power.astype(np.int64)).cast(pa.string()), "p")
    return pc.if_else(value.is_null(), pa.scalar(None, pa.string()), pc.if_else(pa.array(known == 0), "0", text))
