"""Numeric functions whose results differ from Spark's same-named ones, or that Spark lacks.

Domain errors follow IEEE arithmetic (inf and NaN) instead of NULL or an exception.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")
NAN = float("nan")


def ieee_divide(a: Column, b: Column) -> Column:
    """a / b in doubles; x/0 is signed infinity, 0/0 is NaN."""
    top, bottom = a.cast("double"), b.cast("double")
    return F.when(bottom == 0, top * INF).otherwise(F.try_divide(top, bottom))


def round_half_away(x: Column, digits: int) -> Column:
    """Round the scaled binary value, as SQL engines on doubles do; Spark's round works on its decimal text."""
    scale = 10.0**digits
    return F.round(x.cast("double") * scale) / scale


def two_decimals(x: Column) -> Column:
    """printf('%.2f') of a 32-bit value as C does it: exact ties go to the even digit (Java rounds them up)."""
    return F.format_string("%.2f", F.bround(x.cast("float").cast("double"), 2))


def ieee_log(x: Column, log=F.ln) -> Column:
    value = x.cast("double")
    return F.when(value > 0, log(value)).when(value == 0, -INF).when(value.isNotNull(), NAN)


def ieee_power(x: Column, y: Column) -> Column:
    return F.pow(x.cast("double"), y.cast("double"))


def floored_quotient(a: Column, b: Column) -> Column:
    return _floor_double(ieee_divide(a, b))


def floored_remainder(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor."""
    top, bottom = a.cast("double"), b.cast("double")
    return F.when(bottom == 0, NAN).otherwise(top - bottom * floored_quotient(top, bottom))


def toward_zero(x: Column) -> Column:
    value = x.cast("double")
    return F.when(value < 0, -_floor_double(-value)).otherwise(_floor_double(value))


def next_even(x: Column) -> Column:
    """Round away from zero to the next even number."""
    value = x.cast("double")
    up = -_floor_double(-F.abs(value) / 2) * 2
    return F.when(value < 0, -up).otherwise(up)


def is_finite(x: Column) -> Column:
    value = x.cast("double")
    return ~(F.isnan(value) | (F.abs(value) == INF))


def is_infinite(x: Column) -> Column:
    return F.abs(x.cast("double")) == INF


def is_negative(x: Column) -> Column:
    return x.cast("double") < 0


def _floor_double(x: Column) -> Column:
    # floor() of a double is a long in Spark; keep values a long cannot hold.
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)


@F.pandas_udf(T.LongType())
def gcd(a: pd.Series, b: pd.Series) -> pd.Series:
    return _integers(np.gcd, a, b)


@F.pandas_udf(T.LongType())
def lcm(a: pd.Series, b: pd.Series) -> pd.Series:
    return _integers(np.lcm, a, b)


@F.pandas_udf(T.DoubleType())
def gamma(x: pd.Series) -> pd.Series:
    return pd.Series(_gamma(x.to_numpy("float64", na_value=NAN)), index=x.index).where(x.notna())


@F.pandas_udf(T.DoubleType())
def lgamma(x: pd.Series) -> pd.Series:
    return pd.Series(_lgamma(x.to_numpy("float64", na_value=NAN)), index=x.index).where(x.notna())


@F.pandas_udf(T.DoubleType())
def nextafter(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series(np.nextafter(x.to_numpy("float64"), y.to_numpy("float64")))


def _integers(ufunc, a: pd.Series, b: pd.Series) -> pd.Series:
    known = a.notna() & b.notna()
    out = pd.Series(pd.NA, index=a.index, dtype="Int64")
    out[known] = ufunc(a[known].to_numpy("int64"), b[known].to_numpy("int64"))
    return out


# Coefficients of the Lanczos series for g = 7.
_LANCZOS_G = 7.0
_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905,
    -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def _series(x: np.ndarray) -> np.ndarray:
    """The Lanczos series at x - 1, for x of at least one half."""
    return _LANCZOS[0] + sum(c / (x - 1 + k) for k, c in enumerate(_LANCZOS) if k)


def _gamma(x: np.ndarray) -> np.ndarray:
    """Gamma: infinite at 0 and past the largest double, NaN at negative whole numbers and at -inf."""
    with np.errstate(all="ignore"):
        up = np.where(x < 0.5, 1 - x, x)
        t = up + _LANCZOS_G - 0.5
        # The power is taken in two halves, so that it overflows no sooner than the product.
        half = t ** ((up - 0.5) / 2)
        value = math.sqrt(2 * math.pi) * half * np.exp(-t) * half * _series(up)
        value = np.where(up > 171.7, INF, value)
        reflected = math.pi / (np.sin(math.pi * x) * value)
        out = np.where(x < 0.5, reflected, value)
        small = np.arange(1.0, 24.0)
        exact = np.cumprod(np.concatenate([[1.0], small[:-1]]))  # whole numbers, where doubles hold factorials exactly
        whole = (x == np.floor(x)) & (x >= 1) & (x <= 23)
        out[whole] = exact[x[whole].astype(int) - 1]
        out = np.where((x < 0) & (x == np.floor(x)), NAN, out)
        return np.where(x == 0, INF, np.where(x == INF, INF, out))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of gamma's magnitude: infinite at 0, at negative whole numbers and at both infinities."""
    with np.errstate(all="ignore"):
        up = np.where(x < 0.5, 1 - x, x)
        t = up + _LANCZOS_G - 0.5
        value = 0.5 * math.log(2 * math.pi) + (up - 0.5) * np.log(t) - t + np.log(_series(up))
        near = np.abs(up - 1) < 1e-9
        value = np.where(near | (up == 2), np.where(up == 2, 0.0, -0.5772156649015329 * (up - 1)), value)
        out = np.where(x < 0.5, np.log(np.abs(math.pi / np.sin(math.pi * x))) - value, value)
        pole = ((x <= 0) & (x == np.floor(x))) | np.isinf(x)
        return np.where(pole, INF, out)


# A prime modulus and multipliers that keep products of two of its residues within 63 bits.
_PRIME = 2**31 - 1
_ROUNDS = ((48271, 12345, 15), (39373, 907, 13), (62089911, 11, 16), (16807, 7, 11))


def seed_of(value: float) -> int:
    """A whole seed for a number from -1 to 1."""
    return int((value + 1) * 2**29)


def counter_random(key: Column, seed: int, stream: int = 1) -> Column:
    """A number from 0 up to 1 that depends on key, seed and stream only: multiplications and shifts of whole numbers.

    Equal keys draw equal numbers; NULL draws NULL.
    """
    whole = key.cast("long")
    start = (seed * 69621 + stream * 40692) % _PRIME
    state = (F.pmod(whole, F.lit(_PRIME)) + F.pmod(F.shiftright(whole, 31), F.lit(_PRIME)) * 3 + F.lit(start)) % _PRIME
    for factor, term, shift in _ROUNDS:
        state = (state.bitwiseXOR(F.shiftright(state, shift)) * F.lit(factor).cast("long") + F.lit(term)) % _PRIME
    return state.cast("double") / _PRIME
