"""Value forms of the storage codecs as native Catalyst expressions.

The value form is what a number becomes after an encode / decode round trip.
It is computed in DOUBLE from the binary exponent: for a format with ``m``
explicit mantissa bits and minimum normal exponent ``emin``, the spacing of
representable values around ``x`` is ``2^(max(floor(log2|x|), emin) - m)``,
and ``rint`` (round half to even) onto that grid is round-to-nearest-even.

* V1  bf16: m = 7, emin = -126; zero, NaN and infinities pass unchanged.
* V3  fp8 e4m3fn of the bf16 value: m = 3, emin = -6, no infinities, largest
      finite 448; |x| > 464 (the midpoint above 448) becomes NaN, no saturation.
* V5  int8 scale per token: max(amax|x|, 1e-8) / 127 in fp32, x the bf16 value.
* V6  int8 code: clamp(rint(x / scale), -128, 127) with fp32 division.
* V7  int8 dequantise: code * scale in fp32.

A captured vector is bf16 before it is stored in any form, so the fp8 and
int8 forms of a vector are those of its bf16 value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the formats.
BF16_MANT_BITS, BF16_EMIN = 7, -126
FP8_MANT_BITS, FP8_EMIN = 3, -6
FP8_MAX, FP8_NAN_ABOVE = 448.0, 464.0
INT8_MIN, INT8_MAX = -128, 127
INT8_AMAX_FLOOR = 1e-8


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _bind(value: Column, use) -> Column:
    """use(value) with the value computed once: a lambda over a one-element array.
    (A plain expression inside an element lambda is computed again for every element.)"""
    return F.transform(F.array(value), use)[0]


def _grid_round(X: Column, mant_bits: int, emin: int) -> Column:
    e = F.greatest(F.floor(F.log2(F.abs(X))), F.lit(emin))
    step = F.pow(F.lit(2.0), e - F.lit(mant_bits))
    return F.rint(X / step) * step


def bf16_value(x) -> Column:
    """V1: fp32 -> nearest-even bf16, returned as FLOAT."""
    x = _c(x)
    X = x.cast("double")
    special = (X == 0) | F.isnan(X) | (F.abs(X) == F.lit(float("inf")))
    return F.when(special, X).otherwise(_grid_round(X, BF16_MANT_BITS, BF16_EMIN)).cast("float")


def fp8_value(x) -> Column:
    """V3 rounding: a value -> nearest-even float8 e4m3fn, returned as FLOAT (``fp8_vec`` stages through bf16)."""
    x = _c(x)
    X = x.cast("double")
    return (F.when(F.isnan(X) | (F.abs(X) > F.lit(FP8_NAN_ABOVE)), F.lit(float("nan")))
            .when(X == 0, X)
            .otherwise(_grid_round(X, FP8_MANT_BITS, FP8_EMIN))).cast("float")


def bf16_vec(v) -> Column:
    return F.transform(_c(v), bf16_value)


def fp8_vec(v) -> Column:
    return F.transform(bf16_vec(v), fp8_value)


def _scale_of(staged: Column) -> Column:
    amax = F.array_max(F.transform(staged, lambda x: F.abs(x)))
    floored = F.greatest(amax, F.lit(INT8_AMAX_FLOOR).cast("float"))
    return (floored.cast("double") / F.lit(127.0)).cast("float")


def _code(x: Column, s: Column) -> Column:
    q = F.rint((x.cast("double") / s.cast("double")).cast("float").cast("double"))
    return F.when(F.isnan(q), F.lit(0)).otherwise(
        F.least(F.greatest(q, F.lit(float(INT8_MIN))), F.lit(float(INT8_MAX)))).cast("tinyint")


def int8_scale(v) -> Column:
    """V5: per-token scale max(amax|x|, 1e-8) / 127 of the bf16 values, as FLOAT."""
    return _scale_of(bf16_vec(v))


def int8_codes(v, scale) -> Column:
    """V6: clamp(rint(x / scale), -128, 127) as ARRAY<TINYINT>; a NaN quotient
    (NaN element or NaN scale) gives code 0, as in the byte form."""
    return _bind(_c(scale), lambda s: F.transform(bf16_vec(v), lambda x: _code(x, s)))


def int8_dequant(q, scale) -> Column:
    """V7: code * scale in fp32 as ARRAY<FLOAT>."""
    return _bind(_c(scale).cast("double"), lambda s: F.transform(_c(q), lambda c: (c.cast("double") * s).cast("float")))


def int8_value(v) -> Column:
    """V5 + V6 + V7: the int8 round trip of a token vector, linear in its length."""
    return _bind(bf16_vec(v), lambda w: _bind(_scale_of(w), lambda s: F.transform(
        w, lambda x: (_code(x, s).cast("double") * s.cast("double")).cast("float"))))


def value_form(v, dtype: str) -> Column:
    """The decoded vector a stored ``dtype`` payload would give back."""
    if dtype == "bfloat16":
        return bf16_vec(v)
    if dtype == "float8_e4m3":
        return fp8_vec(v)
    if dtype == "int8":
        return int8_value(v)
    raise ValueError(f"unknown dtype {dtype}")
