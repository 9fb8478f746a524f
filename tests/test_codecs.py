"""Codec tests: every bf16 pattern, every fp8 code, ties, limits, int8 rules."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from actlake.functions import codec as C


def test_bf16_all_patterns_roundtrip():
    h = np.arange(65536, dtype=np.uint32).astype(np.uint16)
    x = C.bf16_decode_np(h)
    back = C.bf16_encode_np(x)
    nan = np.isnan(x)
    assert np.array_equal(back[~nan], h[~nan])
    assert np.isnan(C.bf16_decode_np(back[nan])).all()


def test_bf16_round_half_even():
    one = np.float32(1.0).view(np.uint32)
    # halfway between 1.0 (even) and next bf16: rounds down; between next (odd) and the one after: up
    mid_even = np.array([one + 0x8000], dtype=np.uint32).view(np.float32)
    mid_odd = np.array([one + 0x18000], dtype=np.uint32).view(np.float32)
    assert C.bf16_encode_np(mid_even)[0] == 0x3F80
    assert C.bf16_encode_np(mid_odd)[0] == 0x3F82
    big = np.array([np.finfo(np.float32).max], dtype=np.float32)
    assert np.isinf(C.bf16_decode_np(C.bf16_encode_np(big))[0])


def test_fp8_all_codes_roundtrip():
    codes = np.arange(256, dtype=np.uint8)
    x = C.fp8_decode_np(codes)
    back = C.fp8_encode_np(x)
    nan = np.isnan(x)
    assert nan.sum() == 2  # 0x7f and 0xff
    assert np.array_equal(back[~nan], codes[~nan])


def test_fp8_midpoints_round_to_even():
    vals = C.fp8_decode_np(np.arange(0, 0x7F, dtype=np.uint8)).astype(np.float64)  # positive finite, ascending
    assert np.all(np.diff(vals) > 0)
    for k in range(len(vals) - 1):
        mid = np.float32((vals[k] + vals[k + 1]) / 2)
        if float(mid) != (vals[k] + vals[k + 1]) / 2:
            continue  # not exactly representable in fp32
        code = int(C.fp8_encode_np(np.array([mid]))[0])
        expect = k if k % 2 == 0 else k + 1
        assert code == expect, (k, mid, code)


@pytest.mark.parametrize("x,expect", [
    (448.0, 448.0), (460.0, 448.0), (464.0, 448.0), (464.01, np.nan), (1e6, np.nan), (np.inf, np.nan),
    (2.0 ** -9, 2.0 ** -9), (2.0 ** -10, 0.0), (3 * 2.0 ** -10, 2.0 ** -8), (-0.0, -0.0), (np.nan, np.nan),
])
def test_fp8_limits(x, expect):
    got = C.fp8_decode_np(C.fp8_encode_np(np.array([x], dtype=np.float32)))[0]
    if np.isnan(expect):
        assert np.isnan(got)
    else:
        assert got == expect and np.signbit(got) == np.signbit(np.float32(expect))


def test_int8_rules():
    flat = np.array([0, 0, 0, 1.0, -2.0, 0.5, 127.0, 63.5, -64.5], dtype=np.float32)
    lens = np.array([3, 3, 3])
    q, s = C.int8_encode_np(flat, lens)
    assert s[0] == np.float32(np.float32(1e-8) / np.float32(127))
    assert list(q[:3]) == [0, 0, 0]
    assert q[4] == -127  # amax maps to -127
    assert list(q[6:]) == [127, 64, -64]  # half-way ties go to even
    back = C.int8_decode_np(q, lens, s)
    assert np.allclose(back[6:], [127.0, 64.0, -64.0])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, width=32), min_size=1, max_size=64))
def test_bf16_error_bound(xs):
    x = np.array(xs, dtype=np.float32)
    y = C.bf16_decode_np(C.bf16_encode_np(x))
    normal = np.abs(x) >= np.finfo(np.float32).tiny
    fin = np.isfinite(y)
    rel = np.abs(y[normal & fin].astype(np.float64) - x[normal & fin]) / np.abs(x[normal & fin])
    assert (rel <= 2.0 ** -8).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(min_value=-1e4, max_value=1e4, allow_nan=False, allow_infinity=False, width=32, exclude_min=True, exclude_max=True), min_size=1, max_size=64))
def test_int8_error_bound(xs):
    x = np.array(xs, dtype=np.float32)
    q, s = C.int8_encode_np(x, np.array([len(x)]))
    y = C.int8_decode_np(q, np.array([len(x)]), s)
    assert (np.abs(y.astype(np.float64) - x) <= s[0] * 0.5 * (1 + 1e-5) + 1e-30).all()


def _random_vectors(n=300, d=64, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, d)).astype(np.float32) * np.exp2(rng.integers(-12, 10, (n, 1))).astype(np.float32)
    v[0, :5] = [0.0, -0.0, 448.0, 464.0, 470.0]
    v[1, :] = 0.0
    v[2, :3] = [2.0 ** -130, 3e38, -1e-45]
    return v


@pytest.mark.parametrize("dtype", ["bfloat16", "float8_e4m3", "int8"])
def test_spark_value_form_equals_byte_form(spark, dtype):
    """Native Catalyst value form == numpy byte codec, element for element."""
    from pyspark.sql import functions as F

    from actlake.functions.codec import decode_activations, encode_activations
    from actlake.functions.quant import value_form
    v = _random_vectors()
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id int, vec array<float>")
    native = df.select("id", value_form("vec", dtype).alias("q"))
    dec = decode_activations(encode_activations(df, dtype)).select("id", F.col("vec").alias("b"))
    rows = native.join(dec, "id").collect()
    assert len(rows) == len(v)
    for r in rows:
        a = np.array(r["q"], dtype=np.float32)
        b = np.array(r["b"], dtype=np.float32)
        assert np.array_equal(np.isnan(a), np.isnan(b)), r["id"]
        ok = ~np.isnan(a)
        assert np.array_equal(a[ok], b[ok]), (r["id"], a[ok][a[ok] != b[ok]][:3], b[ok][a[ok] != b[ok]][:3])


def test_decode_mixed_interleaved_dtypes(spark):
    from pyspark.sql import functions as F

    from actlake.functions.codec import decode_activations, encode_activations
    v = _random_vectors(n=60, d=8)
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id int, vec array<float>")
    parts = [encode_activations(df.where(F.col("id") % 3 == k), dt)
             for k, dt in enumerate(["bfloat16", "float8_e4m3", "int8"])]
    mixed = parts[0].unionByName(parts[1]).unionByName(parts[2]).repartition(1).sortWithinPartitions("id")
    got = {r.id: r.vec for r in decode_activations(mixed).collect()}
    for k, p in enumerate(parts):
        for r in decode_activations(p).collect():
            a, b = np.array(got[r.id], dtype=np.float32), np.array(r.vec, dtype=np.float32)
            assert np.array_equal(np.isnan(a), np.isnan(b)) and np.array_equal(a[~np.isnan(a)], b[~np.isnan(b)])


def test_int8_nan_element_same_codes_in_both_forms(spark):
    from actlake.functions.quant import int8_codes, int8_scale, int8_value
    v = [1.0, float("nan"), -2.0]
    q, s = C.int8_encode_np(np.array(v, dtype=np.float32), np.array([3]))
    assert list(q) == [0, 0, 0] and np.isnan(s[0])
    df = spark.createDataFrame([(v,)], "v array<float>")
    r = df.select(int8_codes("v", int8_scale("v")).alias("c"), int8_value("v").alias("x")).first()
    assert list(r.c) == [0, 0, 0] and all(np.isnan(r.x))
