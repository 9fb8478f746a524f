"""Byte forms of the storage codecs (V2, V4, V8, V9).

A stored token vector is one ``payload BINARY`` cell: little-endian bf16
(2 bytes per element), float8 e4m3fn codes (1 byte) or int8 codes (1 byte)
plus an fp32 ``scale`` column. Encoding and decoding run as Arrow-batched
numpy inside ``mapInArrow``: one vectorised pass over the contiguous value
buffer of a whole record batch, never a Python loop over rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..config import DTYPE_BYTES, bytes_per_elem

# Fixed values of the formats.
_FP8_MANT, _FP8_BIAS, _FP8_EMIN = 3, 7, -6
_FP8_NAN_ABOVE = 464.0
_FP8_NAN_CODE = 0x7F
_INT8_AMAX_FLOOR = np.float32(1e-8)


# --------------------------------------------------------------------------- numpy kernels

def bf16_encode_np(x: np.ndarray) -> np.ndarray:
    """fp32 -> bf16 bit patterns, round to nearest even; NaN stays a quiet NaN."""
    x = np.ascontiguousarray(x, dtype=np.float32)
    u = x.view(np.uint32)
    out = ((u + np.uint32(0x7FFF) + ((u >> np.uint32(16)) & np.uint32(1))) >> np.uint32(16)).astype(np.uint16)
    nan = np.isnan(x)
    if nan.any():
        out[nan] = ((u[nan] >> np.uint32(16)) | np.uint32(0x0040)).astype(np.uint16)
    return out


def bf16_decode_np(h: np.ndarray) -> np.ndarray:
    return (np.ascontiguousarray(h, dtype=np.uint16).astype(np.uint32) << np.uint32(16)).view(np.float32)


def _fp8_table() -> np.ndarray:
    c = np.arange(256, dtype=np.int64)
    sign = np.where(c >> 7, -1.0, 1.0)
    e = (c >> 3) & 0xF
    m = c & 0x7
    mag = np.where(e == 0, m * 2.0 ** (_FP8_EMIN - _FP8_MANT),
                   (1.0 + m / 8.0) * np.exp2(e.astype(np.float64) - _FP8_BIAS))
    val = sign * mag
    val[(e == 0xF) & (m == 0x7)] = np.nan
    return val.astype(np.float32)


FP8_DECODE = _fp8_table()


def fp8_encode_np(x: np.ndarray) -> np.ndarray:
    """fp32 -> float8 e4m3fn codes, nearest even, |x| > 464 -> NaN (no saturation)."""
    x = np.ascontiguousarray(x, dtype=np.float32)
    a = np.abs(x.astype(np.float64))
    sign = np.signbit(x).astype(np.uint8) << np.uint8(7)
    bad = np.isnan(a) | (a > _FP8_NAN_ABOVE)
    a = np.where(bad, 0.0, a)
    _, ex = np.frexp(a)                      # a = f * 2^ex, f in [0.5, 1)
    e = np.maximum(ex - 1, _FP8_EMIN)
    step = np.ldexp(1.0, e - _FP8_MANT)
    q = np.rint(a / step) * step             # quantised magnitude
    fq, eq = np.frexp(q)
    normal = q >= 2.0 ** _FP8_EMIN
    E = eq - 1
    mant_n = np.where(normal, q / np.ldexp(1.0, np.where(normal, E, 0)) * 8.0 - 8.0, 0.0)
    code_n = ((E + _FP8_BIAS).clip(0, 15).astype(np.uint8) << np.uint8(3)) | mant_n.astype(np.uint8)
    code_s = (q / 2.0 ** (_FP8_EMIN - _FP8_MANT)).astype(np.uint8)
    code = np.where(normal, code_n, code_s).astype(np.uint8)
    code = np.where(bad, np.uint8(_FP8_NAN_CODE), code)
    return code | sign


def fp8_decode_np(c: np.ndarray) -> np.ndarray:
    return FP8_DECODE[np.ascontiguousarray(c, dtype=np.uint8)]


def int8_encode_np(flat: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per-row scale max(amax|x|, 1e-8)/127 (fp32) and codes clamp(rint(x/scale))."""
    flat = np.ascontiguousarray(flat, dtype=np.float32)
    lens = np.asarray(lens, dtype=np.int64)
    scales = np.full(len(lens), _INT8_AMAX_FLOOR / np.float32(127.0), dtype=np.float32)
    nz = lens > 0
    if flat.size:
        starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
        amax = np.maximum.reduceat(np.abs(flat), starts[nz]) if nz.any() else np.empty(0, np.float32)
        scales[nz] = np.maximum(amax, _INT8_AMAX_FLOOR).astype(np.float32) / np.float32(127.0)
    per = np.repeat(scales, lens)
    with np.errstate(invalid="ignore", divide="ignore"):
        q = np.rint(flat / per)
    q = np.where(np.isnan(q), 0.0, np.clip(q, -128, 127)).astype(np.int8)
    return q, scales


def int8_decode_np(codes: np.ndarray, lens: np.ndarray, scales: np.ndarray) -> np.ndarray:
    per = np.repeat(np.asarray(scales, dtype=np.float32), np.asarray(lens, dtype=np.int64))
    return codes.astype(np.float32) * per


# float8 code of every bf16 code: a captured value is bf16 before it is quantised further.
with np.errstate(invalid="ignore"):  # the NaN codes
    FP8_OF_BF16 = fp8_encode_np(bf16_decode_np(np.arange(65536, dtype=np.uint16)))


def encode_np(flat: np.ndarray, lens: np.ndarray, dtype: str):
    """V8: generic encode of a flat fp32 buffer; returns (bytes, scales or None).
    The fp8 and int8 forms are taken from the bf16 value."""
    staged = bf16_encode_np(flat)
    if dtype == "bfloat16":
        return staged.astype("<u2").tobytes(), None
    if dtype == "float8_e4m3":
        return FP8_OF_BF16[staged].tobytes(), None
    if dtype == "int8":
        q, s = int8_encode_np(bf16_decode_np(staged), lens)
        return q.tobytes(), s
    raise ValueError(f"unknown dtype {dtype}")


def decode_np(raw: np.ndarray, lens: np.ndarray, dtype: str, scales=None) -> np.ndarray:
    """V9: generic decode of a flat byte buffer to fp32."""
    if dtype == "bfloat16":
        return bf16_decode_np(raw.view("<u2"))
    if dtype == "float8_e4m3":
        return fp8_decode_np(raw)
    if dtype == "int8":
        return int8_decode_np(raw.view(np.int8), lens, scales)
    raise ValueError(f"unknown dtype {dtype}")


# --------------------------------------------------------------------------- Arrow helpers

def _list_parts(arr: pa.Array):
    """(flat float32 values, per-row lengths, validity mask) of a list<float> array."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    offs = np.asarray(arr.offsets, dtype=np.int64)
    values = arr.values.slice(offs[0], offs[-1] - offs[0])
    flat = values.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    lens = np.diff(offs)
    valid = np.asarray(arr.is_valid(), dtype=bool)
    return flat, lens, valid


def _binary_parts(arr: pa.Array):
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    large = pa.types.is_large_binary(arr.type)
    bufs = arr.buffers()
    odt = np.int64 if large else np.int32
    offs = np.frombuffer(bufs[1], dtype=odt)[arr.offset: arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.empty(0, np.uint8)
    raw = data[offs[0]:offs[-1]]
    valid = np.asarray(arr.is_valid(), dtype=bool)
    return raw, np.diff(offs), valid


def _mask(valid: np.ndarray):
    return None if valid.all() else pa.array(~valid)


def _binary_array(data: bytes, lens: np.ndarray, valid: np.ndarray) -> pa.Array:
    offs = np.zeros(len(lens) + 1, dtype=np.int32)
    np.cumsum(lens, out=offs[1:])
    arr = pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(offs), pa.py_buffer(data)])
    if not valid.all():
        arr = pa.compute.if_else(pa.array(valid), arr, pa.scalar(None, pa.binary()))
    return arr


def _float_list_array(flat: np.ndarray, lens: np.ndarray, valid: np.ndarray) -> pa.Array:
    offs = np.zeros(len(lens) + 1, dtype=np.int32)
    np.cumsum(lens, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(flat, pa.float32()),
                                    mask=_mask(valid))


def decode_batch(payload: pa.Array, dtypes: pa.Array, scales: pa.Array):
    """Decode one Arrow batch of payloads: (flat fp32 values, per-row lengths, validity).

    Rows may mix dtypes; each dtype present is decoded in one vectorised call
    over the bytes of its rows (gathered with an element mask when interleaved).
    """
    import pyarrow.compute as pc
    raw, nbytes, valid = _binary_parts(payload)
    enc = pc.dictionary_encode(dtypes.combine_chunks() if isinstance(dtypes, pa.ChunkedArray) else dtypes)
    names = enc.dictionary.to_pylist()
    codes = enc.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    table = np.array([DTYPE_BYTES.get(n, 0) for n in names] + [0], dtype=np.int64)
    bpe = table[codes]  # code -1 (null dtype) -> 0
    if (valid & (bpe == 0)).any():
        bad = names[codes[valid & (bpe == 0)][0]] if (codes[valid & (bpe == 0)] >= 0).any() else None
        raise ValueError(f"unknown dtype {bad!r}")
    sc = scales.to_numpy(zero_copy_only=False).astype(np.float32)
    nbytes = np.where(valid, nbytes, 0)
    if ((nbytes % np.maximum(bpe, 1)) != 0).any():
        raise ValueError("payload length is not a whole number of elements")
    lens = nbytes // np.maximum(bpe, 1)
    out = np.empty(int(lens.sum()), dtype=np.float32)
    for code, name in enumerate(names):
        rows = valid & (codes == code)
        if not rows.any():
            continue
        if rows.all():
            out[:] = decode_np(raw, lens, name, sc)
            continue
        bmask = np.repeat(rows, nbytes)
        emask = np.repeat(rows, lens)
        out[emask] = decode_np(np.ascontiguousarray(raw[bmask]), lens[rows], name, sc[rows])
    return out, lens, valid


# --------------------------------------------------------------------------- Spark jobs

def encode_activations(df: DataFrame, dtype: str, vec_col: str = "vec",
                       keep_vec: bool = False, d_model: int | None = None) -> DataFrame:
    """V8 as a job: ``vec ARRAY<FLOAT>`` -> ``dtype, payload BINARY, scale FLOAT``.
    With ``d_model`` a null vector or one of another length fails the job (P13, where the rows are)."""
    bytes_per_elem(dtype)
    keep = [f for f in df.schema.fields if keep_vec or f.name != vec_col]
    keep = [f for f in keep if f.name not in ("dtype", "payload", "scale")]
    out_schema = T.StructType(keep + [
        T.StructField("dtype", T.StringType(), False),
        T.StructField("payload", T.BinaryType(), True),
        T.StructField("scale", T.FloatType(), True),
    ])
    keep_names = [f.name for f in keep]

    def fn(batches):
        for rb in batches:
            flat, lens, valid = _list_parts(rb.column(vec_col))
            lens = np.where(valid, lens, 0)
            if d_model is not None and (lens != d_model).any():
                raise ValueError(f"a vector has {int(lens[lens != d_model][0])} elements instead of {d_model}")
            data, scales = encode_np(flat, lens, dtype)
            bpe = DTYPE_BYTES[dtype]
            cols = [rb.column(n) for n in keep_names]
            cols.append(pa.array([dtype] * rb.num_rows, pa.string()))
            cols.append(_binary_array(data, lens * bpe, valid))
            cols.append(pa.array(scales, pa.float32(), mask=~valid) if scales is not None
                        else pa.nulls(rb.num_rows, pa.float32()))
            yield pa.RecordBatch.from_arrays(cols, names=keep_names + ["dtype", "payload", "scale"])

    return df.mapInArrow(fn, out_schema)


def decode_activations(df: DataFrame, out_col: str = "vec", drop_payload: bool = True) -> DataFrame:
    """V9 as a job: ``dtype, payload, scale`` -> ``vec ARRAY<FLOAT>``; mixed dtypes allowed."""
    drop = {"payload", "scale"} if drop_payload else set()
    keep = [f for f in df.schema.fields if f.name not in drop and f.name != out_col]
    out_schema = T.StructType(keep + [T.StructField(out_col, T.ArrayType(T.FloatType(), True), True)])
    keep_names = [f.name for f in keep]

    def fn(batches):
        for rb in batches:
            out, lens, valid = decode_batch(rb.column("payload"), rb.column("dtype"), rb.column("scale"))
            cols = [rb.column(n) for n in keep_names]
            cols.append(_float_list_array(out, lens, valid))
            yield pa.RecordBatch.from_arrays(cols, names=keep_names + [out_col])

    return df.mapInArrow(fn, out_schema)

