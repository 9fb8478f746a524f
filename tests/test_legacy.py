"""Legacy layout: byte-exact export, import back, duplicate keys, defaults."""

import json
import os

import numpy as np
from pyspark.sql import functions as F

from actlake.functions import codec as C
from actlake.functions.codec import decode_activations, encode_activations
from actlake.operators import layout as L
from actlake.sources.legacy import export_legacy, import_legacy
from actlake.sources.shards import read_index, read_manifest


def _acts(spark, dtype, seqs, d=8, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for pid, n in seqs:
        for t in range(n):
            rows.append(("shard_0000", 5, pid, 0, t, [float(x) for x in rng.standard_normal(d).astype(np.float32)]))
    df = spark.createDataFrame(rows, "shard string, layer int, prompt_id long, completion_idx int, "
                                     "token_pos int, vec array<float>")
    return df, rows


def test_export_is_byte_exact_and_imports_back(spark, tmpdir_fresh):
    for dtype in ("bfloat16", "float8_e4m3", "int8"):
        root = os.path.join(tmpdir_fresh, dtype)
        seqs = [(3, 4), (1, 2), (7, 5)]
        df, rows = _acts(spark, dtype, seqs)
        acts = encode_activations(df, dtype)
        lens = L.sequence_lengths(acts, ("shard", "layer", "prompt_id", "completion_idx"))
        order = {3: 0, 1: 1, 7: 2}  # append order
        lens = lens.withColumn("append_ord", F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
                               [F.col("prompt_id")].cast("long"))
        idx = L.index_offsets(lens, "append_ord", partition=("shard", "layer"))
        man = L.manifest(idx, "m", 8, dtype)
        export_legacy(acts, idx, man, root)
        # expected bytes, written sequentially in append order
        by_pid = {}
        for r in rows:
            by_pid.setdefault(r[2], []).append(r[5])
        flat = np.concatenate([np.array(by_pid[p], dtype=np.float32).ravel()
                               for p in sorted(by_pid, key=order.get)])
        lens_np = np.array([8] * (len(flat) // 8))
        data, scales = C.encode_np(flat, lens_np, dtype)
        got = open(os.path.join(root, "shard_0000", "acts_layer_005.bin"), "rb").read()
        assert got == data
        if dtype == "int8":
            sc = open(os.path.join(root, "shard_0000", "scales_layer_005.bin"), "rb").read()
            assert sc == scales.astype("<f4").tobytes()
        lines = [json.loads(x) for x in open(os.path.join(root, "shard_0000", "index.jsonl"))]
        assert [(x["prompt_id"], x["start"], x["n_tokens"]) for x in lines] == [(3, 0, 4), (1, 4, 2), (7, 6, 5)]
        meta = json.load(open(os.path.join(root, "shard_0000", "meta.json")))
        assert meta["dtype"] == dtype and meta["d_model"] == 8 and meta["total_tokens_per_layer"] == {"5": 11}
        back = decode_activations(import_legacy(spark, root)).collect()
        want = decode_activations(acts).collect()
        key = lambda r: (r.prompt_id, r.token_pos)
        assert [(key(r), list(r.vec)) for r in sorted(back, key=key)] == \
               [(key(r), list(r.vec)) for r in sorted(want, key=key)]


def test_duplicate_index_first_wins_and_meta_defaults(spark, tmpdir_fresh):
    root = os.path.join(tmpdir_fresh, "dup")
    sd = os.path.join(root, "shard_0000")
    os.makedirs(sd)
    d = 4
    v = np.arange(3 * d, dtype=np.float32)
    with open(os.path.join(sd, "acts_layer_002.bin"), "wb") as f:
        f.write(C.bf16_encode_np(v).astype("<u2").tobytes())
    with open(os.path.join(sd, "index.jsonl"), "w") as f:
        f.write(json.dumps({"prompt_id": 1, "completion_idx": 0, "layer": 2, "start": 0, "n_tokens": 1}) + "\n")
        f.write(json.dumps({"prompt_id": 1, "completion_idx": 0, "layer": 2, "start": 1, "n_tokens": 2}) + "\n")
    with open(os.path.join(sd, "meta.json"), "w") as f:
        json.dump({"model": "m", "layers": [2], "d_model": d}, f)  # no dtype: legacy default bf16
    man = read_manifest(spark, root).first()
    assert (man.dtype, man.bytes_per_elem, man.shard) == ("bfloat16", 2, "shard_0000")
    assert read_index(spark, root).count() == 2
    back = decode_activations(import_legacy(spark, root)).collect()
    assert len(back) == 1 and list(back[0].vec) == [0.0, 1.0, 2.0, 3.0]


def test_shard_discovery_fallback_and_error(spark, tmpdir_fresh):
    import pytest

    from actlake.config import GuardError
    from actlake.sources.legacy import import_legacy
    root = os.path.join(tmpdir_fresh, "single")
    os.makedirs(root)
    v = np.arange(8, dtype=np.float32)
    with open(os.path.join(root, "acts_layer_007.bin"), "wb") as f:
        f.write(C.fp8_encode_np(v).tobytes())
    with open(os.path.join(root, "index.jsonl"), "w") as f:
        f.write(json.dumps({"prompt_id": 9, "completion_idx": 1, "layer": 7, "start": 0, "n_tokens": 2}) + "\n")
    with open(os.path.join(root, "meta.json"), "w") as f:
        json.dump({"model": "m", "layers": [7], "d_model": 4, "dtype": "float8_e4m3", "bytes_per_elem": 1}, f)
    man = read_manifest(spark, root).first()  # the root itself is the shard
    assert (man.dtype, man.d_model, man.shard) == ("float8_e4m3", 4, "")
    rows = sorted(decode_activations(import_legacy(spark, root)).collect(), key=lambda r: r.token_pos)
    assert [(r.prompt_id, r.completion_idx, r.token_pos) for r in rows] == [(9, 1, 0), (9, 1, 1)]
    assert [list(r.vec) for r in rows] == [[0.0, 1.0, 2.0, 3.0], [4.0, 5.0, 6.0, 7.0]]
    empty = os.path.join(tmpdir_fresh, "empty")
    os.makedirs(empty)
    with pytest.raises(GuardError):
        read_manifest(spark, empty).collect()


def test_torn_tail_is_reported(spark, tmpdir_fresh):
    from actlake.sources.legacy import layer_file_report
    root = os.path.join(tmpdir_fresh, "torn")
    sd = os.path.join(root, "shard_0000")
    os.makedirs(sd)
    with open(os.path.join(sd, "acts_layer_003.bin"), "wb") as f:
        f.write(C.bf16_encode_np(np.arange(8, dtype=np.float32)).astype("<u2").tobytes() + b"\x01\x02\x03")
    with open(os.path.join(sd, "index.jsonl"), "w") as f:
        f.write(json.dumps({"prompt_id": 1, "completion_idx": 0, "layer": 3, "start": 0, "n_tokens": 2}) + "\n")
    with open(os.path.join(sd, "meta.json"), "w") as f:
        json.dump({"model": "m", "layers": [3], "d_model": 4}, f)
    r = layer_file_report(spark, root).first()
    assert (r.file_bytes, r.tokens_in_file, r.torn_bytes) == (19, 2, 3)
