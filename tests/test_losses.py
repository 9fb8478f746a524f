"""Nothing is lost without a word: readers, streams, legacy shards and comparisons fail or report."""

import glob
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from actlake.catalog.q_io import STREAM_CFG, capture_rows
from actlake.functions import codec as C
from actlake.functions.codec import encode_activations
from actlake.functions.quant import value_form
from actlake.operators import compare as CM
from actlake.operators.joins import parse_bytes
from actlake.operators.prompts import last_rollout
from actlake.sources.jsonl import read_completions
from actlake.sources.legacy import append_legacy, export_legacy, import_legacy, legacy_report
from actlake.operators import layout as L
from actlake.streaming.ingest import capture_stream, drain, start_ingest

from .conftest import SF

KEY = ("shard", "layer", "prompt_id", "completion_idx")


def test_a_limit_that_expires_raises(spark, tmpdir_fresh):
    src, out, ck = (os.path.join(tmpdir_fresh, n) for n in ("src", "out", "ck"))
    capture_rows(spark, SF).repartition(12).write.parquet(src)
    q = start_ingest(capture_stream(spark, src, max_files_per_trigger=1), STREAM_CFG, out, ck)
    with pytest.raises(TimeoutError):
        drain(q, 0.2)
    assert not q.isActive


def test_a_vector_of_another_length_fails_the_encoder(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id int, vec array<float>")
    with pytest.raises(Exception, match="elements instead of"):
        encode_activations(df, "bfloat16", d_model=2).collect()


def _shard(root, layers=(2, 3), tokens=10, d=4):
    sd = os.path.join(root, "shard_0000")
    os.makedirs(sd)
    for layer in layers:
        with open(os.path.join(sd, "acts_layer_%03d.bin" % layer), "wb") as f:
            f.write(C.bf16_encode_np(np.arange(tokens * d, dtype=np.float32)).astype("<u2").tobytes())
    with open(os.path.join(sd, "index.jsonl"), "w") as f:
        for layer in layers:
            for p, (start, n) in enumerate(((0, 4), (4, 6))):
                f.write(json.dumps({"prompt_id": p, "completion_idx": 0, "layer": layer, "start": start, "n_tokens": n}) + "\n")
    with open(os.path.join(sd, "meta.json"), "w") as f:
        json.dump({"model": "m", "layers": list(layers), "d_model": d}, f)
    return sd


@pytest.mark.parametrize("damage", ["absent", "torn", "past_end", "uncovered", "unlisted"])
def test_legacy_damage_is_an_error_and_reported(spark, tmpdir_fresh, damage):
    root = os.path.join(tmpdir_fresh, damage)
    sd = _shard(root)
    f = os.path.join(sd, "acts_layer_003.bin")
    data = open(f, "rb").read()
    left = 20
    if damage == "absent":
        os.remove(f)
        left = 10
    elif damage == "torn":
        open(f, "wb").write(data + b"x")
    elif damage == "past_end":
        open(f, "wb").write(data[:5 * 8])
        left = 14
    elif damage == "uncovered":
        open(f, "wb").write(data + data[:8])
    else:
        meta = json.load(open(os.path.join(sd, "meta.json")))
        json.dump(meta | {"layers": [2]}, open(os.path.join(sd, "meta.json"), "w"))
        left = 10
    assert {(r.layer, r.status) for r in legacy_report(spark, root).collect()} == {(2, "ok"), (3, damage)}
    with pytest.raises(Exception, match="do not agree"):
        import_legacy(spark, root)
    assert import_legacy(spark, root, strict=False).count() == left


def _acts(spark, prompts, dtype="int8"):
    rows = [("shard_0000", 5, p, 0, t, [float(p + t)] * 8) for p in prompts for t in range(3)]
    df = spark.createDataFrame(rows, "shard string, layer int, prompt_id long, completion_idx int, token_pos int, vec array<float>")
    return encode_activations(df, dtype)


def test_append_keeps_what_is_there(spark, tmpdir_fresh):
    root = os.path.join(tmpdir_fresh, "append")
    first = _acts(spark, [4, 2])
    idx = L.index_offsets(L.sequence_lengths(first, KEY).withColumn("append_ord", F.struct("prompt_id")), "append_ord", partition=("shard", "layer"))
    man = L.manifest(idx, "m", 8, "int8")
    export_legacy(first, idx, man, root)
    with pytest.raises(Exception, match="exists"):
        export_legacy(first, idx, man, root)
    assert import_legacy(spark, root).count() == 6
    append_legacy(_acts(spark, [3, 1]), root, "m", 8, "int8")
    lines = [json.loads(x) for x in open(os.path.join(root, "shard_0000", "index.jsonl"))]
    assert [(x["prompt_id"], x["start"]) for x in lines] == [(2, 0), (4, 3), (1, 6), (3, 9)]
    assert json.load(open(os.path.join(root, "shard_0000", "meta.json")))["total_tokens_per_layer"] == {"5": 12}
    assert os.path.getsize(os.path.join(root, "shard_0000", "scales_layer_005.bin")) == 48
    got = {(r.prompt_id, r.token_pos): round(r.vec[0], 1) for r in C.decode_activations(import_legacy(spark, root)).collect()}
    assert got == {(p, t): float(p + t) for p in (1, 2, 3, 4) for t in range(3)}
    assert not glob.glob(os.path.join(root, "**", "_*"), recursive=True)
    again = _acts(spark, [1])
    append_legacy(again, root, "m", 8, "int8")
    assert import_legacy(spark, root).count() == import_legacy(spark, root, policy="last").count() == 12


@pytest.mark.parametrize("form", ["plain", "uri", "glob", "folder", "space"])
def test_file_order_is_known_for_every_way_to_name_a_file(spark, tmpdir_fresh, form):
    a, b = os.path.join(tmpdir_fresh, "x y" if form == "space" else "x"), os.path.join(tmpdir_fresh, "y")
    for folder, text in ((a, "old"), (b, "new")):
        os.makedirs(folder)
        with open(os.path.join(folder, "c 1.jsonl" if form == "space" else "c.jsonl"), "w") as f:
            for i in range(3):
                f.write(json.dumps({"prompt_id": 1, "completion_idx": 0, "text": f"{text}{i}"}) + "\n")
    name = {"plain": lambda d: os.path.join(d, "c.jsonl"), "uri": lambda d: "file://" + os.path.join(d, "c.jsonl"),
            "glob": lambda d: os.path.join(d, "*.jsonl"), "folder": lambda d: d, "space": lambda d: d}[form]
    for order, want in (((a, b), "new2"), ((b, a), "old2")):
        df = read_completions(spark, [name(d) for d in order])
        assert {r.src_ord for r in df.collect()} == {0, 1}
        assert last_rollout(df, 0).first().completion == want


def test_lines_of_a_split_file_keep_their_order(spark, tmpdir_fresh):
    path = os.path.join(tmpdir_fresh, "big.jsonl")
    with open(path, "w") as f:
        for i in range(20000):
            f.write(json.dumps({"prompt_id": i % 7, "completion_idx": 0, "text": f"{i:06d}" + "x" * 100}) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        df = read_completions(spark, [path])
        assert df.select("line_ord.split").distinct().count() > 5
        got = {r.prompt_id: int(r.completion[:6]) for r in last_rollout(df, 0).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {p: max(i for i in range(19990, 20000) if i % 7 == p) for p in range(7)}


def test_fp8_and_int8_are_those_of_the_bf16_value(spark):
    codes = np.arange(65536, dtype=np.uint16)
    x = C.bf16_decode_np(codes)
    ok = np.isfinite(x)
    near = np.nextafter(x[ok], np.float32(np.inf)).astype(np.float32)  # fp32 values that round back to the code
    back = C.bf16_encode_np(near) == codes[ok]
    lens = np.ones(int(back.sum()), np.int64)
    for dtype in ("float8_e4m3", "int8"):
        assert C.encode_np(near[back], lens, dtype)[0] == C.encode_np(x[ok][back], lens, dtype)[0]
    v = [[1.0039063, 17.031251, -0.3333333, 447.9], [1e-9, 2.0, 3.1415927, 464.2]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(v)], "id int, vec array<float>")
    for dtype in ("float8_e4m3", "int8"):
        native = {r.id: r.q for r in df.select("id", value_form("vec", dtype).alias("q")).collect()}
        stored = {r.id: r.vec for r in C.decode_activations(encode_activations(df, dtype)).collect()}
        assert str(native) == str(stored)


def test_repeated_token_keys_are_refused(spark):
    rows = [(16, 1, 0, t, [1.0, 2.0]) for t in (0, 1, 1)]
    a = spark.createDataFrame(rows, "layer int, prompt_id long, completion_idx int, token_pos int, vec array<float>")
    with pytest.raises(Exception, match="more than once"):
        CM.token_pairs(a, a).collect()


def test_equal_runs_leave_one_candidate_per_value(spark):
    rows = [(16, 1, 0, t, [float(i % 3) for i in range(40)]) for t in range(50)]
    a = spark.createDataFrame(rows, "layer int, prompt_id long, completion_idx int, token_pos int, vec array<float>").repartition(4)
    m = CM.pair_metrics(CM.token_pairs(a, a)).first()
    assert m.rel_median == 0.0 and m.n_tokens == 50
    from actlake.functions.vecops import rel_err_candidates
    p = CM.token_pairs(a, a).withColumn("_target", F.lit(0)).withColumn("_rank", F.lit(1).cast("long"))
    got = rel_err_candidates(p, list(CM.SEQ)).collect()
    assert {r.rel for r in got} == {0.0} and sum(r["_cnt"] for r in got) == 2000 and len(got) < 50


def test_byte_sizes_with_units():
    assert [parse_bytes(x) for x in ("10485760", "1m", "10MB", "-1", "2g", "512k", "7b")] == [
        10485760, 1 << 20, 10 << 20, -1, 2 << 30, 512 << 10, 7]
    with pytest.raises(ValueError):
        parse_bytes("ten")


def test_no_local_folder_on_a_cluster():
    from actlake.session import ensure_checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()
    with pytest.raises(RuntimeError, match="share"):
        ensure_checkpoint_dir(Session())
