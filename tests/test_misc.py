"""Writers, guards, registry rules, pluggable tokenizer, replica dedup."""

import os

import pytest
from pyspark.sql import functions as F

from actlake.config import GuardError, RunConfig, check_layers_in_data
from actlake.functions.codec import encode_activations
from actlake.operators import arch as A
from actlake.operators.compare import run_slice
from actlake.operators.demux import batch_metadata
from actlake.operators.verify import resolve_duplicates
from actlake.plans import extraction as X
from actlake.sinks import tables as K
from actlake.sources import fixtures as fx

from .conftest import SF


def test_plan_meta_and_marker_writers(spark, tmpdir_fresh):
    cfg = RunConfig(run_id="r1", layers=(16, 32), max_tokens=64, tp_size=4)
    pairs = spark.createDataFrame([(1, "hi", 0, "a b c")], "prompt_id long, prompt string, completion_idx int, completion string")
    K.write_plan(X.plan_rows(X.sequences(pairs, cfg)), os.path.join(tmpdir_fresh, "plan"))
    back = spark.read.json(os.path.join(tmpdir_fresh, "plan")).first()
    assert back.rid == "1|0" and back.n_tokens == 6  # "hi<|im_end|>" is one whitespace token
    K.write_run_rows(K.run_meta(spark, cfg, 1), os.path.join(tmpdir_fresh, "runs"))
    K.write_run_rows(X.run_summary(X.sequences(pairs, cfg), cfg, elapsed_s=2.0), os.path.join(tmpdir_fresh, "summary"))
    assert spark.read.json(os.path.join(tmpdir_fresh, "runs")).first().layers == [16, 32]
    s = spark.read.json(os.path.join(tmpdir_fresh, "summary")).first()
    assert s.total_tokens == 6 and s.tok_per_s == 3.0
    markers = K.replica_markers(fx.capture_batches(spark, SF), cfg, 64).collect()
    assert sorted(r.dp_rank for r in markers) == [0, 1] and markers[0].tp_size == 4


def test_write_by_replica(spark, tmpdir_fresh):
    rows = fx.replica_rows(spark, SF)
    K.write_by_replica(rows, os.path.join(tmpdir_fresh, "rep"))
    assert {"dp_rank=0", "dp_rank=1"} <= set(os.listdir(os.path.join(tmpdir_fresh, "rep")))


def test_layer_guard_on_data(spark):
    df = spark.createDataFrame([(16,), (40,)], "layer int")
    with pytest.raises(GuardError):
        check_layers_in_data(df, [16, 32])
    check_layers_in_data(df.where("layer = 16"), [16, 32])


def test_prompt_id_restriction(spark):
    v = fx.vectors(spark, SF)
    got = {r.prompt_id for r in run_slice(v, "base", 16, 0, prompt_ids=[2, 3]).select("prompt_id").collect()}
    assert got == {2, 3}


def test_registry_rules():
    reg = dict(A.ARCH_REGISTRY)
    A.register_arch("LlamaDecoderLayer", "tuple_sum", reg)  # same again: no-op
    with pytest.raises(GuardError):
        A.register_arch("LlamaDecoderLayer", "single", reg)
    with pytest.raises(GuardError):
        A.register_arch("NewLayer", "no_such_pattern", reg)
    A.register_arch("NewLayer", "single", reg)
    assert reg["NewLayer"] == "single" and "NewLayer" not in A.ARCH_REGISTRY
    assert A.layer_class_of_model("Phi3ForCausalLM") == "LlamaDecoderLayer"
    assert A.layer_class_of_model("Olmo3ForCausalLM") == "Olmo2DecoderLayer"
    with pytest.raises(GuardError):
        A.layer_class_of_model("GPT2LMHeadModel")


def test_unregistered_guard(spark):
    with pytest.raises(GuardError):
        A.require_registered(fx.arch_states(spark, SF))


def _wordlevel_factory():
    from tokenizers import Tokenizer, models, pre_tokenizers
    vocab = {"[UNK]": 0, "hello": 1, "world": 2}
    tok = Tokenizer(models.WordLevel(vocab=vocab, unk_token="[UNK]"))
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    return lambda texts: [e.ids for e in tok.encode_batch(texts)]


def test_pluggable_tokenizer(spark):
    cfg = RunConfig(max_tokens=3)
    pairs = spark.createDataFrame([(1, "hello", 0, "world world hello")],
                                  "prompt_id long, prompt string, completion_idx int, completion string")
    r = X.sequences(pairs, cfg, tokenizer=_wordlevel_factory).first()
    assert r.n_tokens == 3 and r.was_truncated and all(isinstance(i, int) for i in r.input_ids)


def test_resolve_duplicates_policies(spark):
    idx = spark.createDataFrame([(1, 0, 16, 0, 5, 1), (1, 0, 16, 5, 5, 2)],
                                "prompt_id long, completion_idx int, layer int, start long, n_tokens int, append_ord long")
    assert resolve_duplicates(idx, policy="first").first().start == 0
    assert resolve_duplicates(idx, policy="last").first().start == 5


def test_replicas_are_resolved_when_the_run_is_written(spark, tmpdir_fresh):
    """Two replicas captured even prompts' rollout 0; one copy of each token stays, the lower replica's."""
    rows = fx.replica_rows(spark, SF).withColumn("batch_id", F.lit(1).cast("long"))
    acts = encode_activations(rows, "bfloat16", d_model=64)
    K.write_activations(acts, os.path.join(tmpdir_fresh, "acts"), 64, 2, validate=False, dedup=True)
    back = spark.read.parquet(os.path.join(tmpdir_fresh, "acts"))
    keys = ["run_id", "layer", "prompt_id", "completion_idx", "token_pos"]
    assert back.count() == rows.select(*keys).distinct().count() < rows.count()
    assert back.where("prompt_id % 2 = 0 and dp_rank = 1").count() == 0
    K.check_unique_keys(back)
    with pytest.raises(GuardError):
        K.check_unique_keys(acts)


def test_batch_metadata_orders_sequences(spark):
    seqs = spark.createDataFrame([(0, 1, "b", 2, 0, 0, 0), (0, 0, "a", 3, 0, 0, 0), (1, 0, "c", None, 0, 1, 0)],
                                 "batch_id long, seq_ord int, rid string, seq_len int, prefix_len int, gpu_id long, global_rank long")
    m = {r.batch_id: r for r in batch_metadata(seqs).collect()}
    assert m[0].rids == ["a", "b"] and m[0].seq_lens == [3, 2] and m[1].seq_lens is None
