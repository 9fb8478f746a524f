"""Queries that run whole jobs on files: readers, planning, ingest with shards, append, verify and compare of legacy roots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DTYPE_BYTES, RunConfig, check_layers_in_data, parse_layers
from ..functions import vec as V
from ..functions.codec import decode_activations, encode_activations
from ..operators import arch as A
from ..operators import compare as C
from ..operators import layout as L
from ..operators import prompts as P
from ..operators.verify import norm_health
from ..operators.windows import running_sums
from ..plans import extraction as X
from ..plans.jobs import compare_legacy_job, ingest_job, plan_job, verify_legacy_job
from ..session import qualified, scratch_path, stored
from ..sinks.jsonl_zstd import write_jsonl_zstd
from ..sinks.tables import write_by_replica
from ..sources import fixtures as fx
from ..sources.jsonl import read_completions, read_prompts
from ..sources.legacy import (append_legacy, commit_legacy, decide_legacy, export_legacy, import_legacy, read_legacy, recover_legacy,
                              stage_append, stream_legacy)
from ..sources.shards import read_directions, read_index
from ..operators.steer import parse_directions
from ..streaming.dedup import mark_run_end, start_dedup_ingest, state_rows
from ..streaming.ingest import capture_stream, drain, read_manifest_updates, start_ingest, start_manifest_updates
from ..streaming.report import drain_reported
from ..streaming.rotate import read_rotating_index, start_rotating_index
from . import sqlfrag as Sq
from .q_compare import _COS, _REL
from .q_io import _BATCHES, _SLICES, CAPTURE_LAYER, capture_rows
from .q_plan import _PLAN_SQL, PLAN_CFG
from .registry import query
from .views_sql import VIEWS, with_views

SHARD_BYTES = 8192
D = 64


def r6(c):
    return F.round(c, 6)


# --------------------------------------------------------------------------- files

def _prompt_files(spark, d) -> list[str]:
    root = scratch_path(spark, "prompt-files")
    raw = fx.prompts_clean(spark, d)
    for src, folder in ((0, "a"), (1, "b b")):
        raw.where(F.col("src_ord") == src).select(F.col("prompt_id").alias("id"), "prompt", F.lit(7).alias("extra")) \
            .write.json(f"{root}/{folder}")
    return [f"{root}/a", f"{root}/b b"]


def _completion_files(spark, d) -> list[str]:
    root = scratch_path(spark, "completion files")
    raw = fx.completions_raw(spark, d).select("prompt_id", "completion_idx", "text", "src_ord")
    raw.where("src_ord = 0").drop("src_ord").write.json(f"{root}/first")
    write_jsonl_zstd(raw.where("src_ord = 1").drop("src_ord"), f"{root}/second")
    return [f"{root}/first", f"{root}/second/*.zst"]


@query("prompt_files_merged", "S1 S3 T3 A1", with_views("SELECT prompt_id, prompt FROM prompts", "prompts"))
def q_prompt_files_merged(spark, d):
    """Prompt files written as JSON lines (one folder has a blank in its name), read back and merged."""
    return P.merge_prompts(read_prompts(spark, _prompt_files(spark, d)))


@query("rollout_files_last_wins", "S2 S3 A2 P10", with_views(
    "SELECT prompt_id, completion_idx, completion FROM last_rollouts", "last_rollouts"))
def q_rollout_files_last_wins(spark, d):
    """Completion files, a plain folder and a glob of zstandard files, read back; the last row in (file, line) order wins."""
    return P.last_rollout(read_completions(spark, _completion_files(spark, d)), 0)


_KEPT = f"SELECT * FROM plan_rows WHERE n_tokens >= {PLAN_CFG.min_tokens}"
_RENDER = """
    SELECT prompt_id, completion_idx, '<|im_start|>user' || chr(10) || prompt || '<|im_end|>' || chr(10)
      || '<|im_start|>assistant' || chr(10) || completion AS input_text FROM pairs"""
_JOB_PLAN = _PLAN_SQL.replace("FROM rendered", "FROM plain")


@query("plan_job_files", "S10 O1 P15 K2", with_views(
    f"SELECT rid, n_tokens, row_number() OVER (ORDER BY prompt_id, rid) AS line FROM ({_KEPT}) k", "pairs",
    extra=[("plain", _RENDER), ("plan_rows", _JOB_PLAN)]))
def q_plan_job_files(spark, d):
    """The plan written by the planning job from files, with each line's place in the files: prompt order (O1, K2)."""
    out = scratch_path(spark, "plan-job")
    plan_job(spark, _prompt_files(spark, d), _completion_files(spark, d), PLAN_CFG, out)
    back = spark.read.schema("rid string, n_tokens int").json(f"{out}/plan")
    place = F.struct(F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_block_start").alias("s"),
                     F.monotonically_increasing_id().alias("r"))
    x = running_sums(back.select("rid", "n_tokens", place.alias("place")), "place", {}, row_number_col="line")
    return x.select("rid", "n_tokens", F.col("line").cast("long").alias("line"))


@query("run_metadata", "K5 S10", with_views(
    f"""SELECT '{PLAN_CFG.run_id}' AS run_id, '{PLAN_CFG.model}' AS model, '16,32' AS layers, {PLAN_CFG.max_tokens} AS max_tokens,
          count(*) AS n_pairs, count(*) FILTER (WHERE was_truncated) AS n_truncated,
          CAST(coalesce(sum(n_tokens) FILTER (WHERE n_tokens >= {PLAN_CFG.min_tokens}), 0) AS BIGINT) AS total_tokens
        FROM plan_rows""", "pairs", extra=[("plain", _RENDER), ("plan_rows", _JOB_PLAN)]))
def q_run_metadata(spark, d):
    """The run's metadata row and summary row as the planning job wrote them (K5)."""
    out = scratch_path(spark, "plan-meta")
    plan_job(spark, _prompt_files(spark, d), _completion_files(spark, d), PLAN_CFG, out)
    meta = spark.read.schema("run_id string, model string, layers array<int>, max_tokens int").json(f"{out}/runs")
    summary = spark.read.schema("n_pairs long, n_truncated long, total_tokens long").json(f"{out}/summary")
    x = meta.withColumn("k", F.lit(1)).join(summary.withColumn("k", F.lit(1)), "k").drop("k")
    return x.withColumn("layers", F.array_join(F.col("layers").cast("array<string>"), ","))


def _byte_tokens():
    return lambda texts: [list(t.encode("utf-8")) for t in texts]


@query("plan_other_tokenizer", "U4 V23", with_views(
    f"""SELECT rid, CAST(least(n, {PLAN_CFG.max_tokens}) AS INT) AS n_tokens, n > {PLAN_CFG.max_tokens} AS was_truncated
        FROM (SELECT concat(CAST(prompt_id AS VARCHAR), '|', CAST(completion_idx AS VARCHAR)) AS rid, strlen(input_text) AS n FROM plain) q""",
    "pairs", extra=[("plain", _RENDER)]))
def q_plan_other_tokenizer(spark, d):
    """The plan with a pluggable tokenizer, one id per UTF-8 byte (U4)."""
    pairs = X.pairs(fx.prompts_clean(spark, d), fx.completions_raw(spark, d), PLAN_CFG)
    return X.sequences(pairs, PLAN_CFG, tokenizer=_byte_tokens).select("rid", "n_tokens", "was_truncated")


@query("direction_files", "S8 V26", with_views(
    f"""SELECT layer, round({Sq.norm('vec')}, 6) AS dir_norm FROM (
          SELECT CAST(regexp_extract(key, '^layer_([0-9]+)$', 1) AS INT) AS layer, arg_max(vec, key) AS vec
          FROM directions_raw WHERE regexp_extract(key, '^layer_([0-9]+)$', 1) <> '' GROUP BY 1) q""", "directions_raw"))
def q_direction_files(spark, d):
    """Steering directions written to a file, read back and parsed."""
    path = scratch_path(spark, "directions")
    fx.directions_raw(spark, d).write.parquet(path)
    x = parse_directions(read_directions(spark, path))
    return x.select("layer", r6(V.l2_norm("vec")).alias("dir_norm"))


# --------------------------------------------------------------------------- parameters and registries

@query("layers_checked", "P11 T5", with_views(
    "SELECT run_id, layer, count(*) AS n_rows FROM vectors GROUP BY run_id, layer", "vectors"))
def q_layers_checked(spark, d):
    """A layer list given with repeats, checked against the model's and the data's layers, selects the stored rows."""
    cfg = RunConfig(layers=parse_layers("32,16,32"), n_layers=48)
    v = fx.vectors(spark, d)
    check_layers_in_data(v, cfg.layers)
    return v.where(F.col("layer").isin(list(cfg.layers))).groupBy("run_id", "layer").agg(F.count(F.lit(1)).alias("n_rows"))


@query("dtype_sizes", "P12 V25", with_views(
    """SELECT dtype, CAST(sum(len(embedding) * bpe) AS BIGINT) AS payload_bytes, count(*) FILTER (WHERE dtype = 'int8') AS n_scales
       FROM embeddings CROSS JOIN (VALUES ('bfloat16', 2), ('float8_e4m3', 1), ('int8', 1)) s(dtype, bpe) GROUP BY dtype"""))
def q_dtype_sizes(spark, d):
    """Payload bytes and scales of all embeddings in each dtype of the table."""
    e = fx.table(spark, d, "embeddings").select(F.col("embedding").alias("vec"))
    enc = None
    for dt in DTYPE_BYTES:
        part = encode_activations(e, dt)
        enc = part if enc is None else enc.unionByName(part)
    return enc.groupBy("dtype").agg(F.sum(F.octet_length("payload")).cast("long").alias("payload_bytes"),
                                    F.count("scale").alias("n_scales"))


_MODELS = ["Olmo3ForCausalLM", "Phi3ForCausalLM", "InternLM3ForCausalLM", "Qwen3ForCausalLM", "MistralForCausalLM",
           "DeciLMForCausalLM", "LlamaDecoderLayer", "OtherForCausalLM"]
_MODEL_LAYERS = ["Olmo2DecoderLayer", "LlamaDecoderLayer", "LlamaDecoderLayer", "Qwen3DecoderLayer", "MistralDecoderLayer",
                 "DeciLMDecoderLayer", "LlamaDecoderLayer", None]


@query("model_aliases", "U5 U1", with_views(
    "SELECT layer_class, pattern, count(*) AS n FROM (SELECT [" + ", ".join(f"'{x}'" if x else "NULL" for x in _MODEL_LAYERS)
    + "][label % 8 + 1] AS layer_class FROM embeddings) q LEFT JOIN arch_patterns USING (layer_class) GROUP BY ALL", "arch_patterns"))
def q_model_aliases(spark, d):
    """Rows by the decoder-layer class and output pattern that their model class runs through."""
    names = F.array(*(F.lit(m) for m in _MODELS))
    x = fx.table(spark, d, "embeddings").select(F.element_at(names, (F.col("label") % 8 + 1).cast("int")).alias("model_class"))
    return A.attach_pattern(A.attach_layer_class(x)).groupBy("layer_class", "pattern").agg(F.count(F.lit(1)).alias("n"))


@query("run_slice_keys", "P14", with_views(
    "SELECT layer, prompt_id, token_pos FROM vectors WHERE run_id = 'base' AND layer = 32 AND prompt_id IN (1, 3, 8)", "vectors"))
def q_run_slice_keys(spark, d):
    """One run's rows at one layer for a list of prompts."""
    return C.run_slice(fx.vectors(spark, d), "base", layer=32, completion_idx=0, prompt_ids=[1, 3, 8]).select("layer", "prompt_id", "token_pos")


# --------------------------------------------------------------------------- ingest

_SEQS = """
    SELECT prompt_id, completion_idx, CAST(sum(seq_len) AS INT) AS n_tokens FROM slices WHERE seq_len > 0 GROUP BY 1, 2"""
_ROTATED = [
    ("batches", _BATCHES), ("slices", _SLICES), ("seqs", _SEQS),
    ("ord", f"SELECT *, n_tokens * {D * 2} AS n_bytes, row_number() OVER (ORDER BY prompt_id, completion_idx) AS i FROM seqs"),
    ("walk(i, shard, acc)", f"""
        SELECT i, 0, n_bytes FROM ord WHERE i = 1
        UNION ALL
        SELECT o.i, CASE WHEN w.acc >= {SHARD_BYTES} THEN w.shard + 1 ELSE w.shard END,
               CASE WHEN w.acc >= {SHARD_BYTES} THEN o.n_bytes ELSE w.acc + o.n_bytes END
        FROM walk w JOIN ord o ON o.i = w.i + 1"""),
]


def _capture_files(spark, d, twice: bool = False) -> str:
    src = scratch_path(spark, "capture")
    rows = capture_rows(spark, d)
    if twice:
        rows = rows.unionByName(rows.withColumn("gpu_id", F.col("gpu_id") + 8))
    rows.repartition(4).write.parquet(src)
    return src


@query("ingest_rotated", "K5 K6 K7 W1 R1", with_views(
    f"""SELECT printf('shard_%04d', w.shard) AS shard, {CAPTURE_LAYER} AS layer, o.prompt_id, o.completion_idx, o.n_tokens,
          CAST(coalesce(sum(o.n_tokens) OVER (PARTITION BY w.shard ORDER BY o.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
        FROM ord o JOIN walk w ON o.i = w.i""", "capture_seqs", extra=_ROTATED, recursive=True))
def q_ingest_rotated(spark, d):
    """The index of a batch ingest whose shards rotate at 8 KiB."""
    out = scratch_path(spark, "ingest")
    cfg = RunConfig(run_id="rotated", layers=(CAPTURE_LAYER,), tp_size=1, shard_bytes=SHARD_BYTES)
    ingest_job(spark, _capture_files(spark, d), cfg, out, D)
    return spark.read.parquet(f"{out}/index/run_id=rotated").select("shard", "layer", "prompt_id", "completion_idx", "n_tokens", "start")


_SLICES_DP = _SLICES.replace("SELECT s.batch_id,", "SELECT s.batch_id, s.gpu_id,")


@query("ingest_replicas", "K8 R7 R1 R3", with_views(
    f"""SELECT printf('shard_dp%02d', dp) AS shard, {CAPTURE_LAYER} AS layer, prompt_id, completion_idx, CAST(sum(seq_len) AS INT) AS n_tokens
        FROM (SELECT CAST(gpu_id AS INT) AS dp, prompt_id, completion_idx, seq_len FROM slices WHERE seq_len > 0
              UNION ALL SELECT CAST(gpu_id + 8 AS INT), prompt_id, completion_idx, seq_len FROM slices WHERE seq_len > 0 AND prompt_id < 0) q
        GROUP BY ALL""", "capture_seqs", extra=[("batches", _BATCHES), ("slices", _SLICES_DP)]))
def q_ingest_replicas(spark, d):
    """A streamed ingest of batches that two replicas captured: one shard per replica, each token stored once; rows without a
    parsed request id all stay (K8, R7)."""
    out = scratch_path(spark, "ingest")
    cfg = RunConfig(run_id="replicas", layers=(CAPTURE_LAYER,), tp_size=1)
    ingest_job(spark, _capture_files(spark, d, twice=True), cfg, out, D, stream=True, checkpoint=scratch_path(spark, "ingest-ck"),
               max_files_per_trigger=2, sharding="replica")
    return spark.read.parquet(f"{out}/index/run_id=replicas").select("shard", "layer", "prompt_id", "completion_idx", "n_tokens")


@query("stream_dedup", "R7 R1 R6", with_views(
    """SELECT prompt_id, completion_idx, CAST(sum(CASE WHEN prompt_id < 0 THEN 2 ELSE 1 END * seq_len) AS BIGINT) AS n_tokens,
          CAST(0 AS BIGINT) AS state_rows FROM slices WHERE seq_len > 0 GROUP BY 1, 2""",
    "capture_seqs", extra=[("batches", _BATCHES), ("slices", _SLICES)]))
def q_stream_dedup(spark, d):
    """A stream of batches that two replicas captured, stopped half way and resumed: each parsed token key once, and no state
    left after the run's end marker (R7)."""
    cfg = RunConfig(run_id="once", layers=(CAPTURE_LAYER,), tp_size=1)
    src, out, ck = (scratch_path(spark, n) for n in ("dedup-src", "dedup-out", "dedup-ck"))
    rows = capture_rows(spark, d)
    for replica in (0, 1):  # the second replica's copies come after the restart
        rows.withColumn("gpu_id", F.col("gpu_id") + 8 * replica).repartition(2).write.mode("append").parquet(src)
        if replica:
            mark_run_end(spark, src)
        q = start_dedup_ingest(capture_stream(spark, src, 1), cfg, out, ck, d_model=D, buckets=8)
        drain(q)
    left = F.lit(state_rows(q)).cast("long")
    return spark.read.parquet(out).groupBy("prompt_id", "completion_idx").agg(F.count(F.lit(1)).alias("n_tokens")).withColumn("state_rows", left)


@query("replica_tables", "K8", with_views(
    """SELECT dp_rank, run_id, layer, prompt_id, completion_idx, count(*) AS n_tokens FROM replica_rows GROUP BY ALL""", "replica_rows"))
def q_replica_tables(spark, d):
    """Encoded rows written with one partition folder per replica and read back (K8)."""
    path = scratch_path(spark, "by-replica")
    write_by_replica(encode_activations(fx.replica_rows(spark, d), "bfloat16"), path)
    return spark.read.parquet(path).groupBy("dp_rank", "run_id", "layer", "prompt_id", "completion_idx").agg(F.count(F.lit(1)).alias("n_tokens"))


@query("stream_manifest", "R5", with_views(
    f"""SELECT 'stream' AS run_id, {CAPTURE_LAYER} AS layer, CAST(sum(seq_len) AS BIGINT) AS total_tokens,
          count(DISTINCT (prompt_id, completion_idx)) FILTER (WHERE prompt_id >= 0) AS n_sequences FROM slices WHERE seq_len > 0""",
    "capture_seqs", extra=[("batches", _BATCHES), ("slices", _SLICES)]))
def q_stream_manifest(spark, d):
    """The incremental manifest of a stream of as many triggers as files, kept in a log that merges its tables."""
    cfg = RunConfig(run_id="stream", layers=(CAPTURE_LAYER,), tp_size=1)
    out = scratch_path(spark, "manifest-updates")
    drain(start_manifest_updates(capture_stream(spark, _capture_files(spark, d), 1), cfg, out, scratch_path(spark, "manifest-ck")))
    return read_manifest_updates(spark, out)


TRIGGERS = 5
_STREAMED = [
    ("batches", _BATCHES), ("slices", _SLICES),
    ("seqs", """
        SELECT epoch, prompt_id, completion_idx, CAST(sum(seq_len) AS INT) AS n_tokens FROM (
          SELECT s.*, CAST(floor(5.0 * batch_id / (SELECT max(batch_id) + 1 FROM capture_seqs)) AS BIGINT) AS epoch FROM slices s WHERE seq_len > 0) q
        GROUP BY 1, 2, 3"""),
    ("ord", f"SELECT *, n_tokens * {D * 2} AS n_bytes, row_number() OVER (ORDER BY epoch, prompt_id, completion_idx) AS i FROM seqs"),
    _ROTATED[-1],
]


@query("stream_rotated", "K7 W1 K3 R1 R6", with_views(
    f"""SELECT printf('shard_%04d', w.shard) AS shard, {CAPTURE_LAYER} AS layer, o.prompt_id, o.completion_idx, o.n_tokens, o.epoch,
          CAST(coalesce(sum(o.n_tokens) OVER (PARTITION BY w.shard ORDER BY o.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
        FROM ord o JOIN walk w ON o.i = w.i""", "capture_seqs", extra=_STREAMED, recursive=True))
def q_stream_rotated(spark, d):
    """The index of a streamed ingest whose shards rotate at 8 KiB while the batches arrive, in five triggers of two starts."""
    cfg = RunConfig(run_id="rolling", layers=(CAPTURE_LAYER,), tp_size=1, shard_bytes=SHARD_BYTES)
    src, out, ck = (scratch_path(spark, n) for n in ("rolling-src", "rolling-out", "rolling-ck"))
    rows = capture_rows(spark, d).drop("vec").withColumn("vec", F.lit(None).cast("array<float>"))
    n = rows.agg(F.max("batch_id")).first()[0] + 1
    rows = stored(rows.withColumn("part", F.floor(F.lit(float(TRIGGERS)) * F.col("batch_id") / n)), "rolling-rows")
    for part in range(TRIGGERS):  # a file for each trigger, in order
        rows.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(src)
        if part in (1, TRIGGERS - 1):
            drain(start_rotating_index(capture_stream(spark, src, 1), cfg, D, out, ck))
    return read_rotating_index(spark, out).select("shard", "layer", "prompt_id", "completion_idx", "n_tokens", "epoch", "start")


@query("stream_report", "R4 A9 K5", with_views(
    """SELECT 'sound' AS run_id, 'ended' AS status, false AS told, count(*) AS n_input_rows FROM capture_tokens
       UNION ALL SELECT 'unsound', 'failed', true, 0""", "capture_tokens"))
def q_stream_report(spark, d):
    """Summary rows of two streamed runs over the same captured files, one with the right vector length and one that fails at its first
    trigger; told: the row gives the reason (R4, A9)."""
    src, out = _capture_files(spark, d), scratch_path(spark, "reported")
    for run, width in (("sound", D), ("unsound", D + 1)):
        cfg = RunConfig(run_id=run, layers=(CAPTURE_LAYER,), tp_size=1)
        drain_reported(spark, lambda: start_ingest(capture_stream(spark, src, 1), cfg, f"{out}/acts/{run}", f"{out}/ck/{run}", d_model=width),  # noqa: B023
                       run, f"{out}/summary", raise_failure=False)
    rows = spark.read.schema("run_id string, status string, reason string, n_input_rows long").json(f"{out}/summary")
    return rows.select("run_id", "status", F.coalesce(F.col("reason").contains("elements instead of"), F.lit(False)).alias("told"), "n_input_rows")


@query("stream_resume", "R6 R4", with_views(
    "SELECT prompt_id, completion_idx, CAST(sum(seq_len) AS BIGINT) AS n_tokens FROM slices WHERE seq_len > 0 GROUP BY 1, 2",
    "capture_seqs", extra=[("batches", _BATCHES), ("slices", _SLICES)]))
def q_stream_resume(spark, d):
    """A stream that is stopped after part of its files, resumed when more have come, and resumed again with nothing new:
    every token once (R6)."""
    cfg = RunConfig(run_id="resumed", layers=(CAPTURE_LAYER,), tp_size=1)
    src, out, ck = (scratch_path(spark, n) for n in ("resume-src", "resume-out", "resume-ck"))
    rows = capture_rows(spark, d)
    for half in (0, 1, None):
        if half is not None:
            rows.where(F.col("batch_id") % 2 == half).repartition(2).write.mode("append").parquet(src)
        drain(start_ingest(capture_stream(spark, src, 1), cfg, out, ck, d_model=D))
    return spark.read.parquet(out).groupBy("prompt_id", "completion_idx").agg(F.count(F.lit(1)).alias("n_tokens"))


# --------------------------------------------------------------------------- legacy shards

def _legacy_root(spark, acts, dtype: str, keep=None, root: str | None = None) -> str:
    """Rows (shard, layer, keys, payload) exported as legacy shards, of a new root or into one; ``keep`` may change the manifest."""
    key = ("shard", "layer", "prompt_id", "completion_idx")
    seqs = L.sequence_lengths(acts, key).withColumn("append_ord", F.struct("prompt_id", "completion_idx"))
    idx = L.index_offsets(seqs, "append_ord", partition=("shard", "layer"))
    man = L.manifest(idx, "stand-in", D, dtype)
    root = root or scratch_path(spark, "legacy")
    export_legacy(acts, idx, keep(man) if keep else man, root)
    return root


def _shard(spark, d, run: str, shard: str, dtype: str):
    v = fx.vectors(spark, d).where(F.col("run_id") == run).drop("run_id").withColumn("shard", F.lit(shard))
    return encode_activations(v, dtype, d_model=D)


_BFN = Sq.norm(Sq.vmap("vec", Sq.bf16))


@query("legacy_append", "K9 W1 S5", with_views(
    f"""SELECT s.layer, s.prompt_id, s.completion_idx, s.n_tokens, round(s.norm_mean, 6) AS norm_mean,
          CAST(coalesce(sum(s.n_tokens) OVER (PARTITION BY layer ORDER BY prompt_id % 2, prompt_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
        FROM (SELECT layer, prompt_id, completion_idx, CAST(count(*) AS INT) AS n_tokens, avg({_BFN}) AS norm_mean
              FROM vectors WHERE run_id = 'base' GROUP BY 1, 2, 3) s""", "vectors"))
def q_legacy_append(spark, d):
    """A legacy shard written with the even prompts and re-opened for the odd ones: both are there, the index goes on."""
    acts = _shard(spark, d, "base", "shard_0000", "bfloat16")
    root = _legacy_root(spark, acts.where("prompt_id % 2 = 0"), "bfloat16")
    append_legacy(acts.where("prompt_id % 2 = 1"), root, "stand-in", D, "bfloat16")
    h = norm_health(import_legacy(spark, root), ("shard", "layer", "prompt_id", "completion_idx"))
    starts = read_index(spark, root).select("shard", "layer", "prompt_id", "completion_idx", "start")
    return h.join(starts, ["shard", "layer", "prompt_id", "completion_idx"]).select(
        "layer", "prompt_id", "completion_idx", "n_tokens", r6("norm_mean").alias("norm_mean"), "start")


@query("legacy_recover", "K9 K4 S5", with_views(
    f"""SELECT s.layer, s.prompt_id, s.completion_idx, s.n_tokens, round(s.norm_mean, 6) AS norm_mean,
          CAST(coalesce(sum(s.n_tokens) OVER (PARTITION BY layer ORDER BY prompt_id % 3, prompt_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, t.n_seen
        FROM (SELECT layer, prompt_id, completion_idx, CAST(count(*) AS INT) AS n_tokens, avg({_BFN}) AS norm_mean
              FROM vectors WHERE run_id = 'base' GROUP BY 1, 2, 3) s,
             (SELECT count(*) AS n_seen FROM vectors WHERE run_id = 'base' AND prompt_id % 3 = 0) t""", "vectors"))
def q_legacy_recover(spark, d):
    """A legacy shard that is appended to by three writers: one dies before its decision (nothing of it is seen), one after it (the
    next to open the shard carries it out), one ends; every prompt is there once, the index goes on (K9)."""
    acts = _shard(spark, d, "base", "shard_0000", "bfloat16")
    part = [acts.where(F.col("prompt_id") % 3 == k) for k in range(3)]
    root = _legacy_root(spark, part[0], "bfloat16")
    stage_append(part[1], root, "stand-in", D, "bfloat16")
    n_seen = read_legacy(spark, root).count()
    recover_legacy(spark, root, discard=True)
    decide_legacy(qualified(spark, root), stage_append(part[1], root, "stand-in", D, "bfloat16"))
    commit_legacy(spark, root, stage_append(part[2], root, "stand-in", D, "bfloat16"))
    h = norm_health(read_legacy(spark, root), ("shard", "layer", "prompt_id", "completion_idx"))
    starts = read_index(spark, root).select("shard", "layer", "prompt_id", "completion_idx", "start")
    return h.join(starts, ["shard", "layer", "prompt_id", "completion_idx"]).select(
        "layer", "prompt_id", "completion_idx", "n_tokens", r6("norm_mean").alias("norm_mean"), "start", F.lit(n_seen).cast("long").alias("n_seen"))


@query("legacy_stream", "S9 R1 R6 K9", with_views(
    f"""SELECT run_id AS shard, layer, prompt_id, completion_idx, CAST(count(*) AS BIGINT) AS n_tokens, round(sum({_BFN}), 4) AS norm_sum
        FROM (SELECT * REPLACE (CASE run_id WHEN 'base' THEN 'shard_0000' ELSE 'shard_0001' END AS run_id) FROM vectors) v GROUP BY ALL""", "vectors"))
def q_legacy_stream(spark, d):
    """A root of legacy shards read as a stream while it is appended to twice, the last time by a new shard: every sequence once."""
    base = _shard(spark, d, "base", "shard_0000", "bfloat16")
    root = _legacy_root(spark, base.where("prompt_id % 2 = 0"), "bfloat16")
    out, ck = scratch_path(spark, "legacy-stream"), scratch_path(spark, "legacy-stream-ck")
    for step in range(3):
        if step == 1:
            append_legacy(base.where("prompt_id % 2 = 1"), root, "stand-in", D, "bfloat16")
        elif step == 2:
            _legacy_root(spark, _shard(spark, d, "variant", "shard_0001", "bfloat16"), "bfloat16", root=root)
        drain(stream_legacy(spark, root).writeStream.format("parquet").option("checkpointLocation", ck).trigger(availableNow=True).start(out))
    x = decode_activations(spark.read.parquet(out)).withColumn("norm", V.l2_norm("vec"))
    return x.groupBy("shard", "layer", "prompt_id", "completion_idx").agg(F.count(F.lit(1)).alias("n_tokens"), F.round(F.sum("norm"), 4).alias("norm_sum"))


@query("legacy_pushdown", "S6 J8 P3 P14", with_views(
    f"""SELECT CASE run_id WHEN 'base' THEN 'shard_0000' ELSE 'shard_0001' END AS shard, layer, prompt_id, token_pos, round({_BFN}, 6) AS norm
        FROM vectors WHERE layer = 32 AND prompt_id >= 4 AND (run_id = 'base' OR token_pos < 3)""", "vectors"))
def q_legacy_pushdown(spark, d):
    """Two scans of legacy shards, each of the files and rows of some shard, layer, prompts and positions alone."""
    acts = _shard(spark, d, "base", "shard_0000", "bfloat16").unionByName(_shard(spark, d, "variant", "shard_0001", "bfloat16"))
    root, where = _legacy_root(spark, acts, "bfloat16"), {"layer": [32], "prompt_id": (4, None)}
    both = read_legacy(spark, root, where | {"shard": ["shard_0000"]}).unionByName(
        read_legacy(spark, root, where | {"shard": ["shard_0001"], "token_pos": (None, 2)}))
    return decode_activations(both).select("shard", "layer", "prompt_id", "token_pos", r6(V.l2_norm("vec")).alias("norm"))


@query("verify_legacy", "A4 A5 J10 W4 D19", with_views(
    f"""SELECT f.shard, f.layer, f.status, f.tokens_in_file, n.prompt_id, n.n_tokens, n.norm_mean
        FROM (SELECT 'shard_0000' AS shard, layer, 'ok' AS status, count(*) AS tokens_in_file FROM vectors WHERE run_id = 'base' GROUP BY layer
              UNION ALL SELECT 'shard_0000', 48, 'absent', NULL
              UNION ALL SELECT 'shard_0001', layer, CASE layer WHEN 16 THEN 'ok' ELSE 'unlisted' END,
                CASE layer WHEN 16 THEN count(*) END FROM vectors WHERE run_id = 'variant' GROUP BY layer) f
        LEFT JOIN (SELECT * FROM (
            SELECT CASE run_id WHEN 'base' THEN 'shard_0000' ELSE 'shard_0001' END AS shard, layer, prompt_id, CAST(count(*) AS INT) AS n_tokens,
              round(avg({_BFN}), 6) AS norm_mean, row_number() OVER (PARTITION BY run_id, layer ORDER BY prompt_id) AS rn
            FROM vectors GROUP BY run_id, layer, prompt_id) q WHERE rn <= 3) n ON n.shard = f.shard AND n.layer = f.layer AND f.status = 'ok'""",
    "vectors"))
def q_verify_legacy(spark, d):
    """The file report of legacy shards whose manifest lists a layer too many and one too few, with the norms of each layer's
    first three sequences (A4, A5, J10)."""
    acts = _shard(spark, d, "base", "shard_0000", "bfloat16").unionByName(_shard(spark, d, "variant", "shard_0001", "bfloat16"))

    def wrong(man):
        layers = F.when(F.col("shard") == "shard_0000", F.array_append("layers", F.lit(48))).otherwise(F.array_remove("layers", 32))
        return man.withColumn("layers", layers)
    out = verify_legacy_job(spark, _legacy_root(spark, acts, "bfloat16", wrong))
    norms = out["norms"].select("shard", "layer", "prompt_id", "n_tokens", r6("norm_mean").alias("norm_mean"))
    return out["files"].select("shard", "layer", "status", "tokens_in_file").join(norms, ["shard", "layer"], "left")


def _metrics_sql(pairs_of: str) -> str:
    """Medians and means per sequence of ``pairs`` (a, b), NaN where a value is NaN."""
    nan = "CAST('NaN' AS DOUBLE)"
    return f"""SELECT t.prompt_id, t.n_tokens, round(t.cos_mean, 6) AS cos_mean, round(t.cos_min, 6) AS cos_min,
          round(t.cos_median, 6) AS cos_median, round(t.rel_mean, 6) AS rel_mean,
          round(CASE WHEN isnan(t.rel_mean) THEN {nan} ELSE m.rel_median END, 6) AS rel_median
        FROM (SELECT prompt_id, CAST(count(*) AS INT) AS n_tokens, avg(cos) AS cos_mean,
                CASE WHEN bool_or(isnan(cos)) THEN {nan} ELSE min(cos) END AS cos_min,
                CASE WHEN bool_or(isnan(cos)) THEN {nan} ELSE quantile_disc(cos, 0.5) END AS cos_median,
                sum(rel_sum) / sum(d) AS rel_mean
              FROM (SELECT *, {_COS} AS cos, list_sum({_REL}) AS rel_sum, len(a) AS d FROM {pairs_of}) q GROUP BY prompt_id) t
        JOIN (SELECT prompt_id, quantile_disc(rel, 0.5) AS rel_median FROM (SELECT prompt_id, unnest({_REL}) AS rel FROM {pairs_of}) e
              GROUP BY prompt_id) m ON m.prompt_id = t.prompt_id"""


_METRICS = ("cos_mean", "cos_min", "cos_median", "rel_mean", "rel_median")
_LEGACY_PAIRS = f"""
    SELECT a.prompt_id, a.token_pos, {Sq.vmap('a.vec', Sq.bf16)} AS a, {Sq.vmap('b.vec', Sq.bf16)} AS b
    FROM vectors a JOIN vectors b ON a.prompt_id = b.prompt_id AND a.token_pos = b.token_pos AND a.layer = b.layer
    JOIN (SELECT prompt_id FROM vectors WHERE layer = 16 GROUP BY prompt_id
          HAVING count(*) FILTER (WHERE run_id = 'base') = count(*) FILTER (WHERE run_id = 'variant')) s ON s.prompt_id = a.prompt_id
    WHERE a.run_id = 'base' AND b.run_id = 'variant' AND a.layer = 16"""


@query("compare_legacy", "J3 A6 A7 (two shard roots)", with_views(
    _metrics_sql("pairs16"), "vectors", extra=[("pairs16", _LEGACY_PAIRS)]))
def q_compare_legacy(spark, d):
    """Two legacy shard roots, one per run, compared at layer 16."""
    roots = [_legacy_root(spark, _shard(spark, d, run, "shard_0000", "bfloat16"), "bfloat16") for run in ("base", "variant")]
    m = compare_legacy_job(spark, *roots, layer=16)["metrics"]
    return m.select("prompt_id", "n_tokens", *(r6(c).alias(c) for c in _METRICS))


VIEWS["odd_vectors"] = (["vectors"], """
    SELECT run_id, prompt_id, token_pos, vec FROM vectors WHERE run_id = 'base' AND layer = 16
    UNION ALL
    SELECT 'odd', prompt_id, token_pos, CASE WHEN prompt_id % 4 = 1 AND token_pos = 0 THEN list_concat([CAST('NaN' AS FLOAT)], vec[2:])
      WHEN prompt_id % 4 = 2 THEN list_transform(vec, lambda x: CAST(CAST(x AS DOUBLE) * 0.75::DOUBLE + 0.01::DOUBLE AS FLOAT))
      WHEN prompt_id % 4 = 3 THEN vec[1:32] ELSE vec END
    FROM vectors WHERE run_id = 'base' AND layer = 16""")
_ODD_PAIRS = """
    SELECT a.prompt_id, a.token_pos, a.vec AS a, b.vec AS b FROM odd_vectors a JOIN odd_vectors b
      ON a.prompt_id = b.prompt_id AND a.token_pos = b.token_pos
    WHERE a.run_id = 'base' AND b.run_id = 'odd' AND len(a.vec) = len(b.vec)"""


@query("compare_nan_and_ties", "A6 P16 H6", with_views(
    _metrics_sql("pairs"), "odd_vectors", extra=[("pairs", _ODD_PAIRS)]))
def q_compare_nan_and_ties(spark, d):
    """Runs of which some sequences are equal, some hold a NaN and some have another width, compared."""
    v = fx.odd_vectors(spark, d)
    m = C.pair_metrics(C.token_pairs(C.run_slice(v, "base"), C.run_slice(v, "odd")))
    return m.select("prompt_id", "n_tokens", *(r6(c).alias(c) for c in _METRICS))


SKETCH_ACCURACY = 64
_BASE_VARIANT = """
    SELECT a.prompt_id, a.vec AS a, b.vec AS b FROM vectors a JOIN vectors b ON a.prompt_id = b.prompt_id AND a.token_pos = b.token_pos
    AND a.layer = b.layer WHERE a.run_id = 'base' AND b.run_id = 'variant' AND a.layer = 16"""


@query("compare_sketch", "A6 (one pass)", with_views(
    f"""SELECT prompt_id, CAST(count(*) AS INT) AS n_tokens, CAST(sum(len(a)) AS BIGINT) AS n_elements, round(sum(list_sum({_REL})) / sum(len(a)), 6) AS rel_mean,
          true AS within FROM pairs16 GROUP BY prompt_id""", "vectors", extra=[("pairs16", _BASE_VARIANT + """ AND a.prompt_id IN (
          SELECT prompt_id FROM vectors WHERE layer = 16 GROUP BY prompt_id
          HAVING count(*) FILTER (WHERE run_id = 'base') = count(*) FILTER (WHERE run_id = 'variant'))""")]))
def q_compare_sketch(spark, d):
    """Two runs at layer 16 compared in one pass by mergeable summaries; within: the rank of each median among all elements of its
    sequence, counted exactly, lies in the stated bound (A6)."""
    v = fx.vectors(spark, d).where("layer = 16")
    pairs = C.token_pairs(C.run_slice(v, "base"), C.run_slice(v, "variant"))
    m = C.pair_metrics(pairs, median="approx", accuracy=SKETCH_ACCURACY)
    x = pairs.join(m.select("prompt_id", "rel_median"), "prompt_id").withColumn("rel", V.rel_err("a", "b"))
    below, upto = (F.sum(F.size(F.filter("rel", f))) for f in (lambda e: e < F.col("rel_median"), lambda e: e <= F.col("rel_median")))
    n = F.sum(F.size("rel"))
    rank, off = F.floor((n - 1) / 2) + 1, n / SKETCH_ACCURACY + 2
    ranks = x.groupBy("prompt_id").agg(n.cast("long").alias("n_elements"), ((below < rank + off) & (upto >= rank - off)).alias("within"))
    return m.join(ranks, "prompt_id").select("prompt_id", "n_tokens", "n_elements", r6("rel_mean").alias("rel_mean"), "within")


@query("verify_nan", "A5 V21", with_views(
    f"""SELECT run_id, prompt_id, CAST(count(*) AS INT) AS n_tokens, bool_or(list_bool_or(list_transform(vec, lambda x: isnan(x)))) AS any_nan
        FROM odd_vectors GROUP BY run_id, prompt_id""", "odd_vectors"))
def q_verify_nan(spark, d):
    """Sequences with a NaN among the stored ones."""
    return norm_health(encode_activations(fx.odd_vectors(spark, d), "bfloat16")).select("run_id", "prompt_id", "n_tokens", "any_nan")
