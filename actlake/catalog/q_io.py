"""Queries that write and read back: streaming ingest and the legacy layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import RunConfig
from ..functions import vec as V
from ..functions.codec import decode_activations, encode_activations
from ..operators import layout as L
from ..session import scratch_path
from ..sources import fixtures as fx
from ..sources.legacy import export_legacy, read_legacy
from ..streaming.ingest import capture_stream, drain, start_ingest
from . import sqlfrag as Sq
from .registry import query
from .views_sql import with_views

STREAM_CFG = RunConfig(run_id="stream", layers=(16,), tp_size=1, dtype="bfloat16")
STREAM_FILES = 4
CAPTURE_LAYER = 16
LEGACY_SHARDS = {"base": ("shard_0000", "bfloat16"), "variant": ("shard_0001", "int8")}


def r6(c):
    return F.round(c, 6)


def capture_rows(spark, d):
    """Captured token rows carrying their batch arrays (the stream's input)."""
    meta = fx.capture_batches(spark, d)
    t = fx.capture_tokens(spark, d)
    x = t.join(meta, "batch_id")
    return x.select(F.col("batch_id").cast("bigint"), F.col("gpu_id").cast("bigint"),
                    F.col("global_rank").cast("bigint"), F.lit(CAPTURE_LAYER).alias("layer"),
                    F.col("flat_pos").cast("int"), F.col("vec").cast("array<float>"),
                    "rids", F.col("seq_lens").cast("array<int>"), F.col("prefix_lens").cast("array<int>"))


_BATCHES = """
    SELECT batch_id, bool_or(seq_len IS NULL) OR batch_id % 7 = 5 AS any_null FROM capture_seqs GROUP BY batch_id"""
_PID, _CIDX = Sq.rid_parts("rid", "prefix_len")
_SLICES = f"""
    SELECT s.batch_id, {_PID} AS prompt_id, {_CIDX} AS completion_idx, s.prefix_len, s.seq_len,
      CAST(coalesce(sum(s.seq_len) OVER (PARTITION BY s.batch_id ORDER BY s.seq_ord
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
    FROM capture_seqs s JOIN batches b ON s.batch_id = b.batch_id WHERE NOT b.any_null"""
_BQ = Sq.vmap("t.vec", Sq.bf16)


@query("stream_ingest", "R1 R2 R3 S9", with_views(
    f"""SELECT s.prompt_id, s.completion_idx, CAST(s.prefix_len + i AS INT) AS token_pos, {CAPTURE_LAYER} AS layer,
          round({Sq.norm(_BQ)}, 6) AS norm, round({Sq.vsum(_BQ)}, 6) AS vsum
        FROM (SELECT *, unnest(range(seq_len)) AS i FROM slices WHERE seq_len > 0) s
        JOIN capture_tokens t ON t.batch_id = s.batch_id AND t.flat_pos = s.start + s.i""",
    "capture_seqs", "capture_tokens", extra=[("batches", _BATCHES), ("slices", _SLICES)]))
def q_stream_ingest(spark, d):
    """Captured token rows written as files, ingested by the streaming job (one file per trigger, available-now), read back and decoded."""
    src, out, ck = (scratch_path(spark, n) for n in ("capture-src", "stream-out", "stream-ckpt"))
    capture_rows(spark, d).repartition(STREAM_FILES).write.parquet(src)
    q = start_ingest(capture_stream(spark, src, max_files_per_trigger=1), STREAM_CFG, out, ck)
    drain(q)
    back = decode_activations(spark.read.parquet(out))
    return back.select("prompt_id", "completion_idx", "token_pos", "layer",
                       r6(V.l2_norm("vec")).alias("norm"), r6(V.array_sum("vec")).alias("vsum"))


def _legacy_value(dtype: str, v: str) -> str:
    if dtype == "bfloat16":
        return Sq.vmap(v, Sq.bf16)
    return Sq.int8_value(v, Sq.int8_scale(v))


_LEG_ROWS = " UNION ALL ".join(
    f"""SELECT '{shard}' AS shard, layer, prompt_id, completion_idx, token_pos, {_legacy_value(dt, 'vec')} AS q
        FROM vectors WHERE run_id = '{run}'""" for run, (shard, dt) in LEGACY_SHARDS.items())


@query("legacy_roundtrip", "S4 S5 S6 S7 K9", with_views(
    f"""SELECT shard, layer, prompt_id, completion_idx, token_pos, round({Sq.norm('q')}, 6) AS norm,
          round({Sq.vsum('q')}, 6) AS vsum FROM ({_LEG_ROWS}) t""", "vectors"))
def q_legacy_roundtrip(spark, d):
    """Two runs stored as legacy shards (bf16 and int8 with scale sidecar),
    exported with K9 and read back with S6."""
    v = fx.vectors(spark, d)
    acts = None
    for run, (shard, dt) in LEGACY_SHARDS.items():
        part = encode_activations(v.where(F.col("run_id") == run).drop("run_id")
                                  .withColumn("shard", F.lit(shard)), dt)
        acts = part if acts is None else acts.unionByName(part)
    names = F.create_map(*(F.lit(x) for run, (shard, _) in LEGACY_SHARDS.items() for x in (run, shard)))
    seqs = (L.sequence_lengths(v.withColumn("shard", names[F.col("run_id")]), ("shard", "layer", "prompt_id", "completion_idx"))
            .withColumn("append_ord", F.col("prompt_id") * 1000 + F.col("completion_idx")))
    idx = L.index_offsets(seqs, "append_ord", partition=("shard", "layer"))
    man = None
    for shard, dt in LEGACY_SHARDS.values():
        mf = L.manifest(idx.where(F.col("shard") == shard), "stand-in", 64, dt)
        man = mf if man is None else man.unionByName(mf)
    root = scratch_path(spark, "legacy")
    export_legacy(acts, idx, man, root)
    back = decode_activations(read_legacy(spark, root))
    return back.select("shard", "layer", "prompt_id", "completion_idx", "token_pos",
                       r6(V.l2_norm("vec")).alias("norm"), r6(V.array_sum("vec")).alias("vsum"))
