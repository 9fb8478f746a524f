"""Queries over the index, manifest, shard layout and read-back checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vec as V
from ..functions.codec import encode_activations
from ..functions.text import json_row
from ..operators import layout as L
from ..operators import verify as VF
from ..operators.demux import sequence_slices
from ..session import scratch_path
from ..functions.codec import decode_activations, encode_activations
from ..sinks.tables import encode_and_write, write_activations
from ..sources import fixtures as fx
from ..sources.shards import lookup_sequence, lookup_sequences, read_sequence
from . import sqlfrag as Sq
from .registry import query
from .views_sql import with_views

D_MODEL, BPE = 5120, 2
SHARD_LIMIT = 1 << 30
# The layers each run was configured to write (the variant run claims one layer).
MANIFEST_LAYERS = [("base", 16), ("base", 32), ("variant", 16)]
LOOKUP = dict(run_id="base", layer=32, prompt_id=3, completion_idx=0)


def r6(c):
    return F.round(c, 6)


_OFFSETS = """
    SELECT *, CAST(coalesce(sum(n_tokens) OVER (PARTITION BY layer ORDER BY append_ord
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
    FROM doc_index"""
_JSON = ("md5(to_json({'prompt_id': prompt_id, 'completion_idx': completion_idx, 'layer': layer, "
         "'start': start, 'n_tokens': n_tokens}))")


def _offsets(spark, d):
    return L.index_offsets(fx.doc_index(spark, d), "append_ord", partition=("layer",))


@query("index_offsets", "W1 K3 V28", with_views(
    f"SELECT prompt_id, layer, append_ord, n_tokens, start, {_JSON} AS line_md5 FROM offs",
    "doc_index", extra=[("offs", _OFFSETS)]))
def q_index_offsets(spark, d):
    """Index start offsets per layer in append order over the document index, with the JSON line's md5."""
    x = _offsets(spark, d)
    line = json_row("prompt_id", "completion_idx", "layer", "start", "n_tokens")
    return x.select("prompt_id", "layer", "append_ord", "n_tokens", "start", F.md5(line).alias("line_md5"))


_SEQ_BYTES = f"""
    SELECT prompt_id, completion_idx, append_ord, CAST(sum(n_tokens) * {D_MODEL * BPE} AS BIGINT) AS n_bytes
    FROM doc_index GROUP BY prompt_id, completion_idx, append_ord"""
_SHARDS = f"""
    SELECT *, CAST(floor(coalesce(sum(n_bytes) OVER (ORDER BY append_ord
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {SHARD_LIMIT}) AS INT) AS shard
    FROM seq_bytes"""


def _seq_bytes(spark, d):
    return (fx.doc_index(spark, d).groupBy("prompt_id", "completion_idx", "append_ord")
            .agg((F.sum("n_tokens") * F.lit(D_MODEL * BPE)).cast("bigint").alias("n_bytes")))


_GREEDY = [
    ("seq_bytes", _SEQ_BYTES),
    ("ord", "SELECT *, row_number() OVER (ORDER BY append_ord) AS i FROM seq_bytes"),
    ("walk(i, shard, acc)", f"""
        SELECT i, 0, n_bytes FROM ord WHERE i = 1
        UNION ALL
        SELECT o.i, CASE WHEN w.acc >= {SHARD_LIMIT} THEN w.shard + 1 ELSE w.shard END,
               CASE WHEN w.acc >= {SHARD_LIMIT} THEN o.n_bytes ELSE w.acc + o.n_bytes END
        FROM walk w JOIN ord o ON o.i = w.i + 1"""),
    ("greedy", "SELECT o.*, CAST(w.shard AS INT) AS shard FROM ord o JOIN walk w ON o.i = w.i"),
]


def _shards(spark, d, policy="greedy"):
    return L.assign_shards(_seq_bytes(spark, d), SHARD_LIMIT, "append_ord", policy=policy)


@query("shard_assignment", "K7", with_views(
    "SELECT prompt_id, append_ord, n_bytes, shard FROM greedy", "doc_index", extra=_GREEDY, recursive=True))
def q_shard_assignment(spark, d):
    """K7 with the single-writer rule: rotate after the sequence that reaches the limit."""
    return _shards(spark, d).select("prompt_id", "append_ord", "n_bytes", "shard")


@query("shard_assignment_floor", "K7 (parallel floor policy)", with_views(
    "SELECT prompt_id, append_ord, n_bytes, shard FROM shards", "doc_index",
    extra=[("seq_bytes", _SEQ_BYTES), ("shards", _SHARDS)]))
def q_shard_assignment_floor(spark, d):
    """K7 with shard = floor(bytes before the sequence / limit)."""
    return _shards(spark, d, "floor").select("prompt_id", "append_ord", "n_bytes", "shard")


@query("shard_manifest", "A3 K4 O4 V27", with_views(
    """SELECT s.shard, i.layer, CAST(sum(i.n_tokens) AS BIGINT) AS total_tokens, count(*) AS n_index_rows,
          count(DISTINCT (i.prompt_id, i.completion_idx)) AS n_sequences,
          printf('acts_layer_%03d.bin', i.layer) AS file_name
       FROM doc_index i JOIN greedy s ON i.append_ord = s.append_ord
       GROUP BY s.shard, i.layer""", "doc_index", extra=_GREEDY, recursive=True))
def q_shard_manifest(spark, d):
    """Tokens, index rows and sequences per (shard, layer) with single-writer shards of 1 GiB."""
    idx = fx.doc_index(spark, d).join(_shards(spark, d).select("append_ord", "shard"), "append_ord")
    return L.manifest_rows(idx, ("shard",))


def _stored(spark, d):
    return encode_activations(fx.vectors(spark, d), "bfloat16")


def _written(spark, d):
    """Both runs as stored: encoded, written partitioned and sorted (K1), read back."""
    root = scratch_path(spark, "runs")
    encode_and_write(fx.vectors(spark, d), root, "bfloat16", 64)
    return spark.read.parquet(root)


def _claimed_index(spark, d):
    expected = fx.token_base(spark, d).groupBy("prompt_id").agg(F.count(F.lit(1)).cast("int").alias("n_tokens"))
    keys = fx.vectors(spark, d).select("run_id", "layer", "prompt_id", "completion_idx").distinct()
    return keys.join(expected, "prompt_id")


_CLAIMED = """
    SELECT k.run_id, k.layer, k.prompt_id, k.completion_idx, e.n_tokens
    FROM (SELECT DISTINCT run_id, layer, prompt_id, completion_idx FROM vectors) k
    JOIN (SELECT prompt_id, CAST(count(*) AS INT) AS n_tokens FROM token_base GROUP BY prompt_id) e
      ON k.prompt_id = e.prompt_id"""
_MANIFEST_VALUES = ", ".join(f"('{r}', {l})" for r, l in MANIFEST_LAYERS)


@query("verify_reconcile", "T4 A4 J10", with_views(
    f"""SELECT i.run_id, i.layer, i.n_sequences, i.tokens_index, s.tokens_stored, CAST(0 AS BIGINT) AS torn_bytes,
          CASE WHEN m.run_id IS NULL THEN 'unindexed_layer'
               WHEN i.tokens_index = s.tokens_stored THEN 'ok' ELSE 'MISMATCH' END AS status
        FROM (SELECT run_id, layer, count(*) AS n_sequences, CAST(sum(n_tokens) AS BIGINT) AS tokens_index
              FROM claimed GROUP BY run_id, layer) i
        JOIN (SELECT run_id, layer, CAST(count(*) AS BIGINT) AS tokens_stored FROM vectors GROUP BY run_id, layer) s
          ON i.run_id = s.run_id AND i.layer = s.layer
        LEFT JOIN (VALUES {_MANIFEST_VALUES}) m(run_id, layer) ON m.run_id = i.run_id AND m.layer = i.layer""",
    "vectors", "token_base", extra=[("claimed", _CLAIMED)]))
def q_verify_reconcile(spark, d):
    """Claimed index tokens vs stored payload bytes per (run, layer), with layers missing from the manifest."""
    man = spark.createDataFrame(MANIFEST_LAYERS, "run_id string, layer int")
    return VF.reconcile(_claimed_index(spark, d), _stored(spark, d), 64, manifest_layers=man, check_bytes=True)


def _bf16_norm_sql(v):
    return Sq.norm(Sq.vmap(v, Sq.bf16))


@query("verify_norms", "A5 V10 V21", with_views(
    f"""SELECT run_id, layer, prompt_id, completion_idx, CAST(count(*) AS INT) AS n_tokens,
          round(avg(nrm), 6) AS norm_mean, round(min(nrm), 6) AS norm_min, round(max(nrm), 6) AS norm_max,
          bool_or(has_nan) AS any_nan
        FROM (SELECT *, {_bf16_norm_sql('vec')} AS nrm,
                list_bool_or(list_transform(vec, lambda x: isnan(x))) AS has_nan FROM vectors) t
        GROUP BY run_id, layer, prompt_id, completion_idx""", "vectors"))
def q_verify_norms(spark, d):
    """Norm and NaN health of every stored sequence read back from bf16 payloads."""
    h = VF.norm_health(_written(spark, d))  # decodes inside the statistics pass
    return h.select("run_id", "layer", "prompt_id", "completion_idx", "n_tokens", r6(F.col("norm_mean")).alias("norm_mean"),
                    r6(F.col("norm_min")).alias("norm_min"), r6(F.col("norm_max")).alias("norm_max"), "any_nan")


@query("verify_sample3", "W4", with_views(
    f"""SELECT run_id, layer, prompt_id, n_tokens, round(norm_mean, 6) AS norm_mean FROM (
          SELECT run_id, layer, prompt_id, count(*) AS n_tokens, avg({_bf16_norm_sql('vec')}) AS norm_mean,
                 row_number() OVER (PARTITION BY run_id, layer ORDER BY prompt_id) AS rn
          FROM vectors GROUP BY run_id, layer, prompt_id) t WHERE rn <= 3""", "vectors"))
def q_verify_sample3(spark, d):
    """Norm health of the first three sequences per (run, layer) in index order."""
    stored = _written(spark, d)
    idx = L.sequence_lengths(stored).withColumn("append_ord", F.col("prompt_id"))
    first = VF.first_k_sequences(idx, 3, ("run_id", "layer"), "append_ord")
    sample = stored.join(first.select("run_id", "layer", "prompt_id", "completion_idx"),
                         ["run_id", "layer", "prompt_id", "completion_idx"], "left_semi")
    h = VF.norm_health(sample)
    return h.select("run_id", "layer", "prompt_id", F.col("n_tokens").cast("long").alias("n_tokens"),
                    r6(F.col("norm_mean")).alias("norm_mean"))


@query("duplicate_keys", "A14 W3", with_views(
    """SELECT prompt_id, completion_idx, layer, count(*) AS n_rows,
          arg_min(start, append_ord) AS first_start, arg_max(start, append_ord) AS last_start
       FROM offs GROUP BY prompt_id, completion_idx, layer HAVING count(*) > 1""",
    "doc_index", extra=[("offs", _OFFSETS)]))
def q_duplicate_keys(spark, d):
    """Index keys appended more than once, with the first and last start."""
    return VF.duplicate_keys(_offsets(spark, d))


_PID, _CIDX = Sq.rid_parts("rid", "prefix_len")


@query("plan_vs_index", "J7", with_views(
    f"""SELECT coalesce(p.prompt_id, i.prompt_id) AS prompt_id, coalesce(p.completion_idx, i.completion_idx) AS completion_idx,
          p.plan_tokens, i.index_tokens, coalesce(i.n_index_rows, 0) AS n_index_rows,
          CASE WHEN i.index_tokens IS NULL THEN 'missing' WHEN p.plan_tokens IS NULL THEN 'unplanned'
               WHEN p.plan_tokens <> i.index_tokens THEN 'length_mismatch' ELSE 'ok' END AS status
        FROM (SELECT prompt_id // 2 AS prompt_id, CAST(prompt_id % 2 AS INT) AS completion_idx, CAST(count(*) AS BIGINT) AS plan_tokens
              FROM token_base GROUP BY 1, 2) p
        FULL OUTER JOIN (
          SELECT pid AS prompt_id, cidx AS completion_idx, count(*) AS n_index_rows, CAST(sum(seq_len) AS BIGINT) AS index_tokens
          FROM (SELECT s.*, {_PID} AS pid, {_CIDX} AS cidx FROM capture_seqs s
                WHERE s.seq_len > 0 AND s.batch_id % 7 <> 5
                  AND s.batch_id NOT IN (SELECT batch_id FROM capture_seqs WHERE seq_len IS NULL)) q
          GROUP BY pid, cidx) i
        ON p.prompt_id = i.prompt_id AND p.completion_idx = i.completion_idx""", "token_base", "capture_seqs"))
def q_plan_vs_index(spark, d):
    """Plan vs captured index per sequence: ok, missing, unplanned or length mismatch."""
    plan = fx.token_base(spark, d).groupBy(
        F.floor(F.col("prompt_id") / 2).alias("prompt_id"), (F.col("prompt_id") % 2).cast("int").alias("completion_idx")) \
        .agg(F.count(F.lit(1)).alias("n_tokens"))
    idx = sequence_slices(fx.capture_batches(spark, d), tp_size=1).withColumnRenamed("seq_len", "n_tokens")
    return VF.plan_vs_index(plan, idx)


@query("read_sequence", "J8 O3", with_views(
    f"""SELECT token_pos, round({_bf16_norm_sql('vec')}, 6) AS norm, round({Sq.vsum(Sq.vmap('vec', Sq.bf16))}, 6) AS vsum
        FROM vectors WHERE run_id = '{LOOKUP['run_id']}' AND layer = {LOOKUP['layer']}
          AND prompt_id = {LOOKUP['prompt_id']} AND completion_idx = {LOOKUP['completion_idx']}""", "vectors"))
def q_read_sequence(spark, d):
    """Point lookup of one stored sequence at one layer, in token order."""
    x = read_sequence(_written(spark, d), strict=False, **LOOKUP)
    return x.select("token_pos", r6(V.l2_norm("vec")).alias("norm"), r6(V.array_sum("vec")).alias("vsum"))


@query("sequence_lookup", "J8 O3 K1", with_views(
    f"""SELECT run_id, layer, prompt_id, token_pos, round({_bf16_norm_sql('vec')}, 6) AS norm FROM vectors
        WHERE (run_id = 'base' AND layer = 32 AND prompt_id = 3)
           OR (run_id = 'variant' AND layer = 16 AND prompt_id IN (SELECT prompt_id FROM vectors WHERE run_id = 'variant' AND layer = 16
               GROUP BY prompt_id HAVING count(*) = 1))""", "vectors"))
def q_sequence_lookup(spark, d):
    """Both runs written in buckets of their sequences; one sequence by its key and all that have a single token by a frame of
    keys, from the folders of their buckets alone (J8, O3)."""
    path, v = scratch_path(spark, "acts-buckets"), fx.vectors(spark, d)
    write_activations(encode_activations(v, "bfloat16"), path, 64, 2, mode="overwrite", validate=False, buckets=16)
    short = v.where("run_id = 'variant' and layer = 16").groupBy("prompt_id", "completion_idx").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    one = lookup_sequence(spark, path, "base", 32, 3, 0)
    some = decode_activations(lookup_sequences(spark, path, "variant", 16, short))
    cols = ["run_id", "layer", "prompt_id", "token_pos", r6(V.l2_norm("vec")).alias("norm")]
    return one.select(*cols).unionByName(some.select(*cols))
