"""Queries over captured batches, architectures, steering and the codecs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DTYPE_BYTES
from ..functions import quant as Q
from ..functions import vec as V
from ..functions.codec import decode_activations, encode_activations
from ..functions.text import parse_rid
from ..operators import arch as A
from ..operators import demux as D
from ..operators import steer as S
from ..operators.verify import payload_audit
from ..sources import fixtures as fx
from . import sqlfrag as Sq
from .registry import query
from .views_sql import with_views

LAYERS_KEPT = (16,)
ROUTING_TP = 4
STEER_ALPHA = 1.5
STEER_LAYERS = (16, 32)
D_MODEL = 64


def r6(c):
    return F.round(c, 6)


def r9(c):
    return F.round(c, 9)


# --------------------------------------------------------------------------- capture and demux

@query("layer_filter", "P3 T5", with_views(
    f"""SELECT run_id, layer, prompt_id, completion_idx, token_pos, round({Sq.norm('vec')}, 6) AS norm
        FROM vectors WHERE layer IN ({", ".join(map(str, LAYERS_KEPT))})""", "vectors"))
def q_layer_filter(spark, d):
    """Stored vectors of layer 16 only, with their norms."""
    v = fx.vectors(spark, d).where(F.col("layer").isin(list(LAYERS_KEPT)))
    return v.select("run_id", "layer", "prompt_id", "completion_idx", "token_pos", r6(V.l2_norm("vec")).alias("norm"))


_BATCHES = """
    SELECT batch_id, min(gpu_id) AS gpu_id, min(global_rank) AS global_rank,
           bool_or(seq_len IS NULL) AS no_lens, batch_id % 7 = 5 AS short_rids,
           bool_or(seq_len IS NULL) OR batch_id % 7 = 5 AS any_null FROM capture_seqs GROUP BY batch_id"""


@query("replica_filter", "P4 P5", with_views(
    f"""SELECT batch_id, gpu_id, CAST(floor(coalesce(gpu_id, 0) / {ROUTING_TP}) AS INT) AS dp_rank
        FROM batches WHERE global_rank % {ROUTING_TP} = 0""", "capture_seqs", extra=[("batches", _BATCHES)]))
def q_replica_filter(spark, d):
    """Capture batches of the capturing tensor-parallel rank and their data-parallel replica, tp = 4."""
    m = fx.capture_batches(spark, d)
    return (m.where(D.capturing_replica(F.col("global_rank"), ROUTING_TP))
            .select("batch_id", "gpu_id", D.dp_rank(F.col("gpu_id"), ROUTING_TP).alias("dp_rank")))


@query("prefill_filter", "S9 P6 P7", with_views(
    """SELECT s.batch_id, s.seq_ord, s.rid, s.seq_len FROM capture_seqs s
       JOIN batches b ON s.batch_id = b.batch_id WHERE NOT b.any_null AND s.seq_len > 0""",
    "capture_seqs", extra=[("batches", _BATCHES)]))
def q_prefill_filter(spark, d):
    """Sequences of prefill batches with a non-zero length."""
    s = D.sequence_slices(fx.capture_batches(spark, d), tp_size=1)
    return s.select("batch_id", "seq_ord", "rid", "seq_len")


_PID, _CIDX = Sq.rid_parts("rid", "prefix_len")


@query("rid_parse", "P2", with_views(
    f"SELECT batch_id, seq_ord, rid, {_PID} AS prompt_id, {_CIDX} AS completion_idx FROM capture_seqs",
    "capture_seqs"))
def q_rid_parse(spark, d):
    """Request ids parsed to (prompt_id, completion_idx) with the fallback rule."""
    s = fx.capture_seqs(spark, d)
    pid, cidx = parse_rid(F.col("rid"), F.col("prefix_len"))
    return s.select("batch_id", "seq_ord", "rid", pid.alias("prompt_id"), cidx.alias("completion_idx"))


_SLICES = f"""
    SELECT s.batch_id, CAST(floor(coalesce(b.gpu_id, 0) / 1) AS INT) AS dp_rank, s.seq_ord, s.rid, {_PID} AS prompt_id, {_CIDX} AS completion_idx,
      CAST(coalesce(sum(s.seq_len) OVER (PARTITION BY s.batch_id ORDER BY s.seq_ord
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
      s.seq_len, s.prefix_len
    FROM capture_seqs s JOIN batches b ON s.batch_id = b.batch_id WHERE NOT b.any_null"""


@query("demux_offsets", "W2", with_views(
    """SELECT batch_id, dp_rank, seq_ord, rid, prompt_id, completion_idx, start, seq_len
       FROM slices WHERE seq_len > 0""", "capture_seqs", extra=[("batches", _BATCHES), ("slices", _SLICES)]))
def q_demux_offsets(spark, d):
    """Start offset and length of every captured sequence inside its batch."""
    s = D.sequence_slices(fx.capture_batches(spark, d), tp_size=1)
    return s.select("batch_id", "dp_rank", "seq_ord", "rid", "prompt_id", "completion_idx", "start", "seq_len")


@query("demux_vectors", "W2 D8", with_views(
    f"""SELECT s.batch_id, s.prompt_id, s.completion_idx, CAST(s.prefix_len + i AS INT) AS token_pos,
          round({Sq.norm('t.vec')}, 6) AS norm, round({Sq.vsum('t.vec')}, 6) AS vsum
        FROM (SELECT *, unnest(range(seq_len)) AS i FROM slices WHERE seq_len > 0) s
        JOIN capture_tokens t ON t.batch_id = s.batch_id AND t.flat_pos = s.start + s.i""",
    "capture_seqs", "capture_tokens", extra=[("batches", _BATCHES), ("slices", _SLICES)]))
def q_demux_vectors(spark, d):
    """Captured flat tokens assigned to their sequence and position, as norm and sum."""
    x = D.demux(fx.capture_tokens(spark, d), fx.capture_batches(spark, d), tp_size=1)
    return x.select("batch_id", "prompt_id", "completion_idx", "token_pos",
                    r6(V.l2_norm("vec")).alias("norm"), r6(V.array_sum("vec")).alias("vsum"))


# --------------------------------------------------------------------------- architectures and steering

def _tuple_sum(h, r):
    return Sq.zipmap(h, r, lambda x, y: Sq.bf16(f"({x} + {y})"))


_RESID = f"CASE p.pattern WHEN 'single' THEN s.h ELSE {_tuple_sum('s.h', 's.r')} END"


@query("arch_residual", "J9 V14 V15 U1 U5", with_views(
    f"""SELECT s.vec_id, s.layer_class, p.pattern, round({Sq.norm('res')}, 6) AS res_norm,
          round({Sq.vsum('res')}, 6) AS res_sum
        FROM (SELECT s.*, p.pattern, {_RESID} AS res FROM arch_states s JOIN arch_patterns p
              ON s.layer_class = p.layer_class) s JOIN arch_patterns p ON s.layer_class = p.layer_class""",
    "arch_states", "arch_patterns"))
def q_arch_residual(spark, d):
    """The residual stream of each registered layer class's output, single or tuple sum."""
    x = A.attach_pattern(fx.arch_states(spark, d)).where(F.col("pattern").isNotNull())
    res = A.residual("h", "r", "pattern")
    return x.select("vec_id", "layer_class", "pattern", r6(V.l2_norm(res)).alias("res_norm"),
                    r6(V.array_sum(res)).alias("res_sum"))


@query("arch_unregistered", "U3", with_views(
    """SELECT layer_class, count(*) AS n_rows FROM arch_states
       WHERE layer_class NOT IN (SELECT layer_class FROM arch_patterns) GROUP BY layer_class""",
    "arch_states", "arch_patterns"))
def q_arch_unregistered(spark, d):
    """Layer classes without a registered pattern and their row counts."""
    return A.unregistered(fx.arch_states(spark, d)).groupBy("layer_class").agg(F.count(F.lit(1)).alias("n_rows"))


_DIRS = """
    SELECT CAST(regexp_extract(key, '^layer_([0-9]+)$', 1) AS INT) AS layer, arg_max(vec, key) AS vec
    FROM directions_raw WHERE regexp_extract(key, '^layer_([0-9]+)$', 1) <> '' GROUP BY 1"""
_DELTAS = f"""
    SELECT layer, {Sq.vmap(Sq.vmap('vec', Sq.bf16), lambda x: Sq.bf16(f'({x} * CAST({STEER_ALPHA} AS FLOAT))'))} AS delta
    FROM dirs"""
_STEER = f"""
    SELECT s.vec_id, l.layer, p.pattern, s.h, s.r, dl.delta
    FROM arch_states s JOIN arch_patterns p ON s.layer_class = p.layer_class
    CROSS JOIN (SELECT unnest([{", ".join(map(str, STEER_LAYERS))}]) AS layer) l
    LEFT JOIN deltas dl ON dl.layer = l.layer"""
_CAPT = f"CASE pattern WHEN 'single' THEN h ELSE {_tuple_sum('h', 'r')} END"
_STEERED = (f"CASE WHEN delta IS NULL THEN {_CAPT} WHEN pattern = 'single' THEN "
            f"{Sq.zipmap('h', 'delta', lambda x, y: Sq.bf16(f'({x} + {y})'))} "
            f"ELSE {_tuple_sum('h', Sq.zipmap('r', 'delta', lambda x, y: Sq.bf16(f'({x} + {y})')))} END")


@query("steer_apply", "J6 V16 V17 V18 V19 U2", with_views(
    f"""SELECT vec_id, layer, pattern, round({Sq.norm(_CAPT)}, 6) AS captured_norm,
          round({Sq.norm(_STEERED)}, 6) AS steered_norm, delta IS NOT NULL AS is_steered
        FROM steer_in""",
    "arch_states", "arch_patterns", "directions_raw",
    extra=[("dirs", _DIRS), ("deltas", _DELTAS), ("steer_in", _STEER)]))
def q_steer_apply(spark, d):
    """Captured and steered residual norms at layers 16 and 32, directions scaled by 1.5 in bf16."""
    st = A.attach_pattern(fx.arch_states(spark, d)).where(F.col("pattern").isNotNull())
    st = st.select("vec_id", "pattern", "h", "r", F.explode(F.array(*[F.lit(x) for x in STEER_LAYERS])).alias("layer"))
    deltas = S.scaled_directions(S.parse_directions(fx.directions_raw(spark, d)), STEER_ALPHA)
    out = S.apply_steering(st, deltas)
    return out.select("vec_id", "layer", "pattern", r6(V.l2_norm("captured")).alias("captured_norm"),
                      r6(V.l2_norm("steered")).alias("steered_norm"), "is_steered")


@query("directions_parse", "S8 V26", with_views(
    f"SELECT layer, round({Sq.norm('vec')}, 6) AS dir_norm, CAST(len(vec) AS INT) AS dim FROM dirs",
    "directions_raw", extra=[("dirs", _DIRS)]))
def q_directions_parse(spark, d):
    """Steering directions keyed layer_<n>, one per layer, with norm and dimension."""
    x = S.parse_directions(fx.directions_raw(spark, d))
    return x.select("layer", r6(V.l2_norm("vec")).alias("dir_norm"), F.size("vec").alias("dim"))


# --------------------------------------------------------------------------- value forms and codecs

def _quant_sql(fn_list: str, extra_cols: str = "") -> str:
    return f"""SELECT vec_id, round({Sq.norm('q')}, 6) AS q_norm, round({Sq.vsum('q')}, 6) AS q_sum,
                 {Sq.n_changed('embedding', 'q')} AS n_changed{extra_cols}
               FROM (SELECT vec_id, embedding, {fn_list} AS q FROM embeddings) t"""


def _quant_spark(spark, d, qcol, extra=()):
    e = fx.table(spark, d, "embeddings")
    x = e.select("vec_id", "embedding", qcol.alias("q"))
    changed = F.aggregate(F.zip_with("embedding", "q", lambda a, b: F.when(a != b, 1).otherwise(0)),
                          F.lit(0), lambda acc, z: acc + z)
    return x.select("vec_id", r6(V.l2_norm("q")).alias("q_norm"), r6(V.array_sum("q")).alias("q_sum"),
                    changed.alias("n_changed"), *extra)


@query("quant_bf16", "V1", with_views(_quant_sql(Sq.vmap("embedding", Sq.bf16))))
def q_quant_bf16(spark, d):
    """bf16 value form of every embedding: norm, sum and number of changed elements (V1)."""
    return _quant_spark(spark, d, Q.bf16_vec("embedding"))


@query("quant_fp8", "V3", with_views(_quant_sql(Sq.fp8_vec("embedding"))))
def q_quant_fp8(spark, d):
    """float8 e4m3fn value form of every embedding: norm, sum and number of changed elements (V3)."""
    return _quant_spark(spark, d, Q.fp8_vec("embedding"))


_I8_SCALE = Sq.int8_scale("embedding")


@query("quant_int8", "V5 V6 V7", with_views(
    f"""SELECT vec_id, round({Sq.norm('q')}, 6) AS q_norm, round({Sq.vsum('q')}, 6) AS q_sum,
          {Sq.n_changed('embedding', 'q')} AS n_changed, round(CAST(scale AS DOUBLE), 9) AS scale
        FROM (SELECT vec_id, embedding, scale, {Sq.int8_value('embedding', 'scale')} AS q
              FROM (SELECT vec_id, embedding, {_I8_SCALE} AS scale FROM embeddings) s) t"""))
def q_quant_int8(spark, d):
    """int8 round trip of every embedding with its per-token scale (V5-V7)."""
    return _quant_spark(spark, d, Q.int8_value("embedding"),
                        extra=(r9(Q.int8_scale("embedding").cast("double")).alias("scale"),))


def _err_rows(dtype: str, qsql: str) -> str:
    return f"""SELECT '{dtype}' AS dtype, embedding AS x, {qsql} AS q FROM embeddings"""


@query("quant_error_by_dtype", "V1 V3 V6", with_views(
    f"""SELECT dtype, CAST(sum(len(x)) AS BIGINT) AS n_elems,
          round(sum(list_sum({Sq.zipmap('x', 'q', lambda a, b: f'abs(CAST({b} AS DOUBLE) - CAST({a} AS DOUBLE))')}))
                / sum(len(x)), 9) AS abs_err_mean,
          round(max(list_max({Sq.zipmap('x', 'q', lambda a, b: f'abs(CAST({b} AS DOUBLE) - CAST({a} AS DOUBLE))')})), 9)
            AS abs_err_max
        FROM (
          {_err_rows('bfloat16', Sq.vmap('embedding', Sq.bf16))}
          UNION ALL {_err_rows('float8_e4m3', Sq.fp8_vec('embedding'))}
          UNION ALL {_err_rows('int8', Sq.int8_value('embedding', _I8_SCALE))}) t
        GROUP BY dtype"""))
def q_quant_error_by_dtype(spark, d):
    """Mean and max absolute quantisation error per storage dtype over all embeddings (V1, V3, V6)."""
    e = fx.table(spark, d, "embeddings").select("embedding")
    forms = F.array(*[F.struct(F.lit(dt).alias("dtype"), Q.value_form("embedding", dt).alias("q"))
                      for dt in DTYPE_BYTES])
    x = e.select("embedding", F.inline(forms))
    err = V.abs_err("embedding", "q")
    t = x.select("dtype", F.size("embedding").alias("n"), V.array_sum(err).alias("s"), V.array_max(err).alias("m"))
    return t.groupBy("dtype").agg(F.sum("n").cast("bigint").alias("n_elems"),
                                  r9(F.sum("s") / F.sum("n")).alias("abs_err_mean"), r9(F.max("m")).alias("abs_err_max"))


def _value_rows(dtype: str, qsql: str) -> str:
    return f"SELECT vec_id, '{dtype}' AS dtype, {qsql} AS q FROM embeddings"


@query("codec_roundtrip", "V2 V4 V8 V9", with_views(
    f"""SELECT vec_id, dtype, round({Sq.norm('q')}, 6) AS dec_norm, round({Sq.vsum('q')}, 6) AS dec_sum,
          CAST(len(q) AS INT) AS dim
        FROM ({_value_rows('bfloat16', Sq.vmap('embedding', Sq.bf16))}
              UNION ALL {_value_rows('float8_e4m3', Sq.fp8_vec('embedding'))}
              UNION ALL {_value_rows('int8', Sq.int8_value('embedding', _I8_SCALE))}) t"""))
def q_codec_roundtrip(spark, d):
    """Every embedding encoded to bytes and decoded in each dtype (V2, V4, V8, V9)."""
    e = fx.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    enc = None
    for dt in DTYPE_BYTES:
        part = encode_activations(e, dt)
        enc = part if enc is None else enc.unionByName(part)
    dec = decode_activations(enc)
    return dec.select("vec_id", "dtype", r6(V.l2_norm("vec")).alias("dec_norm"),
                      r6(V.array_sum("vec")).alias("dec_sum"), F.size("vec").alias("dim"))


@query("payload_audit", "P13", with_views(
    """SELECT run_id, CASE WHEN wrong = 3 THEN 'float4' ELSE dtype END AS dtype, count(*) AS n_rows,
          count(*) FILTER (WHERE wrong = 1) AS n_bad_length,
          count(*) FILTER (WHERE wrong = 2 OR (wrong = 3 AND dtype = 'int8')) AS n_bad_scale,
          count(*) FILTER (WHERE wrong = 3) AS n_bad_dtype
        FROM (SELECT run_id, dtype, CASE WHEN token_pos = 0 AND prompt_id % 9 = 4 THEN 1 WHEN token_pos = 0 AND prompt_id % 9 = 5 THEN 2
                WHEN token_pos = 0 AND prompt_id % 9 = 6 THEN 3 ELSE 0 END AS wrong
              FROM vectors CROSS JOIN (VALUES ('bfloat16'), ('float8_e4m3'), ('int8')) d(dtype)) q
        GROUP BY ALL""", "vectors"))
def q_payload_audit(spark, d):
    """Payload length, scale and dtype checks of both runs encoded in each dtype, with damaged rows among them."""
    v = fx.vectors(spark, d)
    enc = None
    for dt in DTYPE_BYTES:
        part = encode_activations(v, dt)
        enc = part if enc is None else enc.unionByName(part)
    # damage as a faulty writer leaves it: a payload cut short, a scale lost or made up, a dtype unknown
    first, kind = F.col("token_pos") == 0, F.col("prompt_id") % 9
    cut = F.expr("substring(payload, 1, octet_length(payload) - 1)")
    enc = enc.withColumn("payload", F.when(first & (kind == 4), cut).otherwise(F.col("payload"))) \
        .withColumn("scale", F.when(first & (kind == 5), F.when(F.col("scale").isNull(), F.lit(1.0).cast("float")))
                    .otherwise(F.col("scale"))) \
        .withColumn("dtype", F.when(first & (kind == 6), F.lit("float4")).otherwise(F.col("dtype")))
    return payload_audit(enc, D_MODEL)


@query("capture_batch_report", "P6 (dropped-batch counts)", with_views(
    f"""SELECT count(*) FILTER (WHERE NOT any_null) AS n_prefill_batches,
          count(*) FILTER (WHERE any_null) AS n_dropped_batches,
          count(*) FILTER (WHERE short_rids AND NOT no_lens) AS n_length_mismatch
        FROM batches WHERE global_rank % {ROUTING_TP} = 0""", "capture_seqs", extra=[("batches", _BATCHES)]))
def q_capture_batch_report(spark, d):
    """Kept and dropped capture batches of the capturing replicas (tp = 4)."""
    return D.batch_report(fx.capture_batches(spark, d), tp_size=ROUTING_TP)


@query("replica_markers", "K6", with_views(
    f"""SELECT 'capture' AS run_id, CAST(floor(coalesce(gpu_id, 0) / {ROUTING_TP}) AS INT) AS dp_rank,
          {ROUTING_TP} AS tp_size, {D_MODEL} AS d_model, count(*) AS n_batches
        FROM batches GROUP BY 2""", "capture_seqs", extra=[("batches", _BATCHES)]))
def q_replica_markers(spark, d):
    """One start-marker row per data-parallel replica seen in the capture batches."""
    from ..config import RunConfig
    from ..sinks.tables import replica_markers
    cfg = RunConfig(run_id="capture", layers=(16,), tp_size=ROUTING_TP)
    return replica_markers(fx.capture_batches(spark, d), cfg, D_MODEL).select("run_id", "dp_rank", "tp_size", "d_model", "n_batches")
