"""Queries comparing two runs, and the replica audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vec as V
from ..operators import compare as C
from ..operators.replicas import dedup_replicas, replica_duplicates
from ..sources import fixtures as fx
from . import sqlfrag as Sq
from .registry import query
from .views_sql import with_views

RUN_A, RUN_B = "base", "variant"
COMPLETION = 0
DRIFT_BUCKET = 4


def r6(c):
    return F.round(c, 6)


def _runs(spark, d):
    v = fx.vectors(spark, d)
    return (C.run_slice(v, RUN_A, completion_idx=COMPLETION), C.run_slice(v, RUN_B, completion_idx=COMPLETION))


_A = f"(SELECT * FROM vectors WHERE run_id = '{RUN_A}' AND completion_idx = {COMPLETION})"
_B = f"(SELECT * FROM vectors WHERE run_id = '{RUN_B}' AND completion_idx = {COMPLETION})"
_SHAPES = f"""
    SELECT a.layer, a.prompt_id, a.completion_idx, a.n_a, b.n_b, a.d_a, b.d_b,
           (a.n_a = b.n_b AND a.d_a = b.d_b) AS shape_match
    FROM (SELECT layer, prompt_id, completion_idx, CAST(count(*) AS INT) AS n_a, CAST(max(len(vec)) AS INT) AS d_a FROM {_A} x
          GROUP BY ALL) a
    JOIN (SELECT layer, prompt_id, completion_idx, CAST(count(*) AS INT) AS n_b, CAST(max(len(vec)) AS INT) AS d_b FROM {_B} y
          GROUP BY ALL) b
      ON a.layer = b.layer AND a.prompt_id = b.prompt_id AND a.completion_idx = b.completion_idx"""
_PAIRS = f"""
    SELECT a.layer, a.prompt_id, a.completion_idx, a.token_pos, a.vec AS a, b.vec AS b
    FROM {_A} a JOIN {_B} b ON a.layer = b.layer AND a.prompt_id = b.prompt_id
      AND a.completion_idx = b.completion_idx AND a.token_pos = b.token_pos
    JOIN shapes s ON s.layer = a.layer AND s.prompt_id = a.prompt_id AND s.completion_idx = a.completion_idx
    WHERE s.shape_match"""
_CMP_EXTRA = [("shapes", _SHAPES), ("pairs", _PAIRS)]


@query("run_keys_common", "J2 T2 P14", with_views(
    f"""SELECT layer, prompt_id, completion_idx FROM {_A} a INTERSECT
        SELECT layer, prompt_id, completion_idx FROM {_B} b""", "vectors"))
def q_run_keys_common(spark, d):
    """Sequence keys present in both runs."""
    a, b = _runs(spark, d)
    return C.common_keys(a, b)


@query("compare_shapes", "A7 P16", with_views(
    "SELECT * FROM shapes", "vectors", extra=[("shapes", _SHAPES)]))
def q_compare_shapes(spark, d):
    """Token count and vector dimension of each common sequence in both runs, with a match flag."""
    a, b = _runs(spark, d)
    return C.shapes(a, b)


_COS = Sq.cosine("a", "b")
_REL = Sq.zipmap("a", "b", lambda x, y: f"abs(CAST({x} AS DOUBLE) - CAST({y} AS DOUBLE)) / (abs(CAST({x} AS DOUBLE)) + 1e-6)")
_ABS = Sq.zipmap("a", "b", lambda x, y: f"abs(CAST({x} AS DOUBLE) - CAST({y} AS DOUBLE))")


@query("compare_metrics", "J3 V11 V12 V13 A6", with_views(
    f"""SELECT t.layer, t.prompt_id, t.completion_idx, t.n_tokens, round(t.cos_mean, 6) AS cos_mean,
          round(t.cos_min, 6) AS cos_min, round(t.cos_median, 6) AS cos_median,
          round(t.abs_mean, 6) AS abs_mean, round(t.abs_max, 6) AS abs_max, round(t.rel_mean, 6) AS rel_mean,
          round(m.rel_median, 6) AS rel_median, round(t.norm_a_mean, 6) AS norm_a_mean,
          round(t.norm_b_mean, 6) AS norm_b_mean, round(t.norm_a_mean / t.norm_b_mean, 6) AS norm_ratio
        FROM (SELECT layer, prompt_id, completion_idx, CAST(count(*) AS INT) AS n_tokens,
                avg(cos) AS cos_mean, min(cos) AS cos_min, quantile_disc(cos, 0.5) AS cos_median,
                sum(abs_sum) / sum(d) AS abs_mean, max(abs_max) AS abs_max, sum(rel_sum) / sum(d) AS rel_mean,
                avg(na) AS norm_a_mean, avg(nb) AS norm_b_mean
              FROM (SELECT *, {_COS} AS cos, list_sum({_ABS}) AS abs_sum, list_max({_ABS}) AS abs_max,
                      list_sum({_REL}) AS rel_sum, len(a) AS d, {Sq.norm('a')} AS na, {Sq.norm('b')} AS nb
                    FROM pairs) q GROUP BY ALL) t
        JOIN (SELECT layer, prompt_id, completion_idx, quantile_disc(rel, 0.5) AS rel_median
              FROM (SELECT layer, prompt_id, completion_idx, unnest({_REL}) AS rel FROM pairs) e GROUP BY ALL) m
          ON t.layer = m.layer AND t.prompt_id = m.prompt_id AND t.completion_idx = m.completion_idx""",
    "vectors", extra=_CMP_EXTRA))
def q_compare_metrics(spark, d):
    """Per-sequence cosine, absolute / relative error and norm metrics of shape-matched pairs, exact lower medians."""
    a, b = _runs(spark, d)
    m = C.pair_metrics(C.token_pairs(a, b))
    cols = ["cos_mean", "cos_min", "cos_median", "abs_mean", "abs_max", "rel_mean", "rel_median",
            "norm_a_mean", "norm_b_mean", "norm_ratio"]
    return m.select("layer", "prompt_id", "completion_idx", "n_tokens", *[r6(F.col(c)).alias(c) for c in cols])


@query("compare_positions", "W5", with_views(
    f"""SELECT p.layer, p.prompt_id, p.completion_idx, p.token_pos, round({_COS}, 6) AS cos,
          round({Sq.norm('a')}, 6) AS norm_a, round({Sq.norm('b')}, 6) AS norm_b
        FROM pairs p JOIN (
          SELECT DISTINCT layer, prompt_id, completion_idx, unnest([0, 1, 5, n // 4, n // 2, 3 * n // 4, n - 5, n - 1]) AS pos, n
          FROM (SELECT layer, prompt_id, completion_idx, count(*) AS n FROM pairs GROUP BY ALL) c) s
          ON p.layer = s.layer AND p.prompt_id = s.prompt_id AND p.completion_idx = s.completion_idx
         AND p.token_pos = s.pos
        WHERE s.pos >= 0 AND s.pos < s.n""", "vectors", extra=_CMP_EXTRA))
def q_compare_positions(spark, d):
    """Cosine and norms at the sampled token positions of each shape-matched sequence."""
    a, b = _runs(spark, d)
    t = C.position_samples(C.token_pairs(a, b))
    return t.select("layer", "prompt_id", "completion_idx", "token_pos", r6(F.col("cos")).alias("cos"),
                    r6(F.col("norm_a")).alias("norm_a"), r6(F.col("norm_b")).alias("norm_b"))


@query("compare_shift", "J4 W6 A8", with_views(
    f"""SELECT a.layer, a.prompt_id, a.completion_idx, round(avg({Sq.cosine('a.vec', 'b.vec')}), 6) AS cos_shift
        FROM {_A} a JOIN {_B} b ON a.layer = b.layer AND a.prompt_id = b.prompt_id
          AND a.completion_idx = b.completion_idx AND b.token_pos = a.token_pos + 1
        JOIN shapes s ON s.layer = a.layer AND s.prompt_id = a.prompt_id AND s.completion_idx = a.completion_idx
        WHERE s.shape_match AND s.n_a > 1 GROUP BY ALL""", "vectors", extra=[("shapes", _SHAPES)]))
def q_compare_shift(spark, d):
    """Mean cosine of a[t] with b[t+1] per shape-matched sequence of more than one token."""
    a, b = _runs(spark, d)
    x = C.shift_check(a, b)
    return x.select("layer", "prompt_id", "completion_idx", r6(F.col("cos_shift")).alias("cos_shift"))


@query("drift_by_position", "A12", with_views(
    f"""SELECT layer, CAST(floor(token_pos / {DRIFT_BUCKET}) * {DRIFT_BUCKET} AS INT) AS pos_bucket,
          count(*) AS n_tokens, round(avg(cos), 6) AS cos_mean, round(min(cos), 6) AS cos_min
        FROM (SELECT *, {_COS} AS cos FROM pairs) q GROUP BY ALL""", "vectors", extra=_CMP_EXTRA))
def q_drift_by_position(spark, d):
    """Cosine by token-position bucket over all shape-matched pairs."""
    a, b = _runs(spark, d)
    x = C.drift_by_position(C.token_pairs(a, b), DRIFT_BUCKET)
    return x.select("layer", "pos_bucket", "n_tokens", r6(F.col("cos_mean")).alias("cos_mean"),
                    r6(F.col("cos_min")).alias("cos_min"))


@query("zero_ranges", "A11", with_views(
    f"""SELECT run_id, layer, prompt_id, completion_idx, min(token_pos) AS start_pos, max(token_pos) AS end_pos,
          CAST(count(*) AS INT) AS n_zero
        FROM (SELECT *, token_pos - row_number() OVER (PARTITION BY run_id, layer, prompt_id, completion_idx
                ORDER BY token_pos) AS island
              FROM vectors WHERE {Sq.norm('vec')} = 0) z
        GROUP BY run_id, layer, prompt_id, completion_idx, island""", "vectors"))
def q_zero_ranges(spark, d):
    """Contiguous all-zero token ranges per stored sequence."""
    return C.zero_ranges(fx.vectors(spark, d))


@query("run_diff", "J5 V20", with_views(
    f"""SELECT layer, prompt_id, completion_idx, token_pos,
          round({Sq.norm(Sq.zipmap('b', 'a', lambda y, x: f'({y} - {x})'))}, 6) AS delta_norm,
          round({Sq.vsum(Sq.zipmap('b', 'a', lambda y, x: f'({y} - {x})'))}, 6) AS delta_sum
        FROM pairs""", "vectors", extra=_CMP_EXTRA))
def q_run_diff(spark, d):
    """Per-token difference variant - base for shape-matched sequences, as norm and sum."""
    a, b = _runs(spark, d)
    x = C.run_diff(a, b)
    return x.select("layer", "prompt_id", "completion_idx", "token_pos", r6(V.l2_norm("delta")).alias("delta_norm"),
                    r6(V.array_sum("delta")).alias("delta_sum"))


@query("replica_duplicates", "A13 R7", with_views(
    """SELECT run_id, layer, prompt_id, completion_idx, count(DISTINCT dp_rank) AS n_replicas, list_sort(list(DISTINCT dp_rank)) AS replicas
       FROM replica_rows GROUP BY run_id, layer, prompt_id, completion_idx HAVING count(DISTINCT dp_rank) > 1""", "replica_rows"))
def q_replica_duplicates(spark, d):
    """Sequences captured by more than one data-parallel replica."""
    return replica_duplicates(fx.replica_rows(spark, d))


@query("replica_dedup", "R7", with_views(
    f"""SELECT layer, prompt_id, completion_idx, token_pos, min(dp_rank) AS dp_rank, round(min({Sq.norm('vec')}), 6) AS norm
        FROM replica_rows GROUP BY layer, prompt_id, completion_idx, token_pos""", "replica_rows"))
def q_replica_dedup(spark, d):
    """One copy per token key across replicas, the lowest replica rank."""
    x = dedup_replicas(fx.replica_rows(spark, d))
    return x.select("layer", "prompt_id", "completion_idx", "token_pos", "dp_rank", r6(V.l2_norm("vec")).alias("norm"))
