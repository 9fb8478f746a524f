"""Read-back checks.

Token-level inputs are reduced per sequence first (partial aggregation),
so only one small row per sequence is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import bytes_per_elem_col, require_empty
from ..functions.vecops import token_stats

SEQ_KEY = ("run_id", "layer", "prompt_id", "completion_idx")


def payload_audit(acts: DataFrame, d_model: int, group=("run_id", "dtype")) -> DataFrame:
    """Payload length = d x bytes per element; scale present iff int8."""
    bpe = bytes_per_elem_col(F.col("dtype"))
    bad_len = F.octet_length("payload") != F.lit(d_model) * bpe
    bad_scale = (F.col("scale").isNotNull()) != (F.col("dtype") == "int8")
    bad_dtype = bpe.isNull()
    return acts.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(bad_len | F.col("payload").isNull()).alias("n_bad_length"),
        F.count_if(bad_scale).alias("n_bad_scale"),
        F.count_if(bad_dtype).alias("n_bad_dtype"))


def require_valid_payloads(acts: DataFrame, d_model: int) -> None:
    """P13 guard, run as its own action before a write."""
    bpe = bytes_per_elem_col(F.col("dtype"))
    bad = (bpe.isNull() | (F.octet_length("payload") != F.lit(d_model) * bpe)
           | ((F.col("scale").isNotNull()) != (F.col("dtype") == "int8")))
    require_empty(acts.where(bad).select("layer", "prompt_id", "completion_idx", "token_pos", "dtype"),
                  "payload does not match dtype / d_model")


def reconcile(index: DataFrame, acts: DataFrame, d_model: int, manifest_layers: DataFrame | None = None,
              group=("run_id", "layer"), check_bytes: bool = False) -> DataFrame:
    """A4 + J10: sequences and tokens per layer from the index vs what is stored.

    By default stored tokens are counted from rows (key columns only; Parquet
    answers from metadata without reading payloads). With ``check_bytes`` the
    reference rule is applied to the payload bytes:
    ``sum(bytes) div (d x bytes per element)``, and the remainder is reported
    as ``torn_bytes``. Status is ``ok`` or ``MISMATCH``; index layers missing
    from the manifest are reported as ``unindexed_layer`` instead of failing.
    """
    idx = index.groupBy(*group).agg(F.count(F.lit(1)).alias("n_sequences"),
                                    F.sum("n_tokens").cast("bigint").alias("tokens_index"))
    if check_bytes:
        bpe = bytes_per_elem_col(F.col("dtype"))
        # one (run, layer) may hold several dtypes: bytes count per dtype, then per group
        st = acts.groupBy(*group, bpe.alias("_bpe")).agg(F.sum(F.octet_length("payload")).cast("bigint").alias("_bytes"))
        row = F.lit(d_model) * F.col("_bpe")
        st = st.groupBy(*group).agg(F.sum(F.floor(F.col("_bytes") / row)).cast("bigint").alias("tokens_stored"),
                                    F.sum(F.col("_bytes") % row).cast("bigint").alias("torn_bytes"))
    else:
        st = acts.groupBy(*group).agg(F.count(F.lit(1)).cast("bigint").alias("tokens_stored"),
                                      F.lit(0).cast("bigint").alias("torn_bytes"))
    x = idx.join(st, list(group), "full_outer").select(
        *group, F.coalesce("n_sequences", F.lit(0)).alias("n_sequences"),
        F.coalesce("tokens_index", F.lit(0)).alias("tokens_index"),
        F.coalesce("tokens_stored", F.lit(0)).alias("tokens_stored"),
        F.coalesce("torn_bytes", F.lit(0)).alias("torn_bytes"))
    status = F.when((F.col("tokens_index") == F.col("tokens_stored")) & (F.col("torn_bytes") == 0),
                    F.lit("ok")).otherwise(F.lit("MISMATCH"))
    if manifest_layers is not None:
        known = manifest_layers.select(*group).withColumn("_known", F.lit(True))
        x = x.join(known, list(group), "left")
        status = F.when(F.col("_known").isNull(), F.lit("unindexed_layer")).otherwise(status)
        return x.withColumn("status", status).drop("_known")
    return x.withColumn("status", status)


def norm_health(vectors: DataFrame, key=SEQ_KEY) -> DataFrame:
    """A5: per sequence mean / min / max L2 norm and any NaN (NaN propagates).

    Takes decoded ``vec`` rows or stored payload rows (decoded in the same pass)."""
    vcols = ["vec"] if "vec" in vectors.columns else ["payload", "dtype", "scale"]
    x = token_stats(vectors.select(*key, *vcols)).select(*key, F.col("norm").alias("_n"), F.col("has_nan").alias("_nan"))
    g = x.groupBy(*key).agg(F.count(F.lit(1)).cast("int").alias("n_tokens"),
                            F.avg("_n").alias("norm_mean"), F.min("_n").alias("_min"),
                            F.max("_n").alias("norm_max"), F.bool_or("_nan").alias("any_nan"))
    nan = F.lit(float("nan"))
    return g.select(*key, "n_tokens",
                    F.when(F.col("any_nan"), nan).otherwise(F.col("norm_mean")).alias("norm_mean"),
                    F.when(F.col("any_nan"), nan).otherwise(F.col("_min")).alias("norm_min"),
                    F.when(F.col("any_nan"), nan).otherwise(F.col("norm_max")).alias("norm_max"),
                    "any_nan")


def first_k_sequences(index: DataFrame, k: int = 3, group=("run_id", "layer"), order_col: str = "append_ord") -> DataFrame:
    """The first ``k`` sequences per layer in index order (group limit
    keeps only k rows per task before the shuffle)."""
    w = Window.partitionBy(*group).orderBy(order_col)
    return index.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def duplicate_keys(index: DataFrame, key=("prompt_id", "completion_idx", "layer"),
                   order_col: str = "append_ord") -> DataFrame:
    """Keys with more than one index row; first and last start."""
    return (index.groupBy(*key)
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.min_by("start", order_col).alias("first_start"),
                 F.max_by("start", order_col).alias("last_start"))
            .where(F.col("n_rows") > 1))


def resolve_duplicates(index: DataFrame, key=("prompt_id", "completion_idx", "layer"),
                       order_col: str = "append_ord", policy: str = "first") -> DataFrame:
    """One index row per key - the first appended (reader rule) or the last (re-run)."""
    o = F.col(order_col).asc() if policy == "first" else F.col(order_col).desc()
    w = Window.partitionBy(*key).orderBy(o)
    return index.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def plan_vs_index(plan: DataFrame, index: DataFrame, key=("prompt_id", "completion_idx")) -> DataFrame:
    """Reconcile the plan with what was written.

    status: ok, missing (planned, not written), unplanned (written, not
    planned), length_mismatch; ``n_index_rows`` > 1 shows duplicates.
    """
    ix = index.groupBy(*key).agg(F.count(F.lit(1)).alias("n_index_rows"),
                                 F.sum("n_tokens").cast("bigint").alias("index_tokens"))
    p = plan.select(*key, F.col("n_tokens").cast("bigint").alias("plan_tokens"))
    x = p.join(ix, list(key), "full_outer")
    status = (F.when(F.col("index_tokens").isNull(), F.lit("missing"))
              .when(F.col("plan_tokens").isNull(), F.lit("unplanned"))
              .when(F.col("plan_tokens") != F.col("index_tokens"), F.lit("length_mismatch"))
              .otherwise(F.lit("ok")))
    return x.select(*key, "plan_tokens", "index_tokens",
                    F.coalesce("n_index_rows", F.lit(0)).alias("n_index_rows"), status.alias("status"))
