"""Steering (S8, V26, V18, J6, V16-V19).

Directions arrive as ``(key, vec)`` rows named like a tensor file
(``layer_<n>``); other keys are ignored. Each direction is cast to bf16,
scaled by alpha (bf16 result) once in the small table, then attached by
layer with a left join (layers without a direction pass unchanged). The
captured vector at a steered layer is the unsteered one; the steered
residual is what later layers see.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quant import bf16_vec
from ..functions.text import layer_from_key
from ..functions.vec import vec_scale
from .arch import residual, steer_outputs
from .joins import size_checked_broadcast


def parse_directions(raw: DataFrame) -> DataFrame:
    """S8 + V26: keep ``layer_<int>`` keys; one direction per layer (last key wins)."""
    x = raw.select(layer_from_key("key").alias("layer"), "key", "vec").where(F.col("layer").isNotNull())
    return x.groupBy("layer").agg(F.max_by("vec", "key").alias("vec"))


def scaled_directions(dirs: DataFrame, alpha: float) -> DataFrame:
    """bf16 first, then times alpha with a bf16 result."""
    return dirs.select("layer", bf16_vec(vec_scale(bf16_vec("vec"), alpha)).alias("delta"))


def apply_steering(states: DataFrame, deltas: DataFrame, h_col: str = "h", r_col: str = "r",
                   pattern_col: str = "pattern") -> DataFrame:
    """J6 + V19: ``captured`` (before steering) and ``steered`` residual per row."""
    d = size_checked_broadcast(deltas, F.lit(32) + F.size("delta") * F.lit(4))
    x = states.join(d, "layer", "left")
    h2, r2 = steer_outputs(h_col, r_col, pattern_col, "delta")
    captured = residual(h_col, r_col, pattern_col)
    steered = F.when(F.col("delta").isNull(), captured).otherwise(residual(h2, r2, pattern_col))
    return x.withColumn("captured", captured).withColumn("steered", steered) \
            .withColumn("is_steered", F.col("delta").isNotNull()).drop("delta")
