"""Prompt and rollout operators.

All are keyed on ``prompt_id`` and plan as partial (map-side) aggregates
followed by one shuffle on the key; the join lets AQE pick broadcast or
sort-merge from runtime sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import GuardError, require_empty


def prompt_conflicts(raw: DataFrame) -> DataFrame:
    """A1 report: prompt ids whose files disagree on the text."""
    return (raw.groupBy("prompt_id")
            .agg(F.count_distinct("prompt").alias("n_texts"), F.count(F.lit(1)).alias("n_rows"))
            .where(F.col("n_texts") > 1))


def merge_prompts(raw: DataFrame, on_conflict: str = "error") -> DataFrame:
    """A1: one row per prompt id; identical repeats collapse.

    ``on_conflict``: ``error`` raises when any id has two different texts
    (checked by its own small action), ``drop`` leaves such ids out.
    A conflict is ``min(text) != max(text)``, which needs no distinct count.
    """
    if on_conflict not in ("error", "drop"):
        raise GuardError(f"on_conflict must be 'error' or 'drop', got {on_conflict!r}")
    g = raw.groupBy("prompt_id").agg(F.min("prompt").alias("prompt"), F.max("prompt").alias("_pmax"))
    bad = F.col("prompt") != F.col("_pmax")
    if on_conflict == "error":
        try:
            require_empty(g.where(bad).select("prompt_id"), "one prompt id has several texts")
        except GuardError as e:
            raise GuardError(str(e)) from None
        return g.drop("_pmax")
    return g.where(~bad).drop("_pmax")


def last_rollout(raw: DataFrame, completion_idx: int = 0) -> DataFrame:
    """P10 + A2: the chosen rollout per prompt; the last row in (file, line) order wins."""
    order = F.struct(F.col("src_ord"), F.col("line_ord"))
    return (raw.where(F.col("completion_idx") == completion_idx)
            .groupBy("prompt_id")
            .agg(F.max_by("text", order).alias("completion"))
            .select("prompt_id", F.lit(completion_idx).alias("completion_idx"), "completion"))


def join_pairs(prompts: DataFrame, rollouts: DataFrame) -> DataFrame:
    """Prompts with their chosen rollout (inner join on prompt id)."""
    return prompts.join(rollouts, "prompt_id", "inner")


def common_prompt_ids(prompts: DataFrame, rollouts: DataFrame) -> DataFrame:
    """Prompt ids present on both sides."""
    return prompts.select("prompt_id").intersect(rollouts.select("prompt_id"))


def first_n(pairs: DataFrame, n: int) -> DataFrame:
    """O2: the ``n`` smallest prompt ids (0 = all; negative rejected)."""
    if n < 0:
        raise GuardError(f"limit must be >= 0, got {n}")
    if n == 0:
        return pairs
    return pairs.orderBy("prompt_id").limit(n)
