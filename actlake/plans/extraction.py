"""The extraction plan: what will be captured and how long each sequence is.

prompts + completions -> merge (A1) -> last rollout (A2, P10) -> join (J1)
-> limit (O2) -> chat render (V22, V29) -> tokenise (V23) -> truncate (P8)
-> rid (P1) -> plan rows (V24, K2), plus the run summary (A9), progress
(W7), storage sizing (A10) and the minimum-length rule (P9).

The plan itself is lazy and shuffles only at the prompt-id aggregates and the
join; the guards (prompt conflicts, empty plan) run as their own small actions,
and the progress report samples its order-key bounds once.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..config import DTYPE_BYTES, GuardError, RunConfig, require_nonempty
from ..functions import text as tx
from ..operators.prompts import first_n, join_pairs, last_rollout, merge_prompts
from ..operators.windows import running_sums
from ..session import stored


def pairs(prompts_raw: DataFrame, completions_raw: DataFrame, cfg: RunConfig,
          on_conflict: str = "error") -> DataFrame:
    """(prompt_id, prompt, completion_idx, completion) for the chosen rollout."""
    p = merge_prompts(prompts_raw, on_conflict)
    r = last_rollout(completions_raw, cfg.completion_idx)
    return first_n(join_pairs(p, r), cfg.limit)


def sequences(pairs_df: DataFrame, cfg: RunConfig, system: str | Column | None = None,
              template: tx.ChatTemplate = tx.CHATML,
              tokenizer: Callable | None = None) -> DataFrame:
    """``sequences``: rendered text, token ids after truncation and the flags.

    ``system`` may be one string for the run or a column per prompt.
    ``tokenizer`` is a factory for a pluggable tokenizer (U4); by default the
    native whitespace tokenizer runs in the JVM.
    """
    sys_arg = system if system is not None else cfg.system_prompt
    df = pairs_df.select(
        "prompt_id", F.col("completion_idx").cast("int").alias("completion_idx"),
        tx.render_chat("prompt", "completion", sys_arg, template).alias("input_text"))
    if tokenizer is None:
        toks = tx.whitespace_tokens("input_text")
        df = df.withColumn("_n_full", F.size(toks)).withColumn(
            "input_ids", tx.whitespace_ids_from_tokens(tx.truncate_ids(toks, cfg.max_tokens)))
    else:
        df = tx.tokenize_with(df, "input_text", tokenizer, "_ids_full")
        df = (df.withColumn("_n_full", F.size("_ids_full"))
              .withColumn("input_ids", tx.truncate_ids("_ids_full", cfg.max_tokens)).drop("_ids_full"))
    return df.select(
        tx.build_rid("prompt_id", "completion_idx").alias("rid"), "prompt_id", "completion_idx",
        "input_text", "input_ids", F.size("input_ids").cast("int").alias("n_tokens"),
        (F.col("_n_full") > cfg.max_tokens).alias("was_truncated"))


def plan_rows(seqs: DataFrame) -> DataFrame:
    """K2: one ``(rid, n_tokens)`` row per planned sequence."""
    return seqs.select("rid", "n_tokens")


def ordered_plan(seqs: DataFrame) -> DataFrame:
    """O1: plan rows in prompt order (then rollout); written, file names and lines follow it."""
    narrow = seqs.select("prompt_id", "completion_idx", "rid", "n_tokens")
    return plan_rows(narrow.orderBy("prompt_id", "completion_idx"))


def keep_min_length(seqs: DataFrame, min_tokens: int) -> DataFrame:
    """Drop sequences shorter than ``min_tokens`` (0 keeps all)."""
    if min_tokens <= 0:
        return seqs
    return seqs.where(F.col("n_tokens") >= min_tokens)


def guard_plan(seqs: DataFrame) -> None:
    """An empty plan is an error."""
    require_nonempty(seqs.select("rid"), "the plan is empty; prompts and rollouts share no id")


def run_summary(seqs: DataFrame, cfg: RunConfig, n_shards: int | Column = 1,
                elapsed_s: float | None = None) -> DataFrame:
    """Pairs, truncated, skipped, total tokens (of kept sequences), shards."""
    return with_rate(seqs.agg(*plan_totals(cfg)), n_shards, elapsed_s)


def plan_totals(cfg: RunConfig) -> list[Column]:
    """The totals of a plan, as aggregates of its sequences."""
    skipped = F.col("n_tokens") < F.lit(cfg.min_tokens)
    return [F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("was_truncated")).alias("n_truncated"), F.count_if(skipped).alias("n_skipped"),
            F.coalesce(F.sum(F.when(~skipped, F.col("n_tokens"))), F.lit(0)).cast("bigint").alias("total_tokens")]


def observed_plan(seqs: DataFrame, cfg: RunConfig) -> tuple[DataFrame, DataFrame]:
    """(planned sequences without their texts and tokens, their totals) from one execution of the plan.

    The narrow rows are written when this is called and counted on their way (``DataFrame.observe``); an empty plan is an error (P15).
    """
    seen = Observation("plan")
    narrow = seqs.select("prompt_id", "completion_idx", "rid", "n_tokens", "was_truncated").observe(seen, *plan_totals(cfg))
    planned = stored(narrow, "planned")
    totals = seen.get
    if not totals["n_pairs"]:
        raise GuardError("the plan is empty; prompts and rollouts share no id")
    row = [tuple(totals[c] for c in ("n_pairs", "n_truncated", "n_skipped", "total_tokens"))]
    return planned, seqs.sparkSession.createDataFrame(row, "n_pairs long, n_truncated long, n_skipped long, total_tokens long")


def with_rate(out: DataFrame, n_shards: int | Column = 1, elapsed_s: float | None = None) -> DataFrame:
    """A plan's totals with shards and, if the seconds are given, tokens per second."""
    out = out.withColumn("n_shards", n_shards if isinstance(n_shards, Column) else F.lit(int(n_shards)))
    if elapsed_s is not None:
        out = (out.withColumn("elapsed_s", F.lit(float(elapsed_s)))
               .withColumn("tok_per_s", F.col("total_tokens") / F.greatest(F.lit(float(elapsed_s)), F.lit(1e-3))))
    return out


def running_progress(seqs: DataFrame, cfg: RunConfig, every: int = 10) -> DataFrame:
    """Tokens so far at every ``every``-th sequence and at the last one.

    Sequences run in prompt-id order; skipped sequences print no line and
    add no tokens. The running sum is split by key ranges (no single task).
    """
    skipped = F.col("n_tokens") < F.lit(cfg.min_tokens)
    x = seqs.select("prompt_id", F.when(skipped, F.lit(0)).otherwise(F.col("n_tokens")).alias("_kept"),
                    skipped.alias("_skipped"))
    x = running_sums(x, "prompt_id", {"tokens_so_far": "_kept"}, row_number_col="seq_no", total_count_col="_n")
    return (x.where(((F.col("seq_no") % every == 0) | (F.col("seq_no") == F.col("_n"))) & ~F.col("_skipped"))
            .select("seq_no", "prompt_id", F.col("tokens_so_far").cast("bigint").alias("tokens_so_far")))


def storage_sizing(seqs: DataFrame, n_layers: int, d_model: int) -> DataFrame:
    """A10 + V25: bytes on disk per storage dtype for the planned tokens."""
    if n_layers <= 0 or d_model <= 0:
        raise GuardError("n_layers and d_model must be positive")
    tot = seqs.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).cast("bigint").alias("total_tokens"))
    table = F.array(*[F.struct(F.lit(k).alias("dtype"), F.lit(v).alias("bytes_per_elem"),
                               F.lit(4 if k == "int8" else 0).alias("scale_bytes"))
                      for k, v in DTYPE_BYTES.items()])
    x = tot.select("total_tokens", F.inline(table))
    per_token = F.lit(d_model) * F.col("bytes_per_elem") + F.col("scale_bytes")
    return x.select("dtype", "bytes_per_elem", "total_tokens",
                    (F.col("total_tokens") * F.lit(n_layers) * per_token).cast("bigint").alias("est_bytes"))
