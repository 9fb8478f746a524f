"""Queries over prompts, rollouts and the extraction plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import RunConfig
from ..operators import prompts as P
from ..plans import extraction as X
from ..sources import fixtures as fx
from .registry import query
from .views_sql import with_views

# Parameters of the planning queries.
PLAN_CFG = RunConfig(model="stand-in", layers=(16, 32), completion_idx=0, limit=0,
                     max_tokens=256, min_tokens=64)
FIRST_N = 25
SIZING_LAYERS, SIZING_D_MODEL = 5, 5120

_TOK_N = "len(regexp_extract_all(input_text, '\\S+'))"


def _pairs(spark, d):
    return X.pairs(fx.prompts_clean(spark, d), fx.completions_raw(spark, d), PLAN_CFG)


def _sequences(spark, d):
    pr = _pairs(spark, d).join(fx.system_prompts(spark, d), "prompt_id", "left")
    return X.sequences(pr, PLAN_CFG, system=F.col("system"))


@query("prompts_merged", "S3 T3 A1", with_views(
    "SELECT prompt_id, prompt FROM merged_prompts", "merged_prompts"))
def q_prompts_merged(spark, d):
    """Prompts merged across three prompt files; ids whose texts disagree are left out."""
    return P.merge_prompts(fx.prompts_raw(spark, d), on_conflict="drop")


@query("prompt_conflicts", "A1", with_views(
    """SELECT prompt_id, count(DISTINCT prompt) AS n_texts, count(*) AS n_rows
       FROM prompts_raw GROUP BY prompt_id HAVING count(DISTINCT prompt) > 1""", "prompts_raw"))
def q_prompt_conflicts(spark, d):
    """Prompt ids whose files disagree on the text (A1)."""
    return P.prompt_conflicts(fx.prompts_raw(spark, d))


@query("rollout_last_wins", "A2 P10", with_views(
    "SELECT prompt_id, completion_idx, completion FROM last_rollouts", "last_rollouts"))
def q_rollout_last_wins(spark, d):
    """The rollout-0 completion per prompt, last row in (file, line) order (A2, P10)."""
    return P.last_rollout(fx.completions_raw(spark, d), 0)


@query("prompt_rollout_join", "J1 O1", with_views(
    "SELECT prompt_id, prompt, completion_idx, completion FROM pairs", "pairs"))
def q_prompt_rollout_join(spark, d):
    """Merged prompts joined with their chosen rollout."""
    return _pairs(spark, d)


@query("prompt_key_intersect", "T1", with_views(
    "SELECT prompt_id FROM merged_prompts INTERSECT SELECT prompt_id FROM last_rollouts",
    "merged_prompts", "last_rollouts"))
def q_prompt_key_intersect(spark, d):
    """Prompt ids present in both the merged prompts and the rollouts."""
    return P.common_prompt_ids(P.merge_prompts(fx.prompts_raw(spark, d), "drop"),
                               P.last_rollout(fx.completions_raw(spark, d), 0))


@query("first_n_prompts", "O2", with_views(
    f"SELECT prompt_id, prompt, completion_idx, completion FROM pairs ORDER BY prompt_id LIMIT {FIRST_N}",
    "pairs"))
def q_first_n_prompts(spark, d):
    """The 25 smallest prompt ids of the joined pairs (O2)."""
    return P.first_n(_pairs(spark, d), FIRST_N)


@query("chat_rendered", "V22 V29", with_views(
    "SELECT prompt_id, CAST(length(input_text) AS INT) AS n_chars, md5(input_text) AS text_md5 FROM rendered",
    "rendered"))
def q_chat_rendered(spark, d):
    """Length and md5 of each rendered chat input, with the prompt's system turn when it has one."""
    s = _sequences(spark, d)
    return s.select("prompt_id", F.length("input_text").alias("n_chars"), F.md5("input_text").alias("text_md5"))


_PLAN_SQL = f"""
    SELECT concat(CAST(prompt_id AS VARCHAR), '|', CAST(completion_idx AS VARCHAR)) AS rid, prompt_id,
           CAST(least(n_full, {PLAN_CFG.max_tokens}) AS INT) AS n_tokens, n_full > {PLAN_CFG.max_tokens} AS was_truncated
    FROM (SELECT prompt_id, completion_idx, {_TOK_N} AS n_full FROM rendered) q"""


@query("plan", "V23 V24 P8 P1 K2", with_views(
    "SELECT rid, n_tokens, was_truncated FROM plan_rows", "rendered", extra=[("plan_rows", _PLAN_SQL)]))
def q_plan(spark, d):
    """The extraction plan: rid, token count after truncation at 256 and the truncation flag."""
    return _sequences(spark, d).select("rid", "n_tokens", "was_truncated")


@query("min_length_filter", "P9", with_views(
    f"SELECT rid, n_tokens FROM plan_rows WHERE n_tokens >= {PLAN_CFG.min_tokens}",
    "rendered", extra=[("plan_rows", _PLAN_SQL)]))
def q_min_length_filter(spark, d):
    """Plan rows with at least 64 tokens."""
    return X.keep_min_length(_sequences(spark, d), PLAN_CFG.min_tokens).select("rid", "n_tokens")


@query("run_summary", "A9", with_views(
    f"""SELECT count(*) AS n_pairs, count(*) FILTER (WHERE was_truncated) AS n_truncated,
          count(*) FILTER (WHERE n_tokens < {PLAN_CFG.min_tokens}) AS n_skipped,
          CAST(coalesce(sum(n_tokens) FILTER (WHERE n_tokens >= {PLAN_CFG.min_tokens}), 0) AS BIGINT) AS total_tokens,
          1 AS n_shards
        FROM plan_rows""", "rendered", extra=[("plan_rows", _PLAN_SQL)]))
def q_run_summary(spark, d):
    """Pairs, truncated, skipped, total tokens of kept sequences and shards of the plan."""
    return X.run_summary(_sequences(spark, d), PLAN_CFG, n_shards=1)


@query("running_progress", "W7", with_views(
    f"""SELECT seq_no, prompt_id, tokens_so_far FROM (
          SELECT prompt_id, n_tokens,
            row_number() OVER (ORDER BY prompt_id) AS seq_no,
            count(*) OVER () AS n_all,
            CAST(sum(CASE WHEN n_tokens < {PLAN_CFG.min_tokens} THEN 0 ELSE n_tokens END)
                 OVER (ORDER BY prompt_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS tokens_so_far
          FROM plan_rows) q
        WHERE (seq_no % 10 = 0 OR seq_no = n_all) AND n_tokens >= {PLAN_CFG.min_tokens}""",
    "rendered", extra=[("plan_rows", _PLAN_SQL)]))
def q_running_progress(spark, d):
    """Tokens so far at every 10th planned sequence and at the last one, in prompt order."""
    return X.running_progress(_sequences(spark, d), PLAN_CFG, every=10)


@query("storage_sizing", "A10 V25", with_views(
    f"""SELECT dtype, bytes_per_elem, total_tokens,
          CAST(total_tokens * {SIZING_LAYERS} * ({SIZING_D_MODEL} * bytes_per_elem + scale_bytes) AS BIGINT) AS est_bytes
        FROM (SELECT CAST(coalesce(sum(n_tokens), 0) AS BIGINT) AS total_tokens FROM plan_rows) t,
             (VALUES ('bfloat16', 2, 0), ('float8_e4m3', 1, 0), ('int8', 1, 4)) d(dtype, bytes_per_elem, scale_bytes)""",
    "rendered", extra=[("plan_rows", _PLAN_SQL)]))
def q_storage_sizing(spark, d):
    """Bytes on disk per storage dtype for the planned tokens at 5 layers x 5,120."""
    return X.storage_sizing(_sequences(spark, d), SIZING_LAYERS, SIZING_D_MODEL)
