"""DuckDB text of the stand-in views, for the oracle queries.

The oracle engine has only the raw tables registered, so each oracle query
inlines the views it needs as common table expressions. These texts mirror
``actlake.sources.fixtures`` row for row.
"""

from __future__ import annotations

NL = "chr(10)"

# name -> (dependencies, SQL body)
VIEWS: dict[str, tuple[list[str], str]] = {
    "prompts": ([], """
        SELECT conv_id * 1000 + turn AS prompt_id, text AS prompt FROM conversations WHERE role = 'user'"""),
    "completions": ([], """
        SELECT prompt_id, CAST(row_number() OVER (PARTITION BY prompt_id ORDER BY again, turn) - 1 AS INT) AS completion_idx,
               CASE WHEN again = 1 THEN concat(text, ' (again)') ELSE text END AS text
        FROM (SELECT conv_id * 1000 + asked AS prompt_id, turn, text, unnest(range(1 + CAST((conv_id * 1000 + asked) % 2 = 0 AS INT))) AS again
              FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn
                      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked FROM conversations) q
              WHERE role = 'assistant' AND asked IS NOT NULL) r"""),
    "system_prompts": (["prompts"], """
        SELECT p.prompt_id, c.text AS system FROM prompts p JOIN conversations c ON c.conv_id = p.prompt_id // 1000
        WHERE c.role = 'system' AND c.turn = 0"""),
    "prompts_clean": (["prompts"], """
        SELECT prompt_id, prompt, 0 AS src_ord FROM prompts
        UNION ALL SELECT prompt_id, prompt, 1 FROM prompts WHERE prompt_id % 5 = 0"""),
    "prompts_raw": (["prompts", "prompts_clean"], """
        SELECT * FROM prompts_clean
        UNION ALL SELECT prompt_id, concat(prompt, '!'), 2 FROM prompts WHERE prompt_id % 17 = 3"""),
    "completions_raw": (["completions"], """
        SELECT prompt_id, completion_idx, text, 0 AS src_ord, prompt_id * 100 + completion_idx AS line_ord
        FROM completions
        UNION ALL SELECT prompt_id, completion_idx, concat('v2: ', text), 1, prompt_id * 100 + completion_idx
        FROM completions WHERE prompt_id % 4 = 0"""),
    "merged_prompts": (["prompts_raw"], """
        SELECT prompt_id, min(prompt) AS prompt FROM prompts_raw GROUP BY prompt_id
        HAVING min(prompt) = max(prompt)"""),
    "last_rollouts": (["completions_raw"], """
        SELECT prompt_id, completion_idx, text AS completion FROM (
          SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY src_ord DESC, line_ord DESC) AS rn
          FROM completions_raw WHERE completion_idx = 0) q WHERE rn = 1"""),
    "pairs": (["prompts", "last_rollouts"], """
        SELECT p.prompt_id, p.prompt, r.completion_idx, r.completion
        FROM prompts p JOIN last_rollouts r ON p.prompt_id = r.prompt_id"""),
    "rendered": (["pairs", "system_prompts"], f"""
        SELECT p.prompt_id, p.completion_idx,
          coalesce(CASE WHEN length(s.system) > 0 THEN '<|im_start|>system' || {NL} || s.system
                        || '<|im_end|>' || {NL} END, '')
          || '<|im_start|>user' || {NL} || p.prompt || '<|im_end|>' || {NL}
          || '<|im_start|>assistant' || {NL} || p.completion AS input_text
        FROM pairs p LEFT JOIN system_prompts s ON p.prompt_id = s.prompt_id"""),
    "token_base": ([], """
        SELECT blk * 2 + CASE WHEN pos >= cut THEN 1 ELSE 0 END AS prompt_id,
               CAST(pos - CASE WHEN pos >= cut THEN cut ELSE 0 END AS INT) AS token_pos, embedding
        FROM (SELECT CAST(floor(vec_id / 20.0) AS BIGINT) AS blk, CAST(vec_id % 20 AS INT) AS pos,
                     1 + (CAST(floor(vec_id / 20.0) AS BIGINT) * 7) % 19 AS cut, embedding
              FROM embeddings) q"""),
    "vectors": (["token_base"], """
        SELECT run_id, layer, b.prompt_id, 0 AS completion_idx, token_pos,
          CASE WHEN run_id = 'base' AND layer = 16 THEN embedding
               WHEN run_id = 'variant' AND b.prompt_id % 8 = 2 AND token_pos BETWEEN 2 AND 4
                 THEN list_transform(embedding, lambda x: CAST(0 AS FLOAT))
               ELSE list_transform(embedding, lambda x: CAST(CAST(x AS DOUBLE) * 0.75::DOUBLE + 0.01::DOUBLE AS FLOAT))
          END AS vec
        FROM token_base b
        JOIN (SELECT prompt_id, max(token_pos) AS mx FROM token_base GROUP BY prompt_id) m ON b.prompt_id = m.prompt_id
        CROSS JOIN (VALUES ('base', 16), ('base', 32), ('variant', 16), ('variant', 32)) r(run_id, layer)
        WHERE run_id = 'base' OR (b.prompt_id % 11 <> 5 AND NOT (b.prompt_id % 7 = 3 AND token_pos = mx))"""),
    "capture_seqs": (["token_base"], """
        SELECT batch_id, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY prompt_id, empty) - 1 AS INT) AS seq_ord,
          CASE WHEN empty = 1 THEN concat(CAST(prompt_id + 1000000000 AS VARCHAR), '|0') WHEN prompt_id % 10 = 9 THEN 'warmup'
               ELSE concat(CAST(prompt_id // 2 AS VARCHAR), '|', CAST(prompt_id % 2 AS VARCHAR)) END AS rid,
          CASE WHEN batch_id % 5 = 4 THEN NULL WHEN empty = 1 THEN 0 ELSE n END AS seq_len,
          CAST(CASE WHEN prompt_id % 10 = 3 THEN 4 WHEN prompt_id % 10 = 9 THEN 2 ELSE 0 END AS INT) AS prefix_len,
          batch_id % 8 AS gpu_id, batch_id % 4 AS global_rank
        FROM (SELECT CAST(floor(prompt_id / 4.0) AS BIGINT) AS batch_id, prompt_id, CAST(max(token_pos) + 1 AS INT) AS n,
                unnest(range(1 + CAST(prompt_id % 6 = 1 AS INT))) AS empty
              FROM token_base GROUP BY prompt_id) q"""),
    "capture_tokens": (["token_base"], """
        SELECT batch_id, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY prompt_id, token_pos) - 1 AS INT) AS flat_pos,
          embedding AS vec
        FROM (SELECT CAST(floor(prompt_id / 4.0) AS BIGINT) AS batch_id, prompt_id, token_pos, embedding FROM token_base) q"""),
    "replica_rows": (["token_base"], """
        SELECT 'run' AS run_id, prompt_id, CAST((prompt_id % 2) * dp_rank AS INT) AS completion_idx, token_pos, 16 AS layer, dp_rank,
          embedding AS vec
        FROM token_base CROSS JOIN (VALUES (0), (1)) r(dp_rank)"""),
    "doc_index": ([], """
        SELECT prompt_id, 0 AS completion_idx, layer, n_tokens,
               rerun * CAST(1099511627776 AS BIGINT) + prompt_id AS append_ord
        FROM (SELECT doc_id AS prompt_id, CAST(len(regexp_extract_all(text, '\\S+')) AS INT) AS n_tokens, 0 AS rerun
              FROM documents
              UNION ALL SELECT doc_id, CAST(len(regexp_extract_all(text, '\\S+')) AS INT), 1 FROM documents
              WHERE doc_id % 50 = 7) q
        CROSS JOIN (SELECT unnest([16, 32]) AS layer) l"""),
    "directions_raw": ([], """
        SELECT CASE WHEN label = 8 THEN concat('layer_x', CAST(vec_id AS VARCHAR))
                    WHEN label = 9 THEN concat('other_', CAST(vec_id AS VARCHAR))
                    ELSE concat('layer_', CAST(vec_id AS VARCHAR)) END AS key, embedding AS vec
        FROM embeddings"""),
    "arch_states": ([], """
        SELECT e.vec_id,
          CASE e.label WHEN 0 THEN 'Olmo2DecoderLayer' WHEN 1 THEN 'LlamaDecoderLayer'
            WHEN 2 THEN 'Qwen2DecoderLayer' WHEN 3 THEN 'Qwen3DecoderLayer' WHEN 4 THEN 'MistralDecoderLayer'
            WHEN 5 THEN 'MixtralDecoderLayer' WHEN 6 THEN 'DeciLMDecoderLayer'
            ELSE concat('UnknownDecoderLayer', CAST(e.label AS VARCHAR)) END AS layer_class,
          e.embedding AS h, coalesce(n.embedding, e.embedding) AS r
        FROM embeddings e LEFT JOIN embeddings n ON n.vec_id = e.vec_id + 1"""),
    "arch_patterns": ([], """
        SELECT * FROM (VALUES ('Olmo2DecoderLayer', 'single'), ('LlamaDecoderLayer', 'tuple_sum'),
          ('Qwen2DecoderLayer', 'tuple_sum'), ('Qwen3DecoderLayer', 'tuple_sum'),
          ('MistralDecoderLayer', 'tuple_sum'), ('MixtralDecoderLayer', 'tuple_sum'),
          ('DeciLMDecoderLayer', 'tuple_sum')) t(layer_class, pattern)"""),
}


def with_views(body: str, *names: str, extra: list[tuple[str, str]] = (), recursive: bool = False) -> str:
    """``WITH`` the named views (and their dependencies) followed by ``body``."""
    order: list[str] = []

    def add(n: str) -> None:
        if n in order:
            return
        for dep in VIEWS[n][0]:
            add(dep)
        order.append(n)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({VIEWS[n][1]})" for n in order] + [f"{n} AS ({sql})" for n, sql in extra]
    if not ctes:
        return body
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n" + body


def norm_sql(v: str) -> str:
    return f"sqrt(list_sum(list_transform({v}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"


def r6(expr: str) -> str:
    return f"round({expr}, 6)"


VIEWS["doc_tokens"] = ([], """
    SELECT t.prompt_id, 0 AS completion_idx, t.token_pos, e.embedding AS vec
    FROM (SELECT doc_id AS prompt_id, unnest(range(len(regexp_extract_all(text, '\\S+')))) AS token_pos
          FROM documents) t
    JOIN embeddings e
      ON e.vec_id = (t.prompt_id * 7919 + t.token_pos * 104729) % (SELECT count(*) FROM embeddings)""")
