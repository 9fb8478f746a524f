"""Text, key and format functions.

All native Catalyst expressions except ``tokenize_with``, which runs a
user-supplied tokenizer on Arrow batches (one tokenizer per Python worker).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --------------------------------------------------------------------------- request ids

def build_rid(prompt_id, completion_idx) -> Column:
    """Wire key ``"<prompt_id>|<completion_idx>"``."""
    return F.concat_ws("|", _c(prompt_id).cast("string"), _c(completion_idx).cast("string"))


# Fixed value: an integer as the host language parses it (sign, digits, single
# underscores between digits, surrounding whitespace).
INT_TEXT = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"


def _parse_int(part: Column, to: str) -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(part, r"^\s+|\s+$", ""), "_", "")
    return F.when(part.rlike(INT_TEXT), cleaned.try_cast(to))


def parse_rid(rid, prefix_len) -> tuple[Column, Column]:
    """(prompt_id, completion_idx) from a rid.

    Exactly two ``|``-separated integer parts are required; on any failure
    (null, wrong arity, non-integer, overflow) prompt_id is -1 and
    completion_idx is the sequence's prefix length.
    """
    parts = F.split(_c(rid), r"\|", -1)
    pid = _parse_int(F.element_at(parts, 1), "bigint")
    cidx = _parse_int(F.element_at(parts, 2), "int")
    ok = _c(rid).isNotNull() & (F.size(parts) == 2) & pid.isNotNull() & cidx.isNotNull()
    return (F.when(ok, pid).otherwise(F.lit(-1).cast("bigint")),
            F.when(ok, cidx).otherwise(_c(prefix_len).cast("int")))


# --------------------------------------------------------------------------- chat rendering

@dataclass(frozen=True)
class ChatTemplate:
    """A chat template as data: per-message prefix/suffix and the generation prefix."""
    turn_start: str
    role_end: str
    turn_end: str
    generation_prefix: str


# The ChatML turn markers; the reasoning variant opens a think block.
CHATML = ChatTemplate("<|im_start|>", "\n", "<|im_end|>\n", "<|im_start|>assistant\n")
CHATML_THINK = ChatTemplate("<|im_start|>", "\n", "<|im_end|>\n", "<|im_start|>assistant\n<think>")


def messages(prompt, system=None) -> Column:
    """``ARRAY<STRUCT<role, content>>``; the system turn only when non-empty."""
    user = F.struct(F.lit("user").alias("role"), _c(prompt).alias("content"))
    if system is None:
        return F.array(user)
    sys_c = F.lit(system) if isinstance(system, str) else _c(system)
    sys_m = F.struct(F.lit("system").alias("role"), sys_c.alias("content"))
    return F.filter(F.array(sys_m, user),
                    lambda m: (m["role"] != "system") | (F.coalesce(F.length(m["content"]), F.lit(0)) > 0))


def render_chat(prompt, completion, system=None, template: ChatTemplate = CHATML) -> Column:
    """template(messages, add_generation_prompt) + completion, no EOS."""
    body = F.array_join(F.transform(messages(prompt, system), lambda m: F.concat(
        F.lit(template.turn_start), m["role"], F.lit(template.role_end), m["content"],
        F.lit(template.turn_end))), "")
    return F.concat(body, F.lit(template.generation_prefix), _c(completion))


# --------------------------------------------------------------------------- tokenising

# Fixed value: default vocabulary size of the native whitespace tokenizer.
DEFAULT_VOCAB = 1 << 20


def whitespace_tokens(text) -> Column:
    """Maximal runs of non-whitespace characters."""
    return F.regexp_extract_all(_c(text), F.lit(r"\S+"), 0)


def whitespace_ids(text, vocab: int = DEFAULT_VOCAB) -> Column:
    """V23 default: native tokenizer, ids = pmod(xxhash64(token), vocab)."""
    return F.transform(whitespace_tokens(text), lambda w: F.pmod(F.xxhash64(w), F.lit(vocab)).cast("int"))


def whitespace_ids_from_tokens(tokens, vocab: int = DEFAULT_VOCAB) -> Column:
    return F.transform(_c(tokens), lambda w: F.pmod(F.xxhash64(w), F.lit(vocab)).cast("int"))


def token_count(ids) -> Column:
    """V24."""
    return F.size(_c(ids))


_TOKENIZERS: dict = {}


def tokenize_with(df: DataFrame, text_col: str, factory: Callable[[], Callable[[list[str]], list[list[int]]]],
                  out_col: str = "input_ids", key: str | None = None) -> DataFrame:
    """Apply a pluggable tokenizer on Arrow batches.

    ``factory()`` builds a function ``list[str] -> list[list[int]]``; it is
    called once per Python worker and cached there.
    """
    cache_key = key or f"{getattr(factory, '__module__', '')}.{getattr(factory, '__qualname__', id(factory))}"

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def _tok(texts: pd.Series) -> pd.Series:
        fn = _TOKENIZERS.get(cache_key)
        if fn is None:
            fn = _TOKENIZERS[cache_key] = factory()
        ids = fn([t if t is not None else "" for t in texts.tolist()])
        return pd.Series([list(map(int, x)) for x in ids])

    return df.withColumn(out_col, _tok(F.col(text_col)))


def truncate_ids(ids, max_tokens: int) -> Column:
    """Keep the first ``max_tokens`` ids."""
    return F.slice(_c(ids), 1, max_tokens)


# --------------------------------------------------------------------------- names and rows

# Legacy layout file names.
LAYER_FILE = "acts_layer_%03d.bin"
SCALE_FILE = "scales_layer_%03d.bin"
SHARD_DIR = "shard_%04d"
REPLICA_DIR = "shard_dp%02d"


def layer_from_key(key) -> Column:
    """``layer_<int>`` -> int, null for any other key."""
    digits = F.regexp_extract(_c(key), r"^layer_([0-9]+)$", 1)
    return F.when(digits != "", digits.try_cast("int"))


def layer_file_name(layer) -> Column:
    """V27."""
    return F.format_string(LAYER_FILE, _c(layer))


def json_row(*cols) -> Column:
    """One JSON object per row."""
    return F.to_json(F.struct(*[_c(c) for c in cols]))
