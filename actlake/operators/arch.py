"""Architecture registry: where the residual stream is and how to steer it
(U1-U3, U5, J9, V14, V15).

A decoder layer either returns the residual itself (``single``) or a pair
``(h, r)`` whose sum is the residual (``tuple_sum``). Extractors and adders
are Catalyst column expressions over ``ARRAY<FLOAT>`` - no Python UDF.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import GuardError
from ..functions.quant import bf16_vec
from ..functions.vec import vec_add

Extractor = Callable[[Column, Column], Column]
Adder = Callable[[Column, Column, Column], tuple[Column, Column]]


def extract_single(h: Column, r: Column | None = None) -> Column:
    """The layer output is the residual."""
    return h


def extract_tuple_sum(h: Column, r: Column) -> Column:
    """residual = h + r, rounded like a bf16 add."""
    return bf16_vec(vec_add(h, r))


def add_single(h: Column, r: Column, delta: Column) -> tuple[Column, Column]:
    """H + delta (bf16 add); other outputs unchanged."""
    return bf16_vec(vec_add(h, delta)), r


def add_to_second(h: Column, r: Column, delta: Column) -> tuple[Column, Column]:
    """H unchanged, r + delta (bf16 add)."""
    return h, bf16_vec(vec_add(r, delta))


# Pattern -> (extractor, adder)
PATTERNS: dict[str, tuple[Extractor, Adder]] = {
    "single": (extract_single, add_single),
    "tuple_sum": (extract_tuple_sum, add_to_second),
}

# Decoder-layer classes and their pattern.
ARCH_REGISTRY: dict[str, str] = {
    "Olmo2DecoderLayer": "single",
    "LlamaDecoderLayer": "tuple_sum",
    "Qwen2DecoderLayer": "tuple_sum",
    "Qwen3DecoderLayer": "tuple_sum",
    "MistralDecoderLayer": "tuple_sum",
    "MixtralDecoderLayer": "tuple_sum",
    "DeciLMDecoderLayer": "tuple_sum",
}

# Fixed values (U5): model classes served through another model's decoder layer.
MODEL_ALIASES: dict[str, str] = {
    "Olmo2ForCausalLM": "Olmo2DecoderLayer",
    "Olmo3ForCausalLM": "Olmo2DecoderLayer",
    "LlamaForCausalLM": "LlamaDecoderLayer",
    "Phi3ForCausalLM": "LlamaDecoderLayer",
    "InternLM3ForCausalLM": "LlamaDecoderLayer",
    "Qwen2ForCausalLM": "Qwen2DecoderLayer",
    "Qwen3ForCausalLM": "Qwen3DecoderLayer",
    "MistralForCausalLM": "MistralDecoderLayer",
    "MixtralForCausalLM": "MixtralDecoderLayer",
    "DeciLMForCausalLM": "DeciLMDecoderLayer",
}


def layer_class_of_model(model_class: str) -> str:
    """The decoder-layer class a model class runs through."""
    if model_class in MODEL_ALIASES:
        return MODEL_ALIASES[model_class]
    if model_class in ARCH_REGISTRY:
        return model_class
    raise GuardError(f"no architecture registered for {model_class}")


def attach_layer_class(df: DataFrame, model_col: str = "model_class") -> DataFrame:
    """``layer_class`` of each row's model class; a decoder-layer class names itself, an unknown class gives null."""
    names = MODEL_ALIASES | {k: k for k in ARCH_REGISTRY}
    m = F.create_map(*[x for k, v in sorted(names.items()) for x in (F.lit(k), F.lit(v))])
    return df.withColumn("layer_class", F.element_at(m, F.col(model_col)))


def register_arch(layer_class: str, pattern: str, registry: dict | None = None) -> None:
    """A class needs both an extractor and an adder; re-registering the
    same pattern is a no-op, a different one is an error."""
    reg = ARCH_REGISTRY if registry is None else registry
    if pattern not in PATTERNS:
        raise GuardError(f"unknown output pattern {pattern!r}; known: {sorted(PATTERNS)}")
    old = reg.get(layer_class)
    if old is not None and old != pattern:
        raise GuardError(f"{layer_class} is already registered as {old!r}")
    reg[layer_class] = pattern


def arch_patterns(spark: SparkSession, registry: dict | None = None) -> DataFrame:
    """The registry as a table ``(layer_class, pattern)``."""
    reg = ARCH_REGISTRY if registry is None else registry
    return spark.createDataFrame(sorted(reg.items()), "layer_class string, pattern string")


def attach_pattern(df: DataFrame, class_col: str = "layer_class", registry: dict | None = None) -> DataFrame:
    """Join the (fixed-size) registry on the layer class; unknown -> null pattern."""
    reg = ARCH_REGISTRY if registry is None else registry
    m = F.create_map(*[x for k, v in sorted(reg.items()) for x in (F.lit(k), F.lit(v))])
    return df.withColumn("pattern", F.element_at(m, F.col(class_col)))


def unregistered(df: DataFrame, class_col: str = "layer_class", registry: dict | None = None) -> DataFrame:
    """U3 / J9 guard report: rows whose class has no registered pattern."""
    return attach_pattern(df, class_col, registry).where(F.col("pattern").isNull()).drop("pattern")


def require_registered(df: DataFrame, class_col: str = "layer_class") -> None:
    row = unregistered(df.select(class_col), class_col).limit(1).collect()
    if row:
        raise GuardError(f"layer class {row[0][0]} has no pattern in the registry")


def residual(h, r, pattern) -> Column:
    """The residual stream given a pattern column (null for unknown patterns)."""
    h, r, p = _c(h), _c(r), _c(pattern)
    out = None
    for name, (ext, _) in PATTERNS.items():
        out = (F.when(p == name, ext(h, r)) if out is None else out.when(p == name, ext(h, r)))
    return out


def steer_outputs(h, r, pattern, delta) -> tuple[Column, Column]:
    """The layer outputs (h', r') after adding ``delta`` with the pattern's adder."""
    h, r, p, d = _c(h), _c(r), _c(pattern), _c(delta)
    hs = rs = None
    for name, (_, add) in PATTERNS.items():
        nh, nr = add(h, r, d)
        hs = F.when(p == name, nh) if hs is None else hs.when(p == name, nh)
        rs = F.when(p == name, nr) if rs is None else rs.when(p == name, nr)
    return hs, rs


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x
