"""Run parameters (S10), the storage dtype table (P12, V25) and guards.

Guards run as their own small action before a write, because a check folded
into a column that is later pruned never fires.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Storage dtypes and their bytes per element.
DTYPE_BYTES = {"bfloat16": 2, "float8_e4m3": 1, "int8": 1}
# Defaults of an extraction run.
DEFAULT_MAX_TOKENS = 20000
DEFAULT_SHARD_BYTES = 20 * 1024 ** 3
DEFAULT_QUEUE_ITEMS = 64


class GuardError(ValueError):
    """A data or parameter check failed."""


def bytes_per_elem(dtype: str) -> int:
    """Bytes per element of a storage dtype; any other name is an error."""
    size = DTYPE_BYTES.get(dtype)
    if size is None:
        raise GuardError(f"no storage form is called {dtype!r} (known: {', '.join(DTYPE_BYTES)})")
    return size


def bytes_per_elem_col(dtype: Column) -> Column:
    """Bytes per element looked up from a dtype column (null when unknown)."""
    m = F.create_map(*[x for k, v in DTYPE_BYTES.items() for x in (F.lit(k), F.lit(v))])
    return F.element_at(m, dtype)


@dataclass(frozen=True)
class RunConfig:
    """The scalar parameters of one extraction run."""
    model: str = "unknown"
    layers: tuple[int, ...] = ()
    completion_idx: int = 0
    limit: int = 0
    max_tokens: int = DEFAULT_MAX_TOKENS
    min_tokens: int = 0
    tp_size: int = 1
    dtype: str = "bfloat16"
    system_prompt: str | None = None
    steer_alpha: float = 1.0
    shard_bytes: int = DEFAULT_SHARD_BYTES
    n_layers: int | None = None
    run_id: str = "run"
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        bytes_per_elem(self.dtype)
        if self.limit < 0:
            raise GuardError(f"limit must be >= 0, got {self.limit}")
        if self.max_tokens <= 0:
            raise GuardError(f"max_tokens must be > 0, got {self.max_tokens}")
        if self.min_tokens < 0:
            raise GuardError(f"min_tokens must be >= 0, got {self.min_tokens}")
        if self.shard_bytes <= 0:
            raise GuardError("shard_bytes must be > 0")
        if len(set(self.layers)) != len(self.layers):
            object.__setattr__(self, "layers", tuple(sorted(set(self.layers))))
        if self.n_layers is not None:
            check_layer_bounds(self.layers, self.n_layers)

    @property
    def tp(self) -> int:
        return max(1, int(self.tp_size))

    @property
    def bytes_per_elem(self) -> int:
        return DTYPE_BYTES[self.dtype]


def parse_layers(text: str) -> tuple[int, ...]:
    """Comma-separated layer list as given on a command line."""
    return tuple(sorted({int(x) for x in text.split(",") if x.strip()}))


def check_layer_bounds(layers, n_layers: int) -> None:
    """P11 on literals: every layer must satisfy 0 <= L < n_layers."""
    outside = sorted(int(x) for x in layers if int(x) not in range(n_layers))
    if outside:
        raise GuardError(f"the model has layers 0 to {n_layers - 1}; asked for {outside}")


def check_layers_in_data(df: DataFrame, valid_layers, layer_col: str = "layer") -> None:
    """P11 on data: raise when a row carries a layer outside ``valid_layers``."""
    bad = df.select(layer_col).where(~F.col(layer_col).isin(list(valid_layers))).limit(1).collect()
    if bad:
        raise GuardError(f"layer {bad[0][0]} is not one of {sorted(valid_layers)}")


def require_nonempty(df: DataFrame, what: str) -> None:
    """Fail fast when a plan has no rows (one-row probe, not a count)."""
    if not df.limit(1).collect():
        raise GuardError(f"no rows: {what}")


def require_empty(df: DataFrame, what: str) -> None:
    """Raise with one example row when a violation query returns anything."""
    row = df.limit(1).collect()
    if row:
        raise GuardError(f"{what}: {row[0].asDict()}")
