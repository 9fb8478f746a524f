"""Index, manifest and shard layout.

The index and manifest are derived from one-row-per-sequence tables (keys
and lengths only); payload never moves through these shuffles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import GuardError
from ..functions.text import json_row, layer_file_name
from ..session import stored
from .windows import range_buckets, running_sums

INDEX_KEY = ("prompt_id", "completion_idx", "layer")


def sequence_lengths(acts: DataFrame, group=("run_id", "layer", "prompt_id", "completion_idx")) -> DataFrame:
    """One row per stored sequence: token count (from token rows, keys only)."""
    return acts.groupBy(*group).agg(F.count(F.lit(1)).cast("int").alias("n_tokens"))


def index_offsets(seqs: DataFrame, order_col: str = "append_ord", partition=("layer",),
                  prior_end: DataFrame | None = None, n_buckets: int | None = None) -> DataFrame:
    """``start`` = tokens appended before this sequence in its (shard, layer).

    ``prior_end`` (partition columns + ``end``) continues a re-opened shard
    after its existing data. The running sum is split across tasks.
    """
    x = running_sums(seqs, order_col, {"start": "n_tokens"}, partition_cols=partition, exclusive=True,
                     n_buckets=n_buckets)
    if prior_end is not None:
        x = (x.join(prior_end.select(*partition, "end"), list(partition), "left")
             .withColumn("start", F.col("start") + F.coalesce(F.col("end"), F.lit(0))).drop("end"))
    return x.withColumn("start", F.col("start").cast("bigint"))


def index_json(index: DataFrame) -> DataFrame:
    """K3 + V28: one JSON line per index row, as the legacy reader expects."""
    return index.select(json_row("prompt_id", "completion_idx", "layer", "start", "n_tokens").alias("value"))


def manifest_rows(index: DataFrame, shard_cols=("shard",)) -> DataFrame:
    """A3 as rows: tokens, index rows and distinct sequences per (shard, layer)."""
    return (index.groupBy(*shard_cols, "layer")
            .agg(F.sum("n_tokens").cast("bigint").alias("total_tokens"),
                 F.count(F.lit(1)).alias("n_index_rows"),
                 F.count_distinct("prompt_id", "completion_idx").alias("n_sequences"))
            .withColumn("file_name", layer_file_name(F.col("layer"))))


def manifest(index: DataFrame, model: str, d_model: int, dtype: str, shard_cols=("shard",)) -> DataFrame:
    """A3 + K4 + O4: one manifest row per shard (map of tokens per layer)."""
    from ..config import bytes_per_elem
    bpe = bytes_per_elem(dtype)
    per_layer = manifest_rows(index, shard_cols)
    seqs = (index.select(*shard_cols, "prompt_id", "completion_idx").distinct()
            .groupBy(*shard_cols).agg(F.count(F.lit(1)).alias("n_sequences")))
    m = (per_layer.groupBy(*shard_cols)
         .agg(F.array_sort(F.collect_list("layer")).alias("layers"),
              F.map_from_entries(F.array_sort(F.collect_list(F.struct("layer", "total_tokens"))))
              .alias("total_tokens_per_layer")))
    return (m.join(seqs, list(shard_cols), "left")
            .select(*shard_cols, F.lit(model).alias("model"), "layers", F.lit(d_model).alias("d_model"),
                    F.lit(dtype).alias("dtype"), F.lit(bpe).alias("bytes_per_elem"),
                    F.lit(dtype == "int8").alias("has_scales"), "total_tokens_per_layer",
                    F.coalesce("n_sequences", F.lit(0)).cast("bigint").alias("n_sequences")))


class _Chain:
    """Shards of consecutive sequences: a shard closes with the sequence that brings its bytes to the limit or past it."""

    def __init__(self, sizes: np.ndarray, limit: int):
        self.ends, self.limit = np.cumsum(sizes), limit

    def close(self, start: int, carried: int) -> int:
        """The sequence that closes the shard which holds ``carried`` bytes before sequence ``start``; the number of sequences if none does."""
        before = int(self.ends[start - 1]) if start else 0
        return int(np.searchsorted(self.ends, before + self.limit - carried))

    def walk(self, carried: int) -> list[int]:
        """First sequence of each further shard, from a shard that holds ``carried`` bytes before all of them."""
        starts, start = [], 0
        while (j := self.close(start, carried)) < len(self.ends):
            start, carried = j + 1, 0
            starts.append(start)
        return starts

    def behind(self, start: int, known: dict[int, tuple[int, int]]) -> tuple[int, int]:
        """(shards closed after it, bytes in the last one) of a shard that begins at ``start``; ``known`` keeps what walks have met."""
        path = []
        while start not in known:
            j = self.close(start, 0)
            if j == len(self.ends):
                known[start] = 0, int(self.ends[-1] - (self.ends[start - 1] if start else 0))
            else:
                path.append(start)
                start = j + 1
        for n, s in enumerate(reversed(path), 1):
            known[s] = known[start][0] + n, known[start][1]
        return known[path[0] if path else start]


def _jump_table(limit: int, part: list[str]):
    """What a range does to a shard that is open before it, as one row for each sequence that may be the first to close it.

    (closes, after, left): bytes in the range up to that sequence, shards closed from there to the range's end, bytes in the shard that is open
    then. The row with closes -1 has the range's bytes, for a shard that it leaves open. Rows end with the first sequence that closes an empty shard.
    """
    def run(table: pa.Table) -> pa.Table:
        sizes = table.column("n_bytes").to_numpy()[np.argsort(table.column("_i").to_numpy())]
        chain = _Chain(sizes, limit)
        n = min(chain.close(0, 0) + 1, len(sizes))
        known: dict[int, tuple[int, int]] = {}
        rows = [(-1, 0, int(sizes.sum()))]
        for j in range(n):
            closed, left = chain.behind(j + 1, known)
            rows.append((int(chain.ends[j]), 1 + closed, left))
        keys = {c: [table.column(c)[0].as_py()] * len(rows) for c in [*part, "_bkt"]}
        cols = [pa.array(v, table.schema.field(c).type) for c, v in keys.items()]
        cols += [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
        return pa.Table.from_arrays(cols, [*keys, "closes", "after", "left"])
    return run


def _compose(limit: int, part: list[str], shard: int, carried: int):
    """Jump tables of all ranges of a run, applied one after the other: (range, shard, carried) at each range's begin, and at the end (_bkt -1)."""
    def run(table: pa.Table) -> pa.Table:
        at, held = shard, carried
        frame = table.select(["_bkt", "closes", "after", "left"]).to_pandas().sort_values(["_bkt", "closes"], kind="stable")
        out = []
        for bucket, rows in frame.groupby("_bkt", sort=True):
            if held >= limit:  # the open shard is full already
                at, held = at + 1, 0
            out.append((bucket, at, held))
            closes, after, left = rows["closes"].to_numpy()[1:], rows["after"].to_numpy(), rows["left"].to_numpy()
            j = int(np.searchsorted(closes, limit - held))
            if j < len(closes):
                at, held = at + int(after[j + 1]), int(left[j + 1])
            else:
                held += int(left[0])
        out.append((-1, at, held))
        cols = [pa.array([table.column(c)[0].as_py()] * len(out), table.schema.field(c).type) for c in part]
        cols += [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64()), strict=True)]
        return pa.Table.from_arrays(cols, [*part, "_bkt", "_shard", "_carried"])
    return run


def _shards_of_range(limit: int, keep: list[str]):
    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("_i").to_numpy())
        table = table.take(pa.array(order))
        chain = _Chain(table.column("n_bytes").to_numpy(), limit)
        starts = chain.walk(table.column("_carried")[0].as_py())
        shard = table.column("_shard")[0].as_py() + np.searchsorted(starts, np.arange(table.num_rows), "right")
        return table.select(keep).append_column("shard", pa.array(shard.astype(np.int32)))
    return run


def assign_shards(seq_bytes: DataFrame, limit_bytes: int, order_col: str = "append_ord",
                  partition=(), policy: str = "greedy", n_buckets: int | None = None) -> DataFrame:
    """K7: shard number per sequence from its byte size, in ``order_col`` order.

    ``greedy`` (the single-writer rule): a shard closes after the sequence
    that brings its bytes to the limit or past it; the next one starts from
    zero. The sequences are dealt to sorted ranges; each range makes a jump table (``_jump_table``: where a shard that is open before it
    closes, and what is open behind it), the tables of a run are applied one after the other, and each range numbers its own rows.
    A table has at most as many rows as a shard has sequences. Only keys and byte counts move, and twice.

    ``floor``: shard = floor(bytes before the sequence / limit), one pass;
    boundaries can differ from ``greedy`` by the overshoot.
    """
    if limit_bytes <= 0:
        raise GuardError("limit_bytes must be > 0")
    if policy not in ("greedy", "floor"):
        raise GuardError(f"unknown shard policy {policy!r}")
    part = list(partition)
    if policy == "floor":
        x = running_sums(seq_bytes, order_col, {"_before": "n_bytes"}, partition_cols=part, exclusive=True,
                         n_buckets=n_buckets)
        return x.withColumn("shard", F.floor(F.col("_before") / F.lit(int(limit_bytes))).cast("int")).drop("_before")
    return rotate_shards(seq_bytes, limit_bytes, order_col, part, n_buckets)[0]


def rotate_shards(seq_bytes: DataFrame, limit_bytes: int, order_col: str = "append_ord", part=(), n_buckets: int | None = None,
                  open_shard: int = 0, open_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """``assign_shards`` going on from a shard that holds ``open_bytes``: (rows with ``shard``, the open shard and its bytes at the end).

    The second frame has one row per run: the ``part`` columns, ``_shard``, ``_carried``."""
    part = list(part)
    spark = seq_bytes.sparkSession
    if n_buckets is None:  # ranges of several shards, so that a jump table is a small part of its range
        total = seq_bytes.agg(F.sum("n_bytes")).first()[0] or 0
        n_buckets = int(max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), total // (4 * limit_bytes))))
    x = range_buckets(seq_bytes, order_col, n_buckets)
    keep = [c for c in seq_bytes.columns]
    keys = [*part, "_bkt"]
    x = x.withColumn("n_bytes", F.coalesce(F.col("n_bytes"), F.lit(0)).cast("bigint")) \
        .withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(order_col)))
    kept = {f.name: f for f in x.schema.fields}
    longs = [T.StructField(c, T.LongType()) for c in ("closes", "after", "left")]
    jumps = x.select(*keys, "n_bytes", "_i").groupBy(*keys).applyInArrow(
        _jump_table(limit_bytes, part), T.StructType([kept[c] for c in keys] + longs))
    states = T.StructType([kept[c] for c in part] + [T.StructField("_bkt", T.IntegerType()), T.StructField("_shard", T.IntegerType()),
                                                     T.StructField("_carried", T.LongType())])
    state = stored(jumps.groupBy(*part).applyInArrow(_compose(limit_bytes, part, open_shard, open_bytes), states), "shard-states")
    begin, end = state.where("_bkt >= 0"), state.where("_bkt < 0").drop("_bkt")
    out = x.join(begin, keys).groupBy(*keys).applyInArrow(
        _shards_of_range(limit_bytes, keep), T.StructType([kept[c] for c in keep] + [T.StructField("shard", T.IntegerType())]))
    return out, end
