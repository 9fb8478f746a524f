"""Capture-batch operators: replica routing, prefill filter, demux.

A captured forward is described by one metadata row per batch (the ordered
``rids``, ``seq_lens`` and ``prefix_lens`` arrays, at most the engine's batch
width long) and by its flattened hidden states, one row per flat token.

Offsets are array-local: ``start[i] = sum(seq_lens[0:i])`` is computed with
higher-order functions on the metadata row, so the same code runs on a
static table and on a stream. A token finds its sequence by counting the
sequence ends at or before its flat position - no range join, no exploded
position table, and the only join is on ``batch_id`` against the narrow
metadata side (broadcast when its measured size allows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_rid
from .joins import size_checked_broadcast


def batch_metadata(seqs_long: DataFrame) -> DataFrame:
    """Per-sequence rows -> one row per batch with arrays in sequence order.

    A batch whose lengths are all missing (a decode step) gets null
    ``seq_lens``, as the engine reports it.
    """
    s = F.struct("seq_ord", "rid", "seq_len", "prefix_len")
    g = seqs_long.groupBy("batch_id").agg(
        F.array_sort(F.collect_list(s)).alias("_s"),
        F.min("gpu_id").alias("gpu_id"), F.min("global_rank").alias("global_rank"))
    lens = F.col("_s.seq_len")
    return g.select(
        "batch_id", "gpu_id", "global_rank",
        F.col("_s.rid").alias("rids"),
        F.when(F.exists(lens, lambda x: x.isNull()), F.lit(None)).otherwise(lens).alias("seq_lens"),
        F.col("_s.prefix_len").alias("prefix_lens"))


def capturing_replica(global_rank, tp_size: int) -> Column:
    """One copy of tensor-parallel replicas: rank mod tp = 0 (tp floored at 1)."""
    return F.pmod(F.coalesce(_c(global_rank), F.lit(0)), F.lit(max(1, int(tp_size)))) == 0


def dp_rank(gpu_id, tp_size: int) -> Column:
    """P5: data-parallel replica = gpu_id div tp (null gpu -> 0)."""
    return F.floor(F.coalesce(_c(gpu_id), F.lit(0)) / F.lit(max(1, int(tp_size)))).cast("int")


def is_prefill(meta_cols=("rids", "seq_lens", "prefix_lens")) -> Column:
    """Lengths, rids and prefix lengths present and rids match lengths."""
    rids, lens, pref = (F.col(c) for c in meta_cols)
    return (lens.isNotNull() & rids.isNotNull() & pref.isNotNull()
            & (F.size(rids) == F.size(lens)))


def with_offsets(meta: DataFrame) -> DataFrame:
    """``starts`` / ``ends`` arrays = exclusive / inclusive running sums of lengths."""
    none = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("ends"))

    def step(acc, n):
        at = acc["at"] + n.cast("bigint")
        return F.struct(at.alias("at"), F.concat(acc["ends"], F.array(at)).alias("ends"))
    return (meta.withColumn("ends", F.aggregate("seq_lens", none, step, lambda acc: acc["ends"]))
            .withColumn("starts", F.zip_with("ends", "seq_lens", lambda e, n: e - n.cast("bigint"))))


def with_parsed_rids(meta: DataFrame) -> DataFrame:
    """P2 once per batch: ``pids`` / ``cidxs`` arrays parallel to ``rids``."""
    z = F.arrays_zip(F.col("rids").alias("rid"), F.col("prefix_lens").alias("prefix_len"))
    return (meta.withColumn("pids", F.transform(z, lambda s: parse_rid(s["rid"], s["prefix_len"])[0]))
            .withColumn("cidxs", F.transform(z, lambda s: parse_rid(s["rid"], s["prefix_len"])[1])))


def prefill_batches(meta: DataFrame, tp_size: int = 1) -> DataFrame:
    """P4 + P5 + P6 + W2 + P2 on batch metadata (one row per batch)."""
    return with_parsed_rids(with_offsets(meta.where(capturing_replica(F.col("global_rank"), tp_size) & is_prefill())
                                         .withColumn("dp_rank", dp_rank(F.col("gpu_id"), tp_size))))


def batch_report(meta: DataFrame, tp_size: int = 1) -> DataFrame:
    """Counts of kept and dropped batches (the engine drops them silently)."""
    mine = meta.where(capturing_replica(F.col("global_rank"), tp_size))
    return mine.agg(F.count_if(is_prefill()).alias("n_prefill_batches"),
                    F.count_if(~is_prefill()).alias("n_dropped_batches"),
                    F.count_if(F.col("seq_lens").isNotNull() & F.col("rids").isNotNull()
                               & (F.size("rids") != F.size("seq_lens"))).alias("n_length_mismatch"))


def sequence_slices(meta: DataFrame, tp_size: int = 1) -> DataFrame:
    """One row per captured sequence: rid, parsed key, start and length."""
    b = prefill_batches(meta, tp_size)
    z = F.arrays_zip(F.col("rids").alias("rid"), F.col("seq_lens").alias("seq_len"),
                     F.col("prefix_lens").alias("prefix_len"), F.col("starts").alias("start"))
    x = b.select("batch_id", "dp_rank", F.posexplode(z).alias("seq_ord", "s"))
    pid, cidx = parse_rid(F.col("s.rid"), F.col("s.prefix_len"))
    return (x.select("batch_id", "dp_rank", F.col("seq_ord").cast("int").alias("seq_ord"),
                     F.col("s.rid").alias("rid"), pid.alias("prompt_id"), cidx.alias("completion_idx"),
                     F.col("s.start").alias("start"), F.col("s.seq_len").cast("int").alias("seq_len"),
                     F.col("s.prefix_len").cast("int").alias("prefix_len"))
            .where(F.col("seq_len") > 0))


def demux_rows(tokens: DataFrame, vec_col: str = "vec") -> DataFrame:
    """W2 on token rows that carry their batch's arrays (stream or batch).

    The owning sequence is the number of sequence ends <= flat_pos; tokens
    past the last end (a length mismatch) are dropped; zero-length sequences
    own no token. ``token_pos = prefix_len + flat_pos - start`` keeps split
    (chunked) sequences aligned.
    """
    if "pids" not in tokens.columns:
        tokens = with_parsed_rids(tokens)
    i = F.size(F.filter("ends", lambda e: e <= F.col("flat_pos")))
    x = tokens.withColumn("_i", i).where(F.col("_i") < F.size("ends"))
    k = F.col("_i") + 1
    rid = F.element_at("rids", k)
    prefix = F.element_at("prefix_lens", k)
    start = F.element_at("starts", k)
    pid, cidx = F.element_at("pids", k), F.element_at("cidxs", k)
    keep = [c for c in tokens.columns if c not in (
        "rids", "seq_lens", "prefix_lens", "starts", "ends", "flat_pos", "global_rank", "gpu_id", "pids",
        "cidxs", vec_col)]
    return x.select(*keep, rid.alias("rid"), pid.alias("prompt_id"), cidx.alias("completion_idx"),
                    (prefix + F.col("flat_pos") - start).cast("int").alias("token_pos"), F.col(vec_col))


def demux(tokens: DataFrame, meta: DataFrame, tp_size: int = 1, vec_col: str = "vec") -> DataFrame:
    """Split flattened capture tokens into per-sequence token rows.

    ``tokens``: (batch_id, [layer,] flat_pos, vec); ``meta``: batch metadata.
    """
    b = prefill_batches(meta, tp_size).select("batch_id", "dp_rank", "rids", "prefix_lens", "starts", "ends",
                                              "pids", "cidxs")
    row_bytes = F.lit(64) + F.size("rids") * F.lit(64)
    b = size_checked_broadcast(b, row_bytes)
    return demux_rows(tokens.join(b, "batch_id", "inner"), vec_col)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x
