"""Exact duplicates by two-pass Bloom filtering.

Pass one marks a 64-bit hash of every normalised text in a counting filter;
pass two asks it. Only rows whose hash may occur twice are shuffled and
grouped by SHA-256; all others pass straight through as their own group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .bloom import RepeatFilter, repeat_filter
from .common import held, join_stats, row_uid

#: Characters that normalisation deletes: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def _flag(filt: RepeatFilter):
    @F.pandas_udf("boolean")
    def repeated(h: pd.Series) -> pd.Series:
        return pd.Series(filt.maybe_repeated(h.to_numpy().view(np.uint64)))
    return repeated


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                bits_per_row: int = 16, max_bits: int = 1 << 28) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Two rows are equal when their texts are identical after deleting every
    character of ``[\\x20\\x09-\\x0D]``; a null text counts as empty, so null,
    empty and blank texts form one group. The row with the most code points in its
    original text stays, then the smallest id (a null id comes last), then one
    of the rows that tie in both. Only the two named columns are read, so further
    columns may have any name; an empty table gives an empty result.

    Memory: the filter is at most max_bits / 8 bytes, on the driver and in each
    Python worker. Beyond max_bits / bits_per_row rows it lets more single rows
    into the shuffle; the result stays the same. Groups are aggregated before
    they shuffle and joined back by ``join_stats``, so a group may hold any share of the rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    norm = F.translate(text, BLANKS, "")
    hashed = docs.select(F.xxhash64(norm).alias("h"))
    n = docs.count()
    filt = repeat_filter(hashed, n, bits_per_row, max_bits)
    rows = held(docs.select(
        F.col(id_col).alias("doc_id"), row_uid().alias("uid"), F.length(text).alias("len"),
        F.sha2(norm, 256).alias("text_sha256"), _flag(filt)(F.xxhash64(norm)).alias("maybe")))
    alone = rows.filter("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    shuffled = rows.filter("maybe").drop("maybe")
    stats = shuffled.groupBy("text_sha256").agg(
        F.min(F.struct((-F.col("len")).alias("l"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"),
                       F.col("uid").alias("u"))).alias("best"), F.count("*").alias("group_size"))
    stats = stats.select("text_sha256", "group_size", F.col("best.d").alias("keep_id"), F.col("best.u").alias("keep_uid"))
    grouped = join_stats(shuffled, stats, "text_sha256", "group_size", n).select(
        "doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "text_sha256")
    return alone.unionByName(grouped)
