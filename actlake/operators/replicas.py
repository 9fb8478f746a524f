"""Replica audits (A13, R7): the same request captured by several data-parallel replicas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replica_duplicates(df: DataFrame, keys=("run_id", "layer", "prompt_id", "completion_idx"), rank_col: str = "dp_rank") -> DataFrame:
    """Keys processed by more than one replica (partial distinct map-side).

    The default key is a whole sequence: different rollouts of a prompt, or the same one
    in another run or layer, are different work."""
    return (df.select(*keys, rank_col).distinct()
            .groupBy(*keys).agg(F.count(F.lit(1)).alias("n_replicas"),
                                F.array_sort(F.collect_list(rank_col)).alias("replicas"))
            .where(F.col("n_replicas") > 1))


def dedup_replicas(df: DataFrame, keys=("run_id", "layer", "prompt_id", "completion_idx", "token_pos"),
                   rank_col: str = "dp_rank") -> DataFrame:
    """Keep one copy per token key - the lowest replica rank.

    ``row_number() = 1`` lets Spark drop extra copies inside each map task
    before the shuffle (group limit), so at most one copy per key per task
    is shuffled.
    """
    w = Window.partitionBy(*keys).orderBy(rank_col)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
