"""Running sums and row numbers that scale past one task per group.

A plain ``sum(..) over (partition by g order by k)`` puts a whole group in
one task. When a group can hold a large share of all rows (a layer of an
index, a whole extraction plan), the work is split instead:

1. the rows are dealt to sorted ranges of the order key (Spark's range
   partitioning) and written once with their range number, so every later
   pass, and a retried task, sees the same ranges;
2. within ``(group, range)`` the window runs as usual - each range holds
   about rows / ranges rows;
3. per ``(group, range)`` totals are summed, offset by an exclusive window
   over ranges (a table of groups x ranges rows) and joined back on
   ``(group, range)``; the big side is already partitioned on those keys by
   step 2, so only the small side moves.

Rows with equal order keys always land in one range, so results equal the
plain window. The number of ranges is ``spark.sql.shuffle.partitions`` unless
given, and grows with the cluster; no bound is written into the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def range_buckets(df: DataFrame, order_col: str, n_buckets: int | None = None) -> DataFrame:
    """``df``, written, with ``_bkt``: the number of the sorted range of ``order_col`` a row is in."""
    dealt = df.repartitionByRange(n_buckets, order_col) if n_buckets else df.repartitionByRange(order_col)
    return stored(dealt.withColumn("_bkt", F.spark_partition_id()), "ranges")


def running_sums(df: DataFrame, order_col: str, sums: dict[str, str], partition_cols=(),
                 exclusive: bool = False, row_number_col: str | None = None,
                 n_buckets: int | None = None, total_count_col: str | None = None) -> DataFrame:
    """Add ``out = sum(value) over (partition by g order by order_col)`` columns.

    ``sums`` maps output column -> value column. With ``exclusive`` the
    current row is left out. ``row_number_col`` adds the 1-based row number
    in the same order; ``total_count_col`` the number of rows of the row's
    group (from the range totals, no extra pass). The rows are written when this is called.
    """
    part = list(partition_cols)
    ranged = x = range_buckets(df, order_col, n_buckets)
    keys = part + ["_bkt"]
    hi = -1 if exclusive else 0
    w_in = Window.partitionBy(*keys).orderBy(order_col).rowsBetween(Window.unboundedPreceding, hi)
    for out, val in sums.items():
        x = x.withColumn(f"_loc_{out}", F.coalesce(F.sum(val).over(w_in), F.lit(0)))
    if row_number_col:
        x = x.withColumn(f"_loc_{row_number_col}",
                         F.row_number().over(Window.partitionBy(*keys).orderBy(order_col)))
    aggs = [F.sum(val).alias(f"_tot_{out}") for out, val in sums.items()]
    aggs.append(F.count(F.lit(1)).alias("_tot__n"))
    tot = ranged.groupBy(*keys).agg(*aggs)
    w_b = Window.partitionBy(*part).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    off_cols = [F.coalesce(F.sum(f"_tot_{out}").over(w_b), F.lit(0)).alias(f"_off_{out}") for out in sums]
    off_cols.append(F.coalesce(F.sum("_tot__n").over(w_b), F.lit(0)).alias("_off__n"))
    if total_count_col:
        off_cols.append(F.sum("_tot__n").over(Window.partitionBy(*part)).alias(total_count_col))
    off = tot.select(*keys, *off_cols)
    y = x.join(off, keys, "left")
    for out in sums:
        y = y.withColumn(out, F.col(f"_loc_{out}") + F.col(f"_off_{out}"))
    if row_number_col:
        y = y.withColumn(row_number_col, F.col(f"_loc_{row_number_col}") + F.col("_off__n"))
    drop = ["_bkt", "_off__n"] + [c for c in y.columns if c.startswith(("_loc_", "_off_"))]
    return y.drop(*drop)
