"""Helpers shared by the operators: written tables, guarded joins, components."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from actlake.session import stored

#: At most this many heavy keys are ever broadcast (each holds over 1/HEAVY_KEYS of all rows).
HEAVY_KEYS = 1000
#: Rows in a file of a small written table.
FILE_ROWS = 100_000


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` into the shared checkpoint folder and read it again.

    The written table replaces the lineage: a lost executor costs no recomputation.
    With ``rows``, about that many, the files hold FILE_ROWS rows each at least.
    """
    return stored(df if rows is None else df.coalesce(rows // FILE_ROWS + 1), name)


def held(df: DataFrame) -> DataFrame:
    """Keep what is read several times on the executors' disks, computed once.

    The lineage stays: partitions of a lost executor are computed again. Nothing is held in memory.
    """
    return df.persist(StorageLevel.DISK_ONLY)


def row_uid() -> Column:
    """A number for each row. Use it on a frame that is written at once, or on a table scan."""
    return F.monotonically_increasing_id()


def join_stats(rows: DataFrame, stats: DataFrame, key: str, size_col: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one ``stats`` row per key, safe for hot keys.

    Keys that hold more than total / HEAVY_KEYS rows are at most HEAVY_KEYS by
    arithmetic, so their stats are broadcast and the hot rows never shuffle;
    all other keys are joined by an ordinary shuffle.
    """
    limit = max(1, total // HEAVY_KEYS)
    heavy = stats.filter(F.col(size_col) > limit)
    light = stats.filter(F.col(size_col) <= limit)
    hot = rows.join(F.broadcast(heavy), key)
    cold = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    return hot.unionByName(cold)


def _edge(u: Column | str, v: Column | str) -> Column:
    u, v = (F.col(x) if isinstance(x, str) else x for x in (u, v))
    return F.struct(u.alias("u"), v.alias("v"))


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, comp) for every node of the undirected ``links`` (a, b); comp is the least node.

    Alternating large-star and small-star rounds; every round is two
    aggregations and joins over the remaining edges, written to the shared
    folder. Neither edges nor labels reach the driver, which sees two numbers a round. A row gives both its
    edges at once: as a union, each part of which repeats what comes before, a round's plan would be four times as large.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .filter("u <> v").distinct().hint("rebalance"), "cc")
    mark = None
    for _ in range(max_rounds):
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
        both = edges.select(F.inline(F.array(_edge("u", "v"), _edge("v", "u"))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        edges = written(small.select(F.inline(F.array(_edge(F.greatest("v", "m"), F.least("v", "m")), _edge("u", "m"))))
                        .filter("u <> v").distinct().hint("rebalance"), "cc")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
