"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows with equal texts form a group that is never split. Groups are hashed into
cells; within a cell every group of at least 1/GRAIN of a shard is an item of
its own, and the many smaller ones are bundled by hash into items of about that
size. A cell's items (a bounded number) are sorted by size and each
enters the bin with the least remaining capacity that still holds it, found in a
balanced tree. Cells are packed in parallel, one task each.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import held, row_uid, written

#: Items per shard that small groups are bundled into, at most.
GRAIN = 64
#: Shards that one cell packs.
CELL_SHARDS = 256
#: Added to the UTF-8 bytes of every text.
ROW_OVERHEAD = 16
#: Rows whose slots one task numbers, about.
SLOT_ROWS = 50_000


class CapacityTree:
    """Balanced (AA) tree of bins ordered by (remaining capacity, bin)."""

    class Node:
        __slots__ = ("key", "level", "left", "right")

        def __init__(self, key):
            self.key, self.level, self.left, self.right = key, 1, None, None

    def __init__(self):
        self.root = None

    @staticmethod
    def _skew(t):
        if t.left and t.left.level == t.level:
            up = t.left
            t.left, up.right = up.right, t
            return up
        return t

    @staticmethod
    def _split(t):
        if t.right and t.right.right and t.right.right.level == t.level:
            up = t.right
            t.right, up.left = up.left, t
            up.level += 1
            return up
        return t

    def insert(self, key) -> None:
        def put(t):
            if t is None:
                return self.Node(key)
            if key < t.key:
                t.left = put(t.left)
            else:
                t.right = put(t.right)
            return self._split(self._skew(t))
        self.root = put(self.root)

    def remove(self, key) -> None:
        def cut(t, key):
            if t is None:
                return None
            if key < t.key:
                t.left = cut(t.left, key)
            elif t.key < key:
                t.right = cut(t.right, key)
            elif t.left is None and t.right is None:
                return None
            elif t.left is None:
                n = t.right
                while n.left:
                    n = n.left
                t.key, t.right = n.key, cut(t.right, n.key)
            else:
                n = t.left
                while n.right:
                    n = n.right
                t.key, t.left = n.key, cut(t.left, n.key)
            low = min(t.left.level if t.left else 0, t.right.level if t.right else 0) + 1
            if low < t.level:
                t.level = low
                if t.right and t.right.level > low:
                    t.right.level = low
            t = self._skew(t)
            if t.right:
                t.right = self._skew(t.right)
                if t.right.right:
                    t.right.right = self._skew(t.right.right)
            t = self._split(t)
            if t.right:
                t.right = self._split(t.right)
            return t
        self.root = cut(self.root, key)

    def least_at_least(self, size):
        """The bin with the least remaining capacity >= size (lowest number on ties), or None."""
        t, best = self.root, None
        while t:
            if t.key[0] >= size:
                best, t = t.key, t.left
            else:
                t = t.right
        return best


def best_fit_decreasing(sizes: list[int], capacity: int, max_bins: int | None = None) -> list[int] | None:
    """The bin of every item (sizes in descending order); None if more than max_bins are needed.

    An item larger than the capacity gets a bin that nothing else enters.
    """
    tree, n, out = CapacityTree(), 0, []
    for s in sizes:
        at = tree.least_at_least(s) if s <= capacity else None
        if at is None:
            if n == max_bins:
                return None
            at, n = (max(capacity, s), n), n + 1
        else:
            tree.remove(at)
        out.append(at[1])
        if s <= capacity:
            tree.insert((at[0] - s, at[1]))
    return out


def pack_into(sizes: list[int], n_bins: int) -> list[int]:
    """Bins 0 .. n_bins - 1 for the sizes (descending), as near equal as best fit makes them.

    Bisects for the least capacity whose packing needs at most n_bins bins. Items above the
    mean of what is left take a bin of their own first.
    """
    alone, left = 0, sum(sizes)
    while alone < len(sizes) and alone < n_bins - 1 and sizes[alone] * (n_bins - alone) > left:
        left -= sizes[alone]
        alone += 1
    rest, bins = sizes[alone:], n_bins - alone
    low = max([-(-left // bins), *rest[:1]])
    high = 2 * low + 1
    best = best_fit_decreasing(rest, high, bins)
    while best is None:
        high *= 2
        best = best_fit_decreasing(rest, high, bins)
    while low < high:
        mid = (low + high) // 2
        got = best_fit_decreasing(rest, mid, bins)
        if got is None:
            low = mid + 1
        else:
            best, high = got, mid
    return list(range(alone)) + [alone + b for b in best]


def _packer(capacity: int | None, n_shards: int | None):
    def pack(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["bytes", "item"], ascending=[False, True], ignore_index=True)
        sizes = [int(x) for x in items["bytes"]]
        items["bin"] = pack_into(sizes, n_shards) if n_shards else best_fit_decreasing(sizes, capacity)
        return items[["cell", "item", "bin"]].astype({"bin": "int64"})
    return pack


def shard_groups(docs: DataFrame, n_shards: int | None = None, capacity: int | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Put every row into a shard: doc_id, size, text_crc32, shard, slot, and group (its text's hash).

    ``capacity`` (bytes): fixed-capacity shards, as few as best fit finds in each cell; a group
    larger than the capacity gets a shard of its own. ``n_shards``: exactly the shards
    0 .. n_shards - 1 with sizes near equal, at most CELL_SHARDS of them (a larger number needs
    ``capacity``); a group above the mean fills a shard alone.

    Size is the text's UTF-8 bytes plus ROW_OVERHEAD. Equal texts, and null with empty ones, are
    one group and land in one shard. slot numbers a shard's rows from 0 without gaps, by a
    hash of the row. Only the two named columns are read; an empty table gives an empty result.

    Bounds: a cell has at most 2 * GRAIN items a shard, whatever the number of rows; rows are
    counted by partial aggregates, so a group may hold any share of them, and slots are numbered
    in pieces of about SLOT_ROWS rows.
    """
    if (n_shards is None) == (capacity is None):
        raise ValueError("give n_shards or capacity")
    if n_shards is not None and not 1 <= n_shards <= CELL_SHARDS:
        raise ValueError(f"n_shards must be 1 to {CELL_SHARDS}; use capacity for more")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = held(docs.select(
        F.col(id_col).alias("doc_id"), row_uid().alias("uid"), (F.octet_length(text).cast("long") + ROW_OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("group")))
    groups = written(rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "shard-groups", rows.count())
    n, total = groups.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    per_shard = max(1, -(-total // n_shards) if n_shards else capacity)
    cells = 1 if n_shards else max(1, -(-total // (per_shard * CELL_SHARDS)))
    grain = max(1, per_shard // GRAIN)
    bundles = max(1, min(-(-total // cells // grain), (n_shards or CELL_SHARDS) * GRAIN))
    spread = F.xxhash64("group", F.lit(1))
    big = F.col("bytes") >= grain
    groups = groups.select(
        "group", "bytes", big.alias("big"), F.pmod(F.xxhash64("group", F.lit(2)), F.lit(cells)).alias("cell"),
        F.when(big, F.concat(F.lit("g"), F.hex("group"))).otherwise(
            F.concat(F.lit("b"), F.pmod(spread, F.lit(bundles)).cast("string"))).alias("item"))
    items = groups.groupBy("cell", "item").agg(F.sum("bytes").alias("bytes"))
    packed = written(items.groupBy("cell").applyInPandas(_packer(capacity, n_shards), "cell long, item string, bin long"),
                     "shard-bins", cells * bundles)
    # one row per shard cell: at most (number of shards) / CELL_SHARDS + 1 rows
    used = packed.groupBy("cell").agg((F.max("bin") + 1).alias("n")).orderBy("cell").collect()
    first, at = [], 0
    for r in used:
        first.append((r["cell"], at))
        at += r["n"]
    starts = docs.sparkSession.createDataFrame(first, "cell long, first long")
    placed = groups.join(packed, ["cell", "item"]).join(F.broadcast(starts), "cell").select(
        "group", (F.col("first") + F.col("bin")).cast("int").alias("shard"), "bytes", "big")
    heavy = placed.filter("big")  # at most 2 * GRAIN a shard by size
    light = placed.filter("not big").select("group", "shard")
    heavy_rows = rows.join(F.broadcast(heavy.select("group", "shard")) if cells == 1 else heavy.select("group", "shard"), "group")
    light_rows = rows.join(light, "group")
    out = written(heavy_rows.unionByName(light_rows).withColumn(
        "piece", F.pmod(F.xxhash64("uid"), F.lit(max(1, n // (SLOT_ROWS * max(1, at)))))), "sharded", n)
    from pyspark.sql import Window as W
    sizes = out.groupBy("shard", "piece").agg(F.count("*").alias("c"))
    before = sizes.select("shard", "piece", (F.sum("c").over(W.partitionBy("shard").orderBy("piece")) - F.col("c")).alias("before"))
    slot = F.row_number().over(W.partitionBy("shard", "piece").orderBy("doc_id", "uid")) - 1
    return out.withColumn("in_piece", slot).join(before, ["shard", "piece"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("in_piece")).cast("long").alias("slot"), "group")
