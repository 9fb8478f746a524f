"""Two-pass counting filter: which 64-bit hashes may occur more than once?

Pass one: every partition marks its hashes in a filter with two states per
cell (seen once, seen at least twice) and sends only the cells it touched,
slice by slice. Slices of different partitions are merged in a tree of small
groups: a cell that two partitions saw once each becomes "twice". Pass two
asks the merged filter. A hash that occurs twice always finds all its cells
at "twice" (no false negatives); a hash that occurs once is let through
with a small probability, which costs work and never changes a result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import held
from .hashing import mix

SLICE_BITS = 1 << 20
FAN_IN = 64
#: Hashes that a task marks at a time.
MARK_HASHES = 500_000
#: Hashes that are taken of a batch, or asked for, at a time.
PIECE_HASHES = 1 << 16
#: Cells that come to the driver in one job, 4 MB of them; a job for each of the merging tasks would be hundreds.
JOB_BITS = 1 << 25
PARTS_SCHEMA = "slice int, part long, once binary, twice binary"


def filter_bits(n_items: int, bits_per_item: int, max_bits: int) -> int:
    """A power of two of cells: bits_per_item for each item, at most max_bits."""
    bits = SLICE_BITS
    while bits < n_items * bits_per_item and bits < max_bits:
        bits *= 2
    return bits


def cells(h: np.ndarray, n_bits: int, k: int) -> np.ndarray:
    """The k cells of every hash, shape (k, n)."""
    step = mix(h) | np.uint64(1)
    return np.stack([((h + np.uint64(i) * step) >> np.uint64(7)) & np.uint64(n_bits - 1) for i in range(k)])


def _pack(pos: np.ndarray) -> bytes:
    """Cells of one slice: 4 bytes each, or one bit for each cell of the slice where that is shorter."""
    if 4 * len(pos) < SLICE_BITS // 8:
        return b"p" + pos.astype(np.uint32).tobytes()
    mask = np.zeros(SLICE_BITS, bool)
    mask[pos] = True
    return b"m" + np.packbits(mask).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    if data[:1] == b"p":
        return np.frombuffer(data, np.uint32, offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=1))).astype(np.uint32)


def _first_column(b: pa.RecordBatch) -> np.ndarray:
    return b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)


def _mark(n_bits: int, k: int, min_count: int, values):
    def marks(got):
        cell, times = np.unique(cells(np.concatenate(got), n_bits, k).ravel(), return_counts=True)
        part = TaskContext.get().partitionId()
        ends = np.searchsorted(cell, np.arange(0, n_bits + 1, SLICE_BITS, dtype=np.uint64))
        for s in np.flatnonzero(np.diff(ends)):
            at = cell[ends[s]:ends[s + 1]] - np.uint64(s * SLICE_BITS)
            t = times[ends[s]:ends[s + 1]] >= min_count
            yield pa.RecordBatch.from_pydict({
                "slice": pa.array([s], pa.int32()), "part": pa.array([part], pa.int64()),
                "once": pa.array([_pack(at[~t])], pa.binary()), "twice": pa.array([_pack(at[t])], pa.binary())})

    def run(batches):
        got, held_rows = [], 0
        for b in batches:
            found = values(b) if b.num_rows else ()
            for at in range(0, len(found), PIECE_HASHES):
                got.append(found[at:at + PIECE_HASHES])
                held_rows += len(got[-1])
                if held_rows >= MARK_HASHES:  # pieces of one task merge like those of several
                    yield from marks(got)
                    got, held_rows = [], 0
        if got:
            yield from marks(got)
    return run


def _merge(table: pa.Table) -> pa.Table:
    once, twice = np.zeros(SLICE_BITS, bool), np.zeros(SLICE_BITS, bool)
    for o, t in zip(table.column("once").to_pylist(), table.column("twice").to_pylist(), strict=True):
        o, t = _unpack(o), _unpack(t)
        twice[t] = True
        twice[o[once[o]]] = True
        once[o] = True
    return pa.table({"slice": table.column("slice")[:1].cast(pa.int32()), "part": table.column("part")[:1].cast(pa.int64()),
                     "once": pa.array([_pack(np.flatnonzero(once & ~twice))], pa.binary()),
                     "twice": pa.array([_pack(np.flatnonzero(twice))], pa.binary())})


class RepeatFilter:
    """The merged cells, as a broadcast of at most max_bits / 8 bytes."""

    def __init__(self, spark, bits: np.ndarray, n_bits: int, k: int):
        self.n_bits, self.k = n_bits, k
        self.bits = spark.sparkContext.broadcast(bits)

    def __getstate__(self):
        return self.__dict__

    def maybe_repeated(self, h: np.ndarray) -> np.ndarray:
        """True for every hash that occurs at least twice (and a few that do not)."""
        bits = self.bits.value
        out = np.ones(len(h), bool)
        for a in range(0, len(h), PIECE_HASHES):
            for row in cells(h[a:a + PIECE_HASHES], self.n_bits, self.k):
                out[a:a + PIECE_HASHES] &= (bits[row >> np.uint64(3)] >> (row & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def repeat_filter(hashes: DataFrame, n_items: int, bits_per_item: int = 16, max_bits: int = 1 << 28,
                  k: int = 3, min_count: int = 2, values=_first_column) -> RepeatFilter:
    """Build the filter over a frame with one non-null long column, or over what ``values`` takes of each batch.

    ``max_bits`` bounds the broadcast (2**28 cells: 32 MB) and the driver's copy.
    With more items than it was sized for the filter lets more single hashes
    through; no repeated hash is ever missed. With ``min_count`` 1 it holds every hash: a plain Bloom filter.
    """
    n_bits = filter_bits(n_items, bits_per_item, max_bits)
    marked = parts = held(hashes.mapInArrow(_mark(n_bits, k, min_count, values), PARTS_SCHEMA))
    n = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while n > FAN_IN:
        parts = parts.groupBy("slice", F.floor(F.col("part") / FAN_IN).alias("to")).applyInArrow(_regroup, PARTS_SCHEMA)
        n = -(-n // FAN_IN)
    parts = parts.groupBy("slice").applyInArrow(_merge, PARTS_SCHEMA)
    bits = np.zeros(n_bits // 8, np.uint8)
    for r in parts.select("slice", "twice").repartition(max(1, n_bits // JOB_BITS)).toLocalIterator():
        at = _unpack(bytes(r["twice"])).astype(np.int64) + r["slice"] * SLICE_BITS
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    marked.unpersist()  # the filter has it all
    return RepeatFilter(hashes.sparkSession, bits, n_bits, k)


def _regroup(key, table):  # without type hints: half of them would mislead applyInArrow
    out = _merge(table)
    return out.set_column(1, "part", pa.array([int(key[1].as_py())], pa.int64()))
