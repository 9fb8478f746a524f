"""Repeated byte strings across all documents, by induced suffix sorting of shards.

Every window of ``length`` bytes is dealt to a shard by the least-hashed k-gram in it, so
equal windows always meet, whatever document they are in. Neighbouring windows with the same
least k-gram form one segment, which travels as one string. Windows whose k-gram occurs once
(a counting filter says so) are no repeats and stay at home; equal segments are
collapsed to their earliest copy before they shuffle, for all windows of a later copy start
later than the same windows of the first. What is left of a shard is sorted by
induction, and permuted common prefixes of at least ``length`` bytes show the windows that also start earlier.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .bloom import repeat_filter
from .common import join_stats, written
from .hashing import BASE, BASE_INV, BYTE_VALUE, batch_bytes, mix, powers
from .suffix_sort import repeated_starts

#: Bytes of text that one numpy pass takes, and rows that a task collapses at a time.
CHUNK_BYTES = 1 << 20
COLLAPSE_ROWS = 150_000
#: Bytes of segments in one suffix array.
SHARD_BYTES = 1 << 20
#: Bytes of the segments of one k-gram beyond which they are compared by window hashes, so no task holds them whole.
HOT_BYTES = 16 << 20
#: A second polynomial over the bytes, for window hashes of 128 bits.
BASE_2 = 0xD1342543DE82EF95
BASE_2_INV = pow(BASE_2, -1, 2**64)
BYTE_VALUE_2 = mix(BYTE_VALUE ^ np.uint64(0x9E3779B97F4A7C15))
_LOW = np.uint64(127)


def _geometry(length: int) -> tuple[int, int]:
    """(bytes of a k-gram, k-grams in a window); the second is below 128."""
    if length < 8:
        raise ValueError("length must be at least 8 bytes")
    in_window = min(69, length - 3)
    return length - in_window + 1, in_window


class Cutter:
    """Cuts pieces of whole documents into segments."""

    def __init__(self, length: int):
        self.length = length
        self.k, self.w = _geometry(length)
        self._tables(CHUNK_BYTES)

    def _tables(self, n: int) -> None:
        """Powers, block starts and places in a block for up to n bytes."""
        self.n = n
        self.pow, self.inv = powers(BASE, n + 1), powers(BASE_INV, n + 1)
        at = np.arange(n + self.w)
        self.block = at // self.w * self.w
        self.place = (at - self.block).astype(np.uint64)

    def segments(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, first window, last window, least k-gram, digest); window starts are within ``raw``."""
        n, k, w, length = len(raw), self.k, self.w, self.length
        empty = tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
        if n < length:
            return empty
        if n > self.n:
            self._tables(2 * n)
        pre = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUE[raw] * self.pow[:n], out=pre[1:])
        count = n - k + 1
        m = -(-count // w) * w
        packed = np.full(m, np.uint64(2**64 - 1))
        grams = packed[:count]
        np.subtract(pre[k:], pre[:-k], out=grams)
        grams *= self.inv[:count]
        grams[:] = mix(grams)
        grams &= ~_LOW
        grams |= self.place[:count]
        blocks = packed.reshape(-1, w)
        windows = n - length + 1
        left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[:windows]
        right = np.minimum.accumulate(blocks, axis=1).ravel()[w - 1:w - 1 + windows]
        use_left = (left | _LOW) <= (right | _LOW)
        least = np.where(use_left, left, right)
        pos = np.where(use_left, self.block[:windows], self.block[w - 1:w - 1 + windows])
        pos += (least & _LOW).astype(np.int64)
        cut = np.ones(windows, bool)
        np.not_equal(pos[1:], pos[:-1], out=cut[1:])
        edges = np.concatenate([off[:-1], off[1:] - length + 1])  # where a document, or what is left of it, begins
        cut[edges[(edges >= 0) & (edges < windows)]] = True
        first = np.flatnonzero(cut)
        last = np.append(first[1:], windows) - 1
        doc = np.searchsorted(off, first, "right") - 1
        keep = first + length <= off[doc + 1]
        first, last, doc = first[keep], last[keep], doc[keep]
        end = last + length
        digest = mix((pre[end] - pre[first]) * self.inv[first] + (end - first).astype(np.uint64))
        return doc, first, last, least[first] >> np.uint64(7), digest


def _pieces(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for b in batches:
        raw, off = batch_bytes(b.column(text_at))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + CHUNK_BYTES, "right")) - 1)
            yield b.slice(at, end - at), raw[off[at]:off[end]], off[at:end + 1] - off[at]
            at = end


def _least_grams(length: int):
    def run(batches):
        cutter = Cutter(length)
        for _, raw, off in _pieces(batches, 2):
            yield pa.RecordBatch.from_arrays([pa.array(cutter.segments(raw, off)[3].view(np.int64))], ["h"])
    return run


def _collapse(rows: list[tuple], length: int) -> pa.RecordBatch:
    """Of equal segments the earliest goes on; the others are removed whole, as merged spans."""
    doc, uid, start, size, h, digest = (np.concatenate(x) for x in zip(*rows, strict=True))
    both = mix(h * np.uint64(0x9E3779B97F4A7C15) ^ digest)
    order = np.lexsort((start, uid, doc, both))
    # rows that repeat id and text are one document: their segments coincide
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (doc, uid, start, h, digest)], axis=0)
    order = order[new]
    doc, uid, start, size, h, digest, both = (x[order] for x in (doc, uid, start, size, h, digest, both))
    first = np.ones(len(doc), bool)
    first[1:] = (both[1:] != both[:-1]) | (h[1:] != h[:-1]) | (digest[1:] != digest[:-1])
    u, a, z = uid[~first], start[~first], (start + size)[~first]
    order = np.lexsort((a, u))
    u, a, z = u[order], a[order], z[order]
    if len(u):
        new = np.ones(len(u), bool)
        new[1:] = (u[1:] != u[:-1]) | (a[1:] > z[:-1])
        at = np.flatnonzero(new)
        u, a, z = u[at], a[at], np.maximum.reduceat(z, at)
    k = len(u)
    gone = lambda x: pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(x.view(np.int64))])
    return pa.RecordBatch.from_arrays(
        [gone(h[first]), gone(digest[first]), gone(doc[first]), pa.array(np.concatenate([u, uid[first]])),
         pa.array(np.concatenate([a, start[first]])), pa.array(np.concatenate([z, (start + size)[first]]))],
        ["h", "digest", "doc", "uid", "a", "z"])


def _maybe_repeated(length: int, filt):
    def run(batches):
        cutter, rows, held = Cutter(length), [], 0
        for b, raw, off in _pieces(batches, 2):
            doc, first, last, h, digest = cutter.segments(raw, off)
            keep = filt.maybe_repeated(h)
            doc, first, last, h, digest = (x[keep] for x in (doc, first, last, h, digest))
            if not len(doc):
                continue
            ids = b.column(0).to_numpy(zero_copy_only=False)
            uids = b.column(1).to_numpy(zero_copy_only=False)
            start = first - off[doc]
            rows.append((ids[doc], uids[doc], start, last - first + length, h, digest))
            held += len(doc)
            if held >= COLLAPSE_ROWS:
                yield _collapse(rows, length)
                rows, held = [], 0
        if rows:
            yield _collapse(rows, length)
    return run


def _key(uid: np.ndarray, start: np.ndarray) -> np.ndarray:
    """What the filter of wanted segments hashes; Spark builds it by the same shift and exclusive or."""
    return ((uid.astype(np.int64) << 24) ^ start).view(np.uint64)


def _segment_texts(length: int, filt):
    def run(batches):
        cutter = Cutter(length)
        for b, raw, off in _pieces(batches, 2):
            doc, first, last, _, _ = cutter.segments(raw, off)
            uid = b.column(1).to_numpy(zero_copy_only=False)[doc]
            start = first - off[doc]
            want = np.flatnonzero(filt.maybe_repeated(_key(uid, start)))
            if len(want):
                data = raw.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid[want]), pa.array(start[want]),
                     pa.array([data[first[i]:last[i] + length] for i in want], pa.binary())], ["uid", "a", "segment"])
    return run


def _windows(length: int):
    """(doc, uid, a, segment) -> (w1, w2, doc, uid, a) of every window of ``length`` bytes."""
    def run(batches):
        for b, raw, off in _pieces(batches, 3):
            n = len(raw)
            row = np.repeat(np.arange(b.num_rows), np.diff(off))
            at = np.arange(n)
            at = at[at + length <= off[row + 1]]
            row = row[at]
            both = []
            for base, inv, value in ((BASE, BASE_INV, BYTE_VALUE), (BASE_2, BASE_2_INV, BYTE_VALUE_2)):
                pre = np.zeros(n + 1, np.uint64)
                np.cumsum(value[raw] * powers(base, n + 1)[:n], out=pre[1:])
                both.append(pa.array(mix((pre[at + length] - pre[at]) * powers(inv, n + 1)[at]).view(np.int64)))
            a = b.column(2).to_numpy(zero_copy_only=False)[row] + at - off[row]
            yield pa.RecordBatch.from_arrays([*both, b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(a, pa.int64())],
                                             ["w1", "w2", "doc", "uid", "a"])
    return run


def _late_windows(segments: DataFrame, length: int) -> DataFrame:
    """(uid, a, z) of the windows that also start earlier: their earliest places come from partial aggregates."""
    rows = written(segments.select("doc", "uid", "a", "segment").mapInArrow(
        _windows(length), "w1 long, w2 long, doc long, uid long, a long"), "windows")
    first = rows.groupBy("w1", "w2").agg(F.min(F.struct("doc", "uid", "a")).alias("first"), F.count("*").alias("c")).filter("c > 1")
    found = join_stats(rows, first.withColumnRenamed("w2", "second"), "w1", "c", rows.count()).filter("w2 = second")
    return found.filter(F.expr("first <> struct(doc, uid, a)")).select("uid", "a", (F.col("a") + length).alias("z"))


def _sort_shards(length: int):
    """Rows come ordered by h. Whole groups of one h fill shards of about SHARD_BYTES."""
    def shard(rows: pa.Table) -> pa.RecordBatch:
        doc, uid, a = (rows.column(c).to_numpy() for c in ("doc", "uid", "a"))
        rank = np.empty(len(doc), np.int64)
        rank[np.lexsort((a, uid, doc))] = np.arange(len(doc))
        us, starts, ends = [], [], []
        for i, late in enumerate(repeated_starts(rows.column("segment").to_pylist(), rank, length)):
            if len(late):
                new = np.flatnonzero(np.append(True, np.diff(late) > 1))
                us.append(np.full(len(new), uid[i]))
                starts.append(a[i] + late[new])
                ends.append(a[i] + late[np.append(new[1:], len(late)) - 1] + length)
        cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.RecordBatch.from_arrays([cat(us), cat(starts), cat(ends)], ["uid", "a", "z"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += b.column("segment").nbytes
            while size >= SHARD_BYTES:
                rows = pa.Table.from_batches(held)
                h = rows.column("h").to_numpy()
                cum = np.cumsum([len(s) for s in rows.column("segment").to_pylist()])
                cuts = np.flatnonzero(h[1:] != h[:-1]) + 1
                if not len(cuts):
                    break  # one group: it needs its end
                cut = cuts[min(int(np.searchsorted(cum[cuts - 1], SHARD_BYTES)), len(cuts) - 1)]
                yield shard(rows.slice(0, cut))
                rest = rows.slice(cut).combine_chunks()
                held = rest.to_batches()
                size = int(cum[-1] - cum[cut - 1])
        if held:
            rows = pa.Table.from_batches(held)
            if rows.num_rows:
                yield shard(rows)
    return run


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans a and z) -> (doc_id, n_bytes, spans, kept)."""
    for b in batches:
        raw, off = batch_bytes(b.column(1))
        data = raw.tobytes()
        a_col, z_col = b.column(2).to_pylist(), b.column(3).to_pylist()
        spans, kept = [], []
        for i in range(b.num_rows):
            text = data[off[i]:off[i + 1]]
            if not a_col[i]:
                spans.append([])
                kept.append(text)
                continue
            merged: list[list[int]] = []
            for a, z in sorted(zip(a_col[i], z_col[i], strict=True)):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], z)
                else:
                    merged.append([a, z])
            at, parts = 0, []
            for a, z in merged:
                parts.append(text[at:a])
                at = z
            kept.append(b"".join(parts) + text[at:])
            spans.append([{"start": a, "end": z} for a, z in merged])
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(np.diff(off), pa.int64()),
             pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, spans (maximal removed runs, in bytes), kept (remaining bytes).

    A byte goes if a string of ``length`` bytes covers it that also starts earlier: in a smaller
    doc_id, or earlier in the same text. Strings are judged on the input; overlaps count.
    Null text is empty; texts shorter than ``length`` lose nothing. A null id is before all others; texts that share an id are
    ordered by a hash of their text; rows that repeat both id and text are one document, and each
    gets its result. Only the two named columns are read; an empty table gives an empty result.

    Texts are read three times in place and shuffled once, to meet their spans. The filters are at most 32 MB each.
    Equality of k-grams and segments is by 64-bit hashes of their bytes (57 bits of the
    first with 64 of the second); windows are compared byte by byte in the suffix arrays, but those of a k-gram
    with over HOT_BYTES of segments by 128-bit hashes, so that no task holds all of them.
    """
    lowest = -(2**63)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docid = F.col(id_col).cast("long")
    src = docs.select(F.coalesce(docid, F.lit(lowest)).alias("doc"), F.xxhash64(docid, text).alias("uid"), text.alias("text"))
    total = src.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    k, w = _geometry(length)
    grams = src.mapInArrow(_least_grams(length), "h long")
    filt = repeat_filter(grams, 2 * total // (w + 1) + 1, k=1)
    rows = written(src.mapInArrow(_maybe_repeated(length, filt), "h long, digest long, doc long, uid long, a long, z long"), "segments")
    n = 2 * total // (w + 1)  # segments, about
    spans = rows.filter("digest is null").select("uid", "a", "z")
    # at most one row of a segment comes from each collapsed piece of a task
    one = W.partitionBy("h", "digest").orderBy("doc", "uid", "a")
    ranked = written(rows.filter("digest is not null").withColumn("copy", F.rank().over(one)).drop("digest"), "ranked", n)
    spans = spans.unionByName(ranked.filter("copy > 1").select("uid", "a", "z"))
    first = ranked.filter("copy = 1").drop("copy").dropDuplicates(["h", "uid", "a"])
    several = first.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    mixed = written(first.join(several.select("h"), "h", "left_semi"), "mixed", n)
    keys = mixed.select(F.shiftleft("uid", 24).bitwiseXOR(F.col("a")).alias("key"))
    want = repeat_filter(keys, mixed.count(), min_count=1)
    texts = src.mapInArrow(_segment_texts(length, want), "uid long, a long, segment binary").dropDuplicates(["uid", "a"])
    shards = mixed.join(texts, ["uid", "a"]).select("h", "doc", "uid", "a", "segment")
    hot = written(mixed.groupBy("h").agg(F.sum(F.col("z") - F.col("a")).alias("bytes")).filter(F.col("bytes") > HOT_BYTES).select("h"), "hot", n)
    if hot.limit(1).count():  # at most as many as the text has times HOT_BYTES
        spans = spans.unionByName(_late_windows(shards.join(F.broadcast(hot), "h", "left_semi"), length))
        shards = shards.join(F.broadcast(hot), "h", "left_anti")
    late = shards.repartition("h").sortWithinPartitions("h").mapInArrow(_sort_shards(length), "uid long, a long, z long")
    spans = spans.unionByName(late).groupBy("uid").agg(F.collect_list("a").alias("a"), F.collect_list("z").alias("z"))
    return docs.select(docid.alias("doc_id"), text.alias("text"), F.xxhash64(docid, text).alias("uid")) \
        .join(spans, "uid", "left").select("doc_id", "text", "a", "z") \
        .mapInArrow(_cut_out, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
