"""Repeated word windows across documents, by recompression.

A text is parsed in rounds. Each round first names the runs of one symbol (``run of k a``; in the first RUN_ROUNDS rounds),
then the pairs: a symbol's name and the round put it in the left or the right class, and every left symbol before a
right one becomes one symbol with it. A name is a fingerprint of what it stands for, so it is the same in all
documents and on all executors, and equal substrings get equal symbols inside, away from their ends. How far that holds is
carried along: every symbol knows the range of words, its reach, that alone decides that it stands there.

A window of ``length`` words is filed under the highest symbol whose reach it contains (of several the one with the
least hash, then the first), together with the words in the reach. This depends on the window's words alone, so equal windows
always come under the same name, and neighbouring windows under one symbol travel as one segment. Spark then counts
names over all documents: what stands in one document only is no repeat. Of equal segments the smallest document keeps its own, and only
where one name has different segments are their windows verified one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import join_stats, written
from .hashing import BASE, BASE_INV, IS_SPACE, batch_bytes, mix, powers, word_chunks

#: Bytes of text that one numpy pass takes; a longer text is taken in pieces that overlap by a window.
CHUNK_BYTES = 1 << 20
#: Rounds of naming, of which the first also name runs. A round leaves about three of four symbols.
ROUNDS, RUN_ROUNDS = 6, 2
#: A second polynomial over the word hashes.
BASE_2 = 0xD1342543DE82EF95
BASE_2_INV = pow(BASE_2, -1, 2**64)
#: Fixed odd values that part the kinds of names.
RUN_NAME, LEFT_NAME, RIGHT_NAME = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
PLACE_BITS = np.uint64(21)
SEGMENT_SCHEMA = "key long, digest long, doc long, uid long, p int, n int, again int"


class Symbols:
    """The symbols of some texts end to end after a round: name, first word, reach [low, high), number of the text."""

    def __init__(self, name, at, low, high, text):
        self.name, self.at, self.low, self.high, self.text = name, at, low, high, text

    def neighbours(self, begin: np.ndarray, end: np.ndarray):
        """(same text as the next, reach of the symbol before, of the one after); beyond a text's ends nothing is known."""
        n = len(self.name)
        same = np.zeros(n, bool)
        same[:-1] = self.text[1:] == self.text[:-1]
        before, after = begin[self.text] - 1, end[self.text] + 1
        inner = np.flatnonzero(same)
        before[inner + 1] = self.low[inner]
        after[inner] = self.high[inner + 1]
        return same, before, after


def name_runs(s: Symbols, begin: np.ndarray, end: np.ndarray) -> Symbols:
    """Every longest run of one symbol becomes one; that a symbol stands alone is known from both its neighbours."""
    same, before, after = s.neighbours(begin, end)
    joined = same.copy()
    joined[:-1] &= s.name[1:] == s.name[:-1]
    head = np.flatnonzero(np.append(True, ~joined[:-1]))
    tail = np.append(head[1:], len(s.name)) - 1
    k = (tail - head + 1).astype(np.uint64)
    name = np.where(k > 1, mix(s.name[head] * RUN_NAME + k), s.name[head])
    return Symbols(name, s.at[head], before[head], after[tail], s.text[head])


def name_pairs(s: Symbols, begin: np.ndarray, end: np.ndarray, number: int) -> Symbols:
    """A left symbol and the right one after it become one. A lone left symbol has looked at its successor, a lone right one at its predecessor."""
    same, before, after = s.neighbours(begin, end)
    salt = np.uint64((number + 1) * int(LEFT_NAME) % 2**64)
    right = (mix(s.name + salt) >> np.uint64(63)).astype(bool)
    pair = same & ~right
    pair[:-1] &= right[1:]
    second = np.zeros(len(pair), bool)
    second[1:] = pair[:-1]
    low = np.where(right & ~second, before, s.low)
    high = np.where(right | pair, s.high, after)
    head = np.flatnonzero(~second)
    tail = head + pair[head]
    name = np.where(pair[head], mix(s.name[head] * LEFT_NAME + mix(s.name[tail] * RIGHT_NAME)), s.name[head])
    return Symbols(name, s.at[head], low[head], high[tail], s.text[head])


def parse(words: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> list[Symbols]:
    """The symbols of every round, words first."""
    text = np.repeat(np.arange(len(counts)), counts)
    end = np.cumsum(counts)
    begin = end - counts
    at = np.arange(len(words))
    levels = [Symbols(words, at, at, at + 1, text)]
    for k in range(rounds):
        s = levels[-1]
        if k < RUN_ROUNDS:
            s = name_runs(s, begin, end)
        levels.append(name_pairs(s, begin, end, k))
    return levels


class Prefix:
    """Hashes of word ranges in constant time: sum of word * base**place modulo 2**64, shifted to place 0."""

    def __init__(self, words: np.ndarray, base: int, inverse: int):
        self.sum = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * powers(base, len(words) + 1)[:len(words)], out=self.sum[1:])
        self.inverse = powers(inverse, len(words) + 1)

    def of(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        return mix((self.sum[z] - self.sum[a]) * self.inverse[a] + (z - a).astype(np.uint64))


def _least(levels_of: np.ndarray, low: np.ndarray, past: np.ndarray) -> np.ndarray:
    """The least value of every non-empty range [low, past)."""
    size = past - low
    k = np.frexp(size.astype(np.float64))[1] - 1
    table, out = levels_of, np.empty(len(low), levels_of.dtype)
    for step in range(int(k.max(initial=0)) + 1):
        if step:
            half = 1 << (step - 1)
            table = np.minimum(table[:-half], table[half:])
        of = np.flatnonzero(k == step)
        out[of] = np.minimum(table[low[of]], table[past[of] - (1 << step)])
    return out


def segments(words: np.ndarray, counts: np.ndarray, length: int, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, key, digest, how many such segments follow each other by one word) of texts end to end."""
    end = np.cumsum(counts)
    begin = end - counts
    n_windows = np.maximum(counts - length + 1, 0)
    total = int(n_windows.sum())
    if not total:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),)
    text = np.repeat(np.arange(len(counts)), n_windows)
    p = np.arange(total) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows) + begin[text]
    n = len(words)
    anchor, key = np.full(total, -1, np.int64), np.zeros(total, np.uint64)
    inner, outer = Prefix(words, BASE_2, BASE_2_INV), Prefix(words, BASE, BASE_INV)
    levels = parse(words, counts, rounds)
    open_ = np.arange(total)
    offset = np.zeros(total, np.int64)
    for number in range(len(levels) - 1, -1, -1):
        s = levels[number]
        # symbols [first, past) have their reach in the window: both ends of the reach grow with the symbol
        lows, highs = np.cumsum(np.bincount(s.low + 1, minlength=n + 2)), np.cumsum(np.bincount(s.high, minlength=n + 2))
        first, past = lows[p[open_]], highs[p[open_] + length]
        found = np.flatnonzero(past > first)
        if len(found):
            place = np.arange(len(s.name), dtype=np.uint64)
            order = (mix(s.name ^ RIGHT_NAME) >> PLACE_BITS << PLACE_BITS) | place
            best = (_least(order, first[found], past[found]) & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
            at = open_[found]
            anchor[at] = best + (number << 32)
            offset[at] = s.low[best]
            key[at] = mix(s.name[best] + np.uint64(number)) ^ inner.of(s.low[best], s.high[best])
            open_ = np.delete(open_, found)
        if not len(open_):
            break
    new = np.ones(total, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, total))
    text, p, key, offset = text[head], p[head], key[head], offset[head]
    digest = mix(outer.of(p, p + size - 1 + length) ^ mix((offset - p).astype(np.uint64) * LEFT_NAME + size.astype(np.uint64)))
    # inside a long run every window has its own symbol and all segments are equal: they go on as one
    more = np.zeros(len(head), bool)
    more[1:] = (text[1:] == text[:-1]) & (p[1:] == p[:-1] + 1) & (key[1:] == key[:-1]) & (digest[1:] == digest[:-1])
    head = np.flatnonzero(~more)
    again = np.diff(np.append(head, len(more)))
    return text[head], p[head] - begin[text[head]], size[head], key[head], digest[head], again


def _pieces(batches: Iterator[pa.RecordBatch], text_at: int, length: int):
    """(batch, first row, words, words of each text, words before the piece): a long text comes in pieces that overlap by a window."""
    for b in batches:
        raw, off = batch_bytes(b.column(text_at))
        last, done, tail = -1, 0, None
        for at, words, counts in word_chunks(raw, off, CHUNK_BYTES, IS_SPACE, lower=False):
            if at != last:
                done, tail = 0, words[:0]
            joined = np.concatenate([tail, words]) if len(tail) else words
            yield b, at, joined, counts + (len(tail) if len(counts) == 1 else 0), done - len(tail)
            if len(counts) == 1:
                done += len(words)
                last, tail = at, joined[max(0, len(joined) - length + 1):]


def _segments(length: int, rounds: int):
    """(doc, uid, text) -> segments."""
    def run(batches):
        for b, at, words, counts, done in _pieces(batches, 2, length):
            text, p, n, key, digest, again = segments(words, counts, length, rounds)
            if len(text):
                row = pa.array(text + at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(digest.view(np.int64)), b.column(0).take(row), b.column(1).take(row),
                     *(pa.array(x, pa.int32()) for x in (p + done, n, again))], ["key", "digest", "doc", "uid", "p", "n", "again"])
    return run


def _windows(length: int):
    """(doc, uid, text, parts (key, p, n)) -> (key, window, doc, uid, p) of the windows of each part."""
    def run(batches):
        for b, at, words, counts, done in _pieces(batches, 2, length):
            parts = b.column(3).slice(at, len(counts))
            inside = np.diff(parts.offsets.to_numpy())
            flat = parts.flatten()
            key, p, n = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("key", "p", "n"))
            text = np.repeat(np.arange(len(counts)), inside)
            row = np.repeat(np.arange(len(p)), n)
            start = p[row].astype(np.int64) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) - done
            here = (start >= 0) & (start + length <= counts[text[row]])
            row, start = row[here], start[here]
            begin = (np.cumsum(counts) - counts)[text[row]]
            if len(row):
                window = Prefix(words, BASE, BASE_INV).of(begin + start, begin + start + length)
                of = pa.array(text[row] + at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[row]), pa.array(window.view(np.int64)), b.column(0).take(of), b.column(1).take(of),
                     pa.array(start + done, pa.int32())], ["key", "window", "doc", "uid", "p"])
    return run


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans (a, z) or null) -> (doc_id, n_words, spans, kept)."""
    for b in batches:
        raw, off = batch_bytes(b.column(1))
        data = raw.tobytes()
        n_words, spans, kept = [], [], []
        for i, got in enumerate(b.column(2).to_pylist()):
            text = data[off[i]:off[i + 1]].split()
            merged: list[list[int]] = []
            for a, z in sorted((s["a"], s["z"]) for s in got or ()):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], z)
                else:
                    merged.append([a, z])
            out, at = [], 0
            for a, z in merged:
                out += text[at:a]
                at = z
            n_words.append(len(text))
            kept.append(b" ".join(out + text[at:] if merged else text))
            spans.append([{"start": a, "end": z} for a, z in merged])
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(n_words, pa.int64()),
             pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
            ["doc_id", "n_words", "spans", "kept"])


def _with_stats(rows: DataFrame, stats: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Inner join with one ``stats`` row per ``keys`` and its count c of rows; the few keys that hold many of the ``total`` rows are broadcast."""
    name = F.xxhash64(*keys).alias("name")
    out = join_stats(rows.select(name, "*"), stats.select(name, *(F.col(k).alias(f"{k}_") if k in keys else F.col(k) for k in stats.columns)),
                     "name", "c", total)
    for k in keys:
        out = out.filter(F.col(k) == F.col(f"{k}_"))
    return out.drop("name", "c", *(f"{k}_" for k in keys))


def remove_repeated_windows(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text",
                            rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: doc_id, n_words, spans (maximal removed stretches, in words), kept (UTF-8: the words that stay, parted by one blank).

    Words are what white space (blank, tab to carriage return) parts, unchanged. A word goes if a window of ``length`` words covers
    it whose words also stand, in order, in a document with a smaller id; windows are judged on the input. What a text repeats
    of itself, or rows with one id repeat of each other, stays. Null, empty and blank texts have no words; texts with fewer words than a window
    lose none. A null id is smaller than all others. Texts that share an id are told apart by a hash of their text; rows that
    repeat both are one document, each with its result. Other columns are not read; an empty table gives an empty result.

    Exact up to hashes: windows are equal if the 64-bit hash of their name and the words in its reach and a second 64-bit
    hash of all their words agree. Segments and those of shared names are written when this is called. Texts are read in place,
    those with unclear segments once more, and shuffled once to meet their spans. ``rounds`` changes the work, not the result.
    """
    if length < 2:
        raise ValueError("length must be at least 2 words")
    docid, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc, uid = F.coalesce(docid, F.lit(-(2**63))), F.xxhash64(docid, text)
    src = docs.select(doc.alias("doc"), uid.alias("uid"), text.alias("text"))
    found = written(src.mapInArrow(_segments(length, rounds), SEGMENT_SCHEMA), "segments")
    # names over all documents: only what stands in several of them goes on
    names = found.groupBy("key").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count("*").alias("c")).filter("least < most")
    common = written(_with_stats(found, written(names.select("key", "c"), "names"), ["key"], found.count()), "shared")
    equal = written(common.groupBy("key", "digest").agg(F.min("doc").alias("first"), F.count("*").alias("c")), "equal")
    several = written(equal.groupBy("key").agg(F.count("*").alias("digests")).filter("digests > 1"), "several")
    known = written(equal.join(several, "key", "left"), "known")
    rows = written(_with_stats(common, known, ["key", "digest"], common.count()).filter("doc > first or digests is not null"), "judged")
    # a later copy of a segment goes whole
    whole = rows.filter("doc > first").select("doc", "uid", F.col("p").alias("a"), (F.col("p") + F.col("n") + F.col("again") + (length - 2)).alias("z"))
    # different segments of one name may share some windows
    unclear = rows.filter("doc = first").select("doc", "uid", F.struct("key", "p", (F.col("n") + F.col("again") - 1).alias("n")).alias("part")).distinct()
    parts = unclear.groupBy("doc", "uid").agg(F.collect_list("part").alias("parts"))
    texts = src.join(parts.select("doc", "uid"), ["doc", "uid"], "left_semi").dropDuplicates(["doc", "uid"])
    windows = written(texts.join(parts, ["doc", "uid"]).select("doc", "uid", "text", "parts").mapInArrow(
        _windows(length), "key long, window long, doc long, uid long, p int"), "windows")
    least = windows.groupBy("key", "window").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count("*").alias("c")).filter("least < most")
    least = written(least.drop("most"), "least")
    late = _with_stats(windows, least, ["key", "window"], windows.count()).filter("doc > least")
    single = late.select("doc", "uid", F.col("p").alias("a"), (F.col("p") + length).alias("z"))
    spans = whole.unionByName(single).distinct().groupBy("doc", "uid").agg(F.collect_list(F.struct("a", "z")).alias("spans"))
    mine = docs.select(docid.alias("doc_id"), doc.alias("doc"), uid.alias("uid"), text.alias("text"))
    return mine.join(spans, ["doc", "uid"], "left").select("doc_id", "text", "spans").mapInArrow(
        _cut_out, "doc_id long, n_words long, spans array<struct<start: long, end: long>>, kept binary")
