"""Periodic runs of words, by branching tandem repeats in an enhanced suffix array.

The words of some whole texts are sorted by prefix doubling (only suffixes that still share their rank go on). A symbol is
a word of one text, so no common prefix joins two texts. Every interval of the suffix array with common prefix ``depth``
is tested without a tree: each suffix i outside the interval's largest child asks whether the suffix ``depth`` words after
or before it lies in the same interval. If so, and the words behind the two copies differ, a branching tandem repeat of that
period stands there. All other squares are rotations of these to the left, so the rotations of one square
merge into the run that it closes: its end is known, its start is the common suffix of the two copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .hashing import batch_bytes, hash_words, mix

#: Bytes of text that one numpy pass takes; a longer text is a pass of its own.
CHUNK_BYTES = 1 << 20
#: A run is at least this long, and at least this many times its period.
MIN_LENGTH, MIN_EXPONENT = 6, 4


def suffix_levels(symbols: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(suffix array, its inverse, ranks by the first 1, 2, 4 ... symbols, each with one closing -1).

    ``end`` is where the text of each position ends. Equal ranks at level k mean 2**k equal symbols.
    """
    n = len(symbols)
    sa = np.argsort(symbols, kind="stable")
    first = np.ones(n, bool)
    first[1:] = symbols[sa[1:]] != symbols[sa[:-1]]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    slots = np.arange(n)
    levels, h = [], 1
    while True:
        levels.append(np.append(rank, -1).astype(np.int32))
        shared = ~first
        shared[:-1] |= ~first[1:]
        slots = slots[shared]
        if not len(slots):
            return sa, rank, levels
        i = sa[slots]
        after = i + h
        behind = np.where(after < end[i], levels[-1][np.minimum(after, n)].astype(np.int64) + 1, 0)
        key = rank[i] * (n + 1) + behind
        order = np.argsort(key, kind="stable")
        key, i = key[order], i[order]
        sa[slots] = i
        first = np.ones(len(slots), bool)
        first[1:] = key[1:] != key[:-1]
        rank[i] = np.maximum.accumulate(np.where(first, slots, 0))
        h *= 2


def _common_prefix(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Symbols that the suffixes at ``a`` and ``b`` share; their first ones are equal."""
    a, b = a.copy(), b.copy()
    out = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = (levels[k][a] == levels[k][b]).astype(np.int64) << k
        out += same
        a += same
        b += same
    return out


def _common_suffix(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Symbols right before ``a`` that equal those right before ``b``; a < b, both in the text that starts at ``begin``."""
    out = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x = a - out - (1 << k)
        fits = x >= begin
        x = np.where(fits, x, 0)
        same = fits & (levels[k][x] == levels[k][np.where(fits, x + b - a, 0)])
        out += same.astype(np.int64) << k
    return out


def _bounds(lcp: np.ndarray, at: np.ndarray, widest: int) -> tuple[np.ndarray, np.ndarray]:
    """[first, past) of the suffixes around each place whose common prefixes reach ``lcp[at]``; at most ``widest`` of them."""
    table = [lcp]
    while 1 << len(table) <= widest:
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    depth = lcp[at]
    left, right = at.copy(), at + 1
    for k in range(len(table) - 1, -1, -1):
        step, low = 1 << k, table[k]
        x = left - step
        left = np.where((x >= 0) & (low[np.maximum(x, 0)] >= depth), x, left)
        fits = right < len(low)
        right = np.where(fits & (low[np.where(fits, right, 0)] >= depth), right + step, right)
    return left - 1, right


def branching_squares(symbols: np.ndarray, sa: np.ndarray, isa: np.ndarray, levels: list[np.ndarray], begin: np.ndarray,
                      end: np.ndarray, min_exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the squares whose next word differs from the one a period before, periods up to words / min_exponent."""
    n = len(symbols)
    lcp = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    lcp[at] = _common_prefix(levels, sa[at - 1], sa[at])
    at = at[lcp[at] * min_exponent <= (end - begin)[sa[at]]]
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none
    groups = np.flatnonzero(np.concatenate([[True], levels[0][sa[1:]] != levels[0][sa[:-1]], [True]]))
    lb, rb = _bounds(lcp, at, int(np.diff(groups).max()))
    # the places of one interval, in order, part its children
    order = np.lexsort((at, lcp[at], lb))
    at, lb, rb = at[order], lb[order], rb[order]
    depth = lcp[at]
    new = np.ones(len(at), bool)
    new[1:] = (lb[1:] != lb[:-1]) | (depth[1:] != depth[:-1])
    last = np.append(new[1:], True)
    interval = np.cumsum(new) - 1
    heads, tails = np.flatnonzero(new), np.flatnonzero(last)
    # one child begins at each place and one more at the interval's first suffix
    c_from = np.concatenate([lb[heads], at])
    c_to = np.concatenate([at[heads], np.where(last, rb, np.append(at[1:], 0))])
    c_of = np.concatenate([np.arange(len(heads)), interval])
    size = c_to - c_from
    order = np.lexsort((-size, c_of))
    small = np.ones(len(order), bool)
    small[np.searchsorted(c_of[order], np.arange(len(heads)))] = False  # the largest of each interval
    order = order[small]
    c_from, size, c_of = c_from[order], size[order], c_of[order]
    slot = np.repeat(c_from - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
    of = np.repeat(c_of, size)
    i, d, low, high = sa[slot], depth[heads][of], lb[heads][of], rb[tails][of]
    starts, periods = [], []
    for j, ok in ((i, i + d < end[i]), (i - d, i - d >= begin[i])):  # the square begins at i, or ends its first copy there
        other = isa[np.where(ok, i + d if j is i else j, 0)]
        ok &= (low <= other) & (other < high)
        j, p = j[ok], d[ok]
        past = j + 2 * p
        inside = past < end[j]
        branch = ~inside | (symbols[j + p] != symbols[np.where(inside, past, 0)])
        starts.append(j[branch])
        periods.append(p[branch])
    both = np.unique(np.stack([np.concatenate(starts), np.concatenate(periods)], 1), axis=0)
    return both[:, 0], both[:, 1]


def find_runs(words: np.ndarray, counts: np.ndarray, min_length: int = MIN_LENGTH,
              min_exponent: int = MIN_EXPONENT) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs, in order of text, start, period. ``words`` are the texts' word hashes end to end."""
    none = (np.zeros(0, np.int64),) * 4
    if not len(words):
        return none
    text = np.repeat(np.arange(len(counts)), counts)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    begin, end = bounds[text], bounds[text + 1]
    symbols = mix(words ^ mix(text.astype(np.uint64) + np.uint64(1)))
    sa, isa, levels = suffix_levels(symbols, end)
    square, period = branching_squares(symbols, sa, isa, levels, begin, end, min_exponent)
    if not len(square):
        return none
    start = square - _common_suffix(levels, square, square + period, begin[square])
    length = square + 2 * period - start
    keep = length >= np.maximum(min_length, min_exponent * period)
    start, length, period = start[keep], length[keep], period[keep]
    # a stretch with period q has the multiples of q as well: the smallest counts
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    of = text[start]
    return of, start - bounds[of], length, period


def _collapse(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words that no run contains after its first period, parted by blanks."""
    out, at = [], 0
    for a, z in sorted(zip((start + period).tolist(), (start + length).tolist(), strict=True)):
        if z > at:
            out += words[at:max(a, at)]
            at = z
    return b" ".join(out + words[at:])


def _runs(min_length: int, min_exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = batch_bytes(b.column(1))
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(off, off[at] + CHUNK_BYTES, "right")) - 1)
                part = raw[off[at]:off[to]]
                words, counts = hash_words(part, off[at:to + 1] - off[at], lower=False)
                of, start, length, period = find_runs(words, counts, min_length, min_exponent)
                cut = np.searchsorted(of, np.arange(to - at + 1))
                data = part.tobytes()
                kept = []
                for k in range(to - at):
                    mine = slice(cut[k], cut[k + 1])
                    text = data[off[at + k] - off[at]:off[at + k + 1] - off[at]].split()
                    kept.append(_collapse(text, start[mine], length[mine], period[mine]))
                runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, to - at), pa.array(counts, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(cut, pa.int32()), runs), pa.array(kept, pa.binary())],
                    ["doc_id", "n_words", "runs", "kept"])
                at = to
    return run


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, runs (start, length, period, by start, then period), kept (UTF-8 bytes).

    Words are what white space (blank, tab to carriage return) parts, equal by 64-bit hash. A run is a stretch of words with smallest
    period q, at least ``min_length`` words and ``min_exponent`` (2 or more) periods long, that no neighbouring word
    extends. kept holds the words that no run contains after its first q words, parted by one blank.

    Null, empty and blank texts have no words and no runs; a null id stays null. Every row is judged by itself, so
    repeated rows and ids each give their row and ties cannot arise. Other columns are not read; an empty table gives an empty result.
    Nothing is shuffled. Texts are taken together up to CHUNK_BYTES; a longer text needs memory in proportion to itself.
    """
    if min_exponent < 2 or min_length < 1:
        raise ValueError("min_exponent must be at least 2 and min_length at least 1")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return src.mapInArrow(_runs(min_length, min_exponent),
                          "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, kept binary")
