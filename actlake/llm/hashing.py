"""Batch hashing of words, shingles and byte k-grams with numpy.

Every function works on the concatenated UTF-8 bytes of one Arrow batch, so a
task touches its texts with a few array passes and no per-word Python.
Equal byte strings give equal 64-bit hashes in every task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240229))
#: A random value for each byte and an odd base: fixed by the seed above.
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = int(_RNG.integers(2**62, 2**63)) * 2 + 1
BASE_INV = pow(BASE, -1, 2**64)
#: The whitespace of the word rule: [\x20\x09-\x0D].
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (every input bit reaches every output bit)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done:done + step] = out[:step] * np.uint64(pow(base, done, 2**64))
        done += step
    return out


def batch_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts end to end, offsets of length rows + 1); null is empty."""
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset:col.offset + len(col) + 1]
    if data is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
    return raw, offsets - offsets[0]


def hash_words(raw: np.ndarray, offsets: np.ndarray, lower: bool = True,
               space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, words of each text). A word is a run of bytes that ``space`` does not mark, within one text."""
    n_docs = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(n_docs, np.int64)
    b = LOWER[raw] if lower else raw
    inside = ~space[b]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(raw)]
    starts[firsts] = inside[firsts]
    at = np.flatnonzero(starts)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(n_docs, np.int64)
    pos = np.flatnonzero(inside)
    first_pos = np.flatnonzero(starts[pos])
    lens = np.diff(np.append(first_pos, len(pos)))
    within = np.arange(len(pos)) - np.repeat(first_pos, lens)
    vals = BYTE_VALUE[b[pos]] * powers(BASE, int(lens.max()))[within]
    words = mix(np.add.reduceat(vals, first_pos) + lens.astype(np.uint64))
    counts = np.diff(np.searchsorted(at, offsets))
    return words, counts


def shingles(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every k-word shingle, shingles of each text).

    A text with 1 to k-1 words gives its whole sequence as one shingle; one
    without words gives none.
    """
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    if not len(words):
        return np.zeros(0, np.uint64), n
    p = powers(BASE, k)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    idx = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
    left = np.minimum(np.repeat(counts, n), k)
    h = np.zeros(len(idx), np.uint64)
    for j in range(k):
        h += np.where(j < left, padded[idx + j] * p[j], np.uint64(0))
    return mix(h + left.astype(np.uint64)), n


def word_chunks(raw: np.ndarray, offsets: np.ndarray, limit: int, space: np.ndarray = IS_SPACE, lower: bool = True):
    """(first text, word hashes, words of each text) of texts end to end, about ``limit`` bytes at a time.

    A text of more bytes comes by itself, in several chunks in order, each cut between two words.
    """
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        low, end = int(offsets[at]), int(offsets[to])
        if end - low <= limit:
            yield at, *hash_words(raw[low:end], offsets[at:to + 1] - low, lower, space)
        while end - low > limit:  # one text
            gaps = np.flatnonzero(space[raw[low:low + limit]])
            cut = low + int(gaps[-1]) + 1 if len(gaps) else low + limit
            while not len(gaps) and cut < end:  # a word longer than a chunk stays whole
                gaps = np.flatnonzero(space[raw[cut:cut + limit]])
                cut = min(end, cut + (int(gaps[0]) if len(gaps) else limit))
            words, counts = hash_words(raw[low:cut], np.array([0, cut - low]), lower, space)
            yield at, words, counts
            low = cut
            if end - low <= limit and low < end:
                words, counts = hash_words(raw[low:end], np.array([0, end - low]), lower, space)
                yield at, words, counts
        at = to
