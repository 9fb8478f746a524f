"""Suffix array and permuted common prefixes of one shard, by induced sorting with numpy.

The text of a shard is a row of segments, each closed by the separator 1, and a
last sentinel 0; bytes are stored as byte + 2. Induction runs bucket by bucket: all entries
of a bucket that are known induce their predecessors in one array operation, again for
runs of one character, so a pass is linear in the text with a few calls per character of the alphabet.
"""

from __future__ import annotations

import numpy as np

#: The reduced text is sorted by induction again while its alphabet is at most this; a
#: larger one (names nearly all different) is ranked by doubling.
RECURSE_NAMES = 2048


def _s_type(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than its successor; the sentinel counts as such."""
    n = len(t)
    out = np.ones(n, bool)
    if n > 1:
        step = np.sign(t[1:].astype(np.int64) - t[:-1])
        at = np.where(step != 0, np.arange(n - 1), n)
        at = np.minimum.accumulate(at[::-1])[::-1]
        out[:-1] = step[np.minimum(at, n - 2)] > 0
    return out


def _place(t, sa, fill, pos, direction):
    """Append the suffixes ``pos``, in order, to their buckets; fill moves by direction."""
    key = t[pos]
    order = np.argsort(key, kind="stable")
    key, pos = key[order], pos[order]
    count = np.bincount(key, minlength=len(fill))
    within = np.arange(len(key)) - (np.cumsum(count) - count)[key]
    sa[fill[key] + direction * within] = pos
    fill += direction * count


def _induce(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """The order of all suffixes that follows from the leftmost-smaller suffixes in the given order."""
    n = len(t)
    count = np.bincount(t, minlength=sigma)
    ends = np.cumsum(count)
    starts = ends - count
    sa = np.full(n, -1, np.int64)
    first = t[lms]
    order = np.argsort(first, kind="stable")
    lms = lms[order]
    lms_at = np.searchsorted(first[order], np.arange(sigma + 1))
    fill = starts.copy()
    for c in range(sigma):
        done = starts[c]
        while done < fill[c]:
            got = sa[done:fill[c]]
            done = fill[c]
            got = got[got > 0] - 1
            got = got[~s_type[got]]
            if len(got):
                _place(t, sa, fill, got, 1)
        got = lms[lms_at[c]:lms_at[c + 1]]
        got = got[got > 0] - 1
        if len(got):
            _place(t, sa, fill, got, 1)
    l_ends = fill
    fill = ends - 1
    sa[fill[0]] = n - 1
    fill[0] -= 1
    for c in range(sigma - 1, -1, -1):
        done = ends[c] - 1
        while done > fill[c]:
            got = sa[fill[c] + 1:done + 1][::-1]
            done = fill[c]
            got = got[got > 0] - 1
            got = got[s_type[got]]
            if len(got):
                _place(t, sa, fill, got, -1)
        got = sa[starts[c]:l_ends[c]][::-1]
        got = got[got > 0] - 1
        got = got[s_type[got]]
        if len(got):
            _place(t, sa, fill, got, -1)
    return sa


def _rank_doubling(t: np.ndarray) -> np.ndarray:
    """Suffix array of a text whose names are nearly all different."""
    n, rank, h = len(t), t.astype(np.int64), 1
    while True:
        second = np.zeros(n, np.int64)
        second[:-h or None] = rank[h:] + 1
        key = rank * (n + 1) + second
        sa = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[sa][1:] != key[sa][:-1])])
        rank = np.empty(n, np.int64)
        rank[sa] = new
        if new[-1] == n - 1:
            return sa
        h *= 2
        if h >= n:
            return sa


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array of ``t`` (values below sigma; the last is the only 0)."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    s_type = _s_type(t)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    sa = _induce(t, s_type, lms, sigma)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]
    # name the sorted leftmost-smaller substrings: equal ones are neighbours
    size = np.empty(n, np.int64)
    size[lms] = np.append(np.diff(lms), 0) + 1
    a, b = order[:-1], order[1:]
    same = size[a] == size[b]
    left = np.flatnonzero(same)
    k = 0
    while len(left):
        eq = t[a[left] + k] == t[b[left] + k]
        same[left[~eq]] = False
        k += 1
        left = left[eq & (size[a[left]] > k)]
    name = np.concatenate([[0], np.cumsum(~same)])
    if name[-1] < len(order) - 1:
        by_pos = np.empty(n, np.int64)
        by_pos[order] = name
        reduced = by_pos[lms]
        names = int(name[-1]) + 1
        order = lms[suffix_array(reduced, names) if names <= RECURSE_NAMES else _rank_doubling(reduced)]
    return _induce(t, s_type, order, sigma)


def common_prefixes(t: np.ndarray, sa: np.ndarray, rem: np.ndarray) -> np.ndarray:
    """For every position the common prefix of its suffix with the one before it in ``sa``, within their segments.

    ``rem`` is the distance of every position to its segment's end. A position whose predecessor character equals that of its
    neighbour has the common prefix of the position before, less one; only the others are compared, 8 bytes at a time.
    """
    n = len(t)
    phi = np.empty(n, np.int64)
    phi[sa[0]] = -1
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    begin = np.ones(n, bool)
    begin[1:] = (phi[1:] <= 0) | (t[:-1] <= 1)
    inner = np.flatnonzero(~begin)
    begin[inner] = t[inner - 1] != t[phi[inner] - 1]
    raw = np.zeros(n + 8, np.uint64)
    raw[:n] = np.where(t > 1, t.astype(np.int64) - 2, 0)
    word = raw[:n].copy()
    for k in range(1, 8):
        word |= raw[k:n + k] << np.uint64(8 * k)
    i = np.flatnonzero(begin & (phi >= 0))
    j = phi[i]
    cap = np.minimum(rem[i], rem[j])
    out = np.zeros(n, np.int64)
    out[i] = cap
    live = np.flatnonzero(cap > 0)
    k = 0
    while len(live):
        x = word[i[live] + k] ^ word[j[live] + k]
        stop = x != 0
        low = x[stop] & (~x[stop] + np.uint64(1))
        equal = np.log2(low.astype(np.float64)).astype(np.int64) // 8
        out[i[live[stop]]] = np.minimum(cap[live[stop]], k + equal)
        k += 8
        live = live[~stop]
        live = live[cap[live] > k]
    last = np.maximum.accumulate(np.where(begin, at, 0))
    return np.maximum(out[last] - (at - last), 0)


def repeated_starts(segments: list[bytes], rank: np.ndarray, length: int) -> list[np.ndarray]:
    """For every segment the offsets at which a ``length``-byte string starts that also starts earlier.

    ``rank`` orders the segments; within one, smaller offsets are earlier.
    """
    lens = np.array([len(s) for s in segments], np.int64)
    ends = np.cumsum(lens + 1)
    n = int(ends[-1]) + 1
    joined = np.frombuffer(b"\0".join(segments) + b"\0\0", np.uint8)
    t = joined.astype(np.int16) + 2
    t[ends - 1] = 1
    t[n - 1] = 0
    seg = np.repeat(np.arange(len(segments)), lens + 1)
    rem = np.zeros(n, np.int64)
    rem[:-1] = (ends - 1)[seg] - np.arange(n - 1)
    sa = suffix_array(t, 258)
    lcp = common_prefixes(t, sa, rem)[sa]
    full = rem[sa] >= length
    group = np.cumsum(lcp < length)[full]
    pos = sa[full]
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(segments)
    if not len(pos):
        return out
    offset = pos - (ends - 1 - lens)[seg[pos]]
    key = rank[seg[pos]].astype(np.int64) * (int(lens.max()) + 1) + offset
    new = np.ones(len(pos), bool)
    new[1:] = group[1:] != group[:-1]
    least = np.minimum.reduceat(key, np.flatnonzero(new))
    late = np.sort(pos[key != least[np.cumsum(new) - 1]])
    cut = np.searchsorted(late, np.concatenate([[0], ends]))
    for i in np.flatnonzero(np.diff(cut)):
        out[i] = late[cut[i]:cut[i + 1]] - (ends[i] - 1 - lens[i])
    return out
