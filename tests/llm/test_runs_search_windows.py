"""Periodic runs, ranked search and repeated word windows against brute force, with small chunks, blocks and pieces."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from actlake.llm import periodic_runs as PR, queries as Q, ranked_search as RS, recompression as RC
from actlake.llm.hashing import IS_SPACE, hash_words, mix, word_chunks

SCHEMA = "doc_id long, text string, uid long, key long, digest long, p int, n int, item string, query int, rank int, runs string, kept string"
VOCABULARY = [a + b for a in "alpha Beta gamma delta épsilon".split() for b in ("", "n", "7")]


def make_rows():
    rnd = random.Random(11)
    base = [" ".join(rnd.choices(VOCABULARY, k=rnd.randint(3, 90))) for _ in range(14)]
    passage = " ".join(rnd.choices(VOCABULARY, k=30))
    texts = base + [base[0], base[1] + "\n", base[2].replace(" ", "\t"), base[3].upper()]
    texts += [f"{base[i]} {passage}\n{base[i + 1]}" for i in range(4, 10)]
    texts += [None, "", " \n\t\r\x0b\x0c", "one", "a " * 300, "a b " * 100, "x a b c a b c a b c a b c a y " * 3, "é" * 300,
              "no-break space, p.u.n.c.t_u@a`t{i}on\x00nul", " ".join(rnd.choices(VOCABULARY, k=3000))]
    rows = list(enumerate(texts)) + [(3, base[3]), (3, base[3]), (4, "other " + base[5]), (None, base[5]), (None, base[6]), (None, None)]
    rnd.shuffle(rows)
    return rows


ROWS = make_rows()


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs"))
    rows = [(d, t, 1, 2, 3, 4, 5, "i", 6, 7, "r", "k") for d, t in ROWS]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ------------------------------------------------------------------ chunks of words

@given(st.lists(st.text(alphabet="ab \n", max_size=40), max_size=6), st.integers(1, 12))
@settings(max_examples=60, deadline=None)
def test_word_chunks_give_the_words_of_whole_texts(texts, limit):
    data = [t.encode() for t in texts]
    raw, off = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0] + [len(d) for d in data])
    got = [[] for _ in texts]
    for at, words, counts in word_chunks(raw, off, limit, IS_SPACE, lower=False):
        for k, part in enumerate(np.split(words, np.cumsum(counts)[:-1])):
            got[at + k] += part.tolist()
    words, counts = hash_words(raw, off, lower=False)
    assert got == [x.tolist() for x in np.split(words, np.cumsum(counts)[:-1])] if texts else got == []


# ------------------------------------------------------------------ periodic runs

def brute_runs(words, min_length, min_exponent):
    found = {}
    for q in range(1, len(words) // min_exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, min_exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i) + 1
    return sorted((s, n, q) for (s, n), q in found.items())


@given(st.lists(st.lists(st.integers(1, 3), max_size=60), max_size=4), st.sampled_from([(6, 4), (2, 2), (3, 3)]))
@settings(max_examples=150, deadline=None)
def test_find_runs(texts, least):
    words = np.array([x for t in texts for x in t], np.uint64)
    of, start, length, period = PR.find_runs(words, np.array([len(t) for t in texts], np.int64), *least)
    got = [[] for _ in texts]
    for k, *run in zip(of.tolist(), start.tolist(), length.tolist(), period.tolist()):
        got[k].append(tuple(run))
    assert [sorted(g) for g in got] == [brute_runs(t, *least) for t in texts]
    assert all(g == sorted(g, key=lambda r: (r[0], r[2])) for g in got)


def expected_runs(text, min_length=6, min_exponent=4):
    w = words_of(text)
    runs = sorted(brute_runs(w, min_length, min_exponent), key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return len(w), [tuple(r) for r in runs], " ".join(x for i, x in enumerate(w) if i not in gone).encode()


@pytest.mark.parametrize("chunk", [1 << 20, 64])
def test_periodic_runs(docs, empty, monkeypatch, chunk):
    monkeypatch.setattr(PR, "CHUNK_BYTES", chunk)
    got = Counter((r["doc_id"], r["n_words"], tuple(tuple(x) for x in r["runs"]), bytes(r["kept"]))
                  for r in PR.periodic_runs(docs).collect())
    want = Counter()
    for d, t in ROWS:
        n, runs, kept = expected_runs(t)
        want[(d, n, tuple(runs), kept)] += 1
    assert got == want and any(r for _, _, r, _ in want)
    assert PR.periodic_runs(empty).collect() == []
    with pytest.raises(ValueError):
        PR.periodic_runs(docs, min_exponent=1)


def test_planted_periods(spark, tmp_path):
    """The query's text rule and digests: every tenth document repeats its tail."""
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choices(VOCABULARY, k=rnd.choice([0, 1, 5, 40, 200]))) or None) for i in range(120)] + [(None, "a " * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in Q.op11_periodic_runs(spark, str(tmp_path)).collect()}
    planted = 0
    import hashlib
    for d, t in rows:
        w = words_of(t)
        h = zlib.crc32(str(d).encode()) if d is not None else 1
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        _, runs, kept = expected_runs(" ".join(w))
        r = got[d]
        assert r["n_runs"] == len(runs)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(kept).hexdigest()
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        assert (r["start"], r["length"], r["period"]) == best
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
    assert planted > 5


# ------------------------------------------------------------------ ranked search

def terms_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute_search(items, rows, k):
    texts = [(d, terms_of(t)) for d, t in rows]
    n_docs, total = sum(bool(t) for _, t in texts), sum(len(t) for _, t in texts)
    counts = [(d, len(t), Counter(t)) for d, t in texts]
    df = Counter(w for _, _, c in counts for w in c)
    out = Counter()
    for item, text in items:
        scores = []
        for d, n, c in counts:
            if not n:
                continue
            m = 50 + 50 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m))
                    for w in set(terms_of(text)) if c[w])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        for rank, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1):
            out[(item, rank, d, -s)] += 1
    return out


ITEMS = [(1, "alpha gamma7"), (2, "BETA beta épsilonn delta alphan gamman gamma"), (3, None), (4, "no such term zz"), (5, "nul space a b"),
         (2, "alpha"), (None, "other delta7 alpha"), (6, " ".join(VOCABULARY)), (7, " ".join(VOCABULARY) + " one a")]


@pytest.mark.parametrize("k,short,small", [(3, 1 / 32, True), (3, 0.4, True), (50, 1.0, False), (5, 0.0, True)])
def test_rank_documents(spark, docs, monkeypatch, k, short, small):
    if small:  # several chunks of a text, blocks and pieces
        monkeypatch.setattr(RS, "CHUNK_BYTES", 100)
        monkeypatch.setattr(RS, "BLOCK_DOCS", 7)
        monkeypatch.setattr(RS, "PIECE", 2)
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, rank int")
    got = Counter(tuple(r) for r in RS.rank_documents(docs, items, k, short_share=short).collect())
    assert got == brute_search(ITEMS, ROWS, k)


def test_rank_documents_in_passes(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(RS, "QUERY_TERMS", 4)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert Counter(tuple(r) for r in RS.rank_documents(docs, items, 4).collect()) == brute_search(ITEMS, ROWS, 4)
    out = RS.rank_documents(empty, items, 4)
    assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.collect() == []
    assert RS.rank_documents(docs, items.limit(0), 4).collect() == []


def test_pieces_are_skipped():
    """A piece whose bounds stay below the k-th best score is not walked."""
    import pyarrow as pa
    n = 4 * RS.PIECE
    tf = np.ones(n, np.int32)
    tf[:60] = 40  # the best documents come first
    block = RS.Block(pa.array(np.arange(n)), np.full(n, 50), np.array([0]), np.array([n]), np.arange(n, dtype=np.int32), tf, n, 50 * n)
    best = RS.Best(50)
    walked = []
    add = best.add
    best.add = lambda score, null, doc: (walked.append(int(doc[0])), add(score, null, doc))
    RS.search_block(block, [], [(0, 7)], best)
    assert walked == [0] and best.doc.tolist() == list(range(50))


# ------------------------------------------------------------------ repeated windows

def brute_windows(rows, length):
    first = {}
    low = -(2**63)
    for d, t in rows:
        w = words_of(t)
        for i in range(len(w) - length + 1):
            win = tuple(w[i:i + length])
            first[win] = min(first.get(win, 2**63), low if d is None else d)
    out = Counter()
    for d, t in rows:
        w = words_of(t)
        gone = set()
        for i in range(len(w) - length + 1):
            if first[tuple(w[i:i + length])] < (low if d is None else d):
                gone |= set(range(i, i + length))
        spans = []
        for i in sorted(gone):
            if spans and spans[-1][1] == i:
                spans[-1][1] = i + 1
            else:
                spans.append([i, i + 1])
        out[(d, len(w), tuple(map(tuple, spans)), " ".join(x for i, x in enumerate(w) if i not in gone).encode())] += 1
    return out


@pytest.mark.parametrize("length,chunk", [(6, 1 << 20), (20, 1 << 20), (20, 150), (50, 150)])
def test_remove_repeated_windows(docs, empty, monkeypatch, length, chunk):
    monkeypatch.setattr(RC, "CHUNK_BYTES", chunk)
    got = Counter((r["doc_id"], r["n_words"], tuple(tuple(s) for s in r["spans"]), bytes(r["kept"]))
                  for r in RC.remove_repeated_windows(docs, length).collect())
    want = brute_windows(ROWS, length)
    assert got == want and any(s for _, _, s, _ in want)
    assert RC.remove_repeated_windows(empty, length).collect() == []


@given(st.lists(st.lists(st.integers(1, 4), max_size=50), min_size=1, max_size=4), st.sampled_from([4, 9, 20]), st.integers(0, 8))
@settings(max_examples=150, deadline=None)
def test_equal_windows_have_one_name(texts, length, rounds):
    texts = texts + [texts[0] + texts[-1], [3] * 40]
    words = mix(np.array([x for t in texts for x in t], np.uint64))
    names, seen = {}, set()
    for text, p, n, key, _, again in zip(*(x.tolist() for x in RC.segments(words, np.array([len(t) for t in texts]), length, rounds))):
        for i in range(p, p + n + again - 1):
            window = tuple(texts[text][i:i + length])
            assert len(window) == length and (text, i) not in seen
            seen.add((text, i))
            assert names.setdefault(window, key) == key
    assert len(seen) == sum(max(0, len(t) - length + 1) for t in texts)


def test_symbols_are_consistent():
    """Inside equal stretches of two texts the symbols whose reach lies within are the same in every round, runs included."""
    rnd = random.Random(2)
    inner = [rnd.randint(1, 9) for _ in range(60)] + [5] * 7 + [rnd.randint(1, 9) for _ in range(60)]
    texts = [[rnd.randint(1, 9) for _ in range(40)] + inner, inner + [rnd.randint(1, 9) for _ in range(30)]]
    words = mix(np.array([x for t in texts for x in t], np.uint64))
    at = (40, len(texts[0]))
    for s in RC.parse(words, np.array([len(t) for t in texts])):
        inside = [{(int(a - o), int(x)) for a, x, lo, hi in zip(s.at, s.name, s.low, s.high) if o <= lo and hi <= o + len(inner)} for o in at]
        assert inside[0] == inside[1] and inside[0]
    assert len(s.name) < 0.35 * len(words)
    runs = RC.name_runs(RC.parse(words, np.array([len(t) for t in texts]), 0)[0], np.array([0, at[1]]), np.array([at[1], len(words)]))
    assert len(runs.name) < len(words)


def test_two_hot_passages(spark):
    """A passage that all documents share with other words around it, and copies of one document."""
    rnd = random.Random(4)
    passage = [f"p{i}" for i in range(70)]
    rows = [(i, " ".join([f"{i}a{j}" for j in range(rnd.randint(1, 30))] + passage + [f"{i}b{j}" for j in range(rnd.randint(1, 30))])) for i in range(80)]
    rows += [(100 + i, rows[7][1]) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_words"], tuple(tuple(s) for s in r["spans"]), bytes(r["kept"]))
                  for r in RC.remove_repeated_windows(frame, 50).collect())
    assert got == brute_windows(rows, 50)
    whole = frame.filter(F.col("doc_id") >= 100).count()
    assert sum(n for (d, _, _, kept), n in got.items() if d >= 100 and kept == b"") == whole
