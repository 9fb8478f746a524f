"""Benchmark decontamination: BM25 inverted index of test items, searched by every training passage.

The index is block-max: the items are cut into blocks, and every posting list keeps the largest
weight of its term in each block. A passage's terms first add up to an upper bound for
the whole index and for each block (the pivot test of WAND, done for all passages of a piece of
text at once with numpy); only blocks whose bound reaches the threshold have their postings
scored. Retrieved items are verified by word shingles of question and answer, or of the two as one sequence.

A weight is divided by the score that the item has against itself, so a score is the share of the
item's own BM25 mass that a passage holds, and one threshold fits items of every length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .hashing import batch_bytes, hash_words, shingles

K1, B = 1.2, 0.75
#: Items in a block, and UTF-8 bytes of items that one index (one broadcast) holds at most.
BLOCK_ITEMS = 32
INDEX_BYTES = 16 << 20
#: Bytes of text that one numpy pass takes at a time; its arrays take some 80 times that.
CHUNK_BYTES = 128 << 10
#: Up to so many cells a distinct or a sum is taken in a dense array, beyond by sorting.
DENSE = 1 << 24
#: Share of an item's BM25 mass that retrieves it; share of five-word shingles that verifies it.
THRESHOLD = 0.5
OVERLAP = 0.8
SHINGLE = 5
#: ASCII characters other than letters and digits part words; all other bytes belong to words.
PARTS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words of each text), in lower case and without ASCII punctuation."""
    raw, off = batch_bytes(pc.utf8_lower(texts.cast(pa.large_string())))
    return hash_words(raw, off, lower=False, space=PARTS)


@dataclass
class Index:
    """Postings by term, block and item; ``bound`` is each term's largest weight in a block."""

    vocab: np.ndarray        # term hashes, ascending
    term_at: np.ndarray      # term -> first of its (term, block) entries
    block: np.ndarray        # entry -> block
    bound: np.ndarray        # entry -> largest weight
    entry_at: np.ndarray     # entry -> first of its postings
    item: np.ndarray         # posting -> item
    weight: np.ndarray       # posting -> weight
    top: np.ndarray          # term -> largest weight anywhere
    ids: list
    questions: list          # item -> shingle hashes
    answers: list
    wholes: list             # item -> shingle hashes of question and answer in one sequence, by place
    sides: list              # item -> words of the question, of the answer
    span: int                # words of the longest item


def build_index(items: list[tuple]) -> Index:
    """Index (item_id, question, answer) rows. Items without a word are left out."""
    ids, q, a = (list(x) for x in zip(*items, strict=True)) if items else ([], [], [])
    qw, qn = words_of(pa.array(q, pa.string()))
    aw, an = words_of(pa.array(a, pa.string()))
    qe, ae = np.cumsum(qn), np.cumsum(an)
    keep = [i for i in range(len(ids)) if qn[i] + an[i]]
    words = [np.concatenate([qw[qe[i] - qn[i]:qe[i]], aw[ae[i] - an[i]:ae[i]]]) for i in keep]
    lens = np.array([len(w) for w in words], float)
    terms, docs, tfs = [], [], []
    for i, w in enumerate(words):
        t, c = np.unique(w, return_counts=True)
        terms.append(t), docs.append(np.full(len(t), i)), tfs.append(c)
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    term, doc, tf = cat(terms, np.uint64), cat(docs, np.int64), cat(tfs, np.int64)
    vocab, tid, df = np.unique(term, return_inverse=True, return_counts=True)
    idf = np.log(1 + (len(words) - df + 0.5) / (df + 0.5))
    norm = K1 * (1 - B + B * lens / max(1.0, lens.mean() if len(lens) else 1.0))
    w = idf[tid] * tf * (K1 + 1) / (tf + norm[doc]) if len(doc) else np.zeros(0)
    w = w / np.bincount(doc, w, minlength=len(words))[doc] if len(doc) else w
    block = doc // BLOCK_ITEMS
    order = np.lexsort((doc, block, tid))
    tid, block, doc, w = tid[order], block[order], doc[order], w[order]
    new = np.ones(len(tid), bool)
    new[1:] = (tid[1:] != tid[:-1]) | (block[1:] != block[:-1])
    first = np.flatnonzero(new)
    bound = np.maximum.reduceat(w, first) if len(first) else w
    term_at = np.searchsorted(tid[first], np.arange(len(vocab) + 1))
    top = np.maximum.reduceat(bound, term_at[:-1]) if len(vocab) else bound

    def grams(hashes, n, ends, i):
        return np.unique(shingles(hashes[ends[i] - n[i]:ends[i]], np.array([n[i]]), min(SHINGLE, max(1, int(n[i]))))[0])
    return Index(vocab, term_at, block[first], bound, np.append(first, len(tid)), doc, w, top, [ids[i] for i in keep],
                 [(int(min(SHINGLE, qn[i])), grams(qw, qn, qe, i)) for i in keep],
                 [(int(min(SHINGLE, an[i])), grams(aw, an, ae, i)) for i in keep],
                 [(min(SHINGLE, len(w)), shingles(w, np.array([len(w)]), min(SHINGLE, len(w)))[0]) for w in words],
                 [(w[:qn[i]], w[qn[i]:]) for i, w in zip(keep, words, strict=True)],
                 int(lens.max()) if len(lens) else 1)


def _spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(source, index): for every source i the indexes starts[i] .. starts[i] + counts[i] - 1."""
    src = np.repeat(np.arange(len(starts)), counts)
    return src, np.arange(len(src)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[src]


def _distinct(key: np.ndarray, size: int) -> np.ndarray:
    """The distinct values of ``key``, all below ``size``, ascending."""
    if size > DENSE:
        return np.unique(key)
    seen = np.zeros(size, bool)
    seen[key] = True
    return np.flatnonzero(seen)


def _sums(key: np.ndarray, weight: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, sum of each, the place of every element's key among them)."""
    if size > DENSE:
        keys, at = np.unique(key, return_inverse=True)
        return keys, np.bincount(at, weight, minlength=len(keys)), at
    return np.arange(size), np.bincount(key, weight, minlength=size), key


def retrieve(index: Index, words: np.ndarray, counts: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, passage, item, score) of every passage and item with score >= threshold.

    Passages are windows of twice the longest item's words, each starting one longest
    item after the one before, so every item-long run lies whole in a passage.
    """
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
    if not len(words) or not len(index.vocab):
        return none
    step = index.span
    n_pass = np.maximum(1, -(-(counts - 2 * step) // step) + 1)
    base = np.cumsum(n_pass) - n_pass
    at = np.minimum(np.searchsorted(index.vocab, words), len(index.vocab) - 1)
    hit = np.flatnonzero(index.vocab[at] == words)
    text = np.repeat(np.arange(len(counts)), counts)[hit]
    within = hit - np.repeat(np.cumsum(counts) - counts, counts)[hit]
    term, late = at[hit], within // step
    own = np.concatenate([base[text] + np.minimum(late, n_pass[text] - 1), base[text] + late - 1])
    ok = np.concatenate([np.ones(len(hit), bool), (late >= 1) & (late - 1 < n_pass[text] - 1)])
    v = len(index.vocab)
    passages = int(n_pass.sum())
    key = _distinct(own[ok] * v + np.concatenate([term, term])[ok], passages * v)
    passage, term = key // v, key % v
    eps = 1e-9
    # pivot test over the whole index
    alive = np.bincount(passage, index.top[term], minlength=passages) >= threshold - eps
    m = alive[passage]
    passage, term = passage[m], term[m]
    # pivot test in every block
    src, entry = _spread(index.term_at[term], index.term_at[term + 1] - index.term_at[term])
    n_blocks = int(index.block.max()) + 1
    _, bound, at = _sums(passage[src] * n_blocks + index.block[entry], index.bound[entry], passages * n_blocks)
    m = (bound >= threshold - eps)[at]
    passage, entry = passage[src[m]], entry[m]
    # score the postings of the blocks that are left
    src, post = _spread(index.entry_at[entry], index.entry_at[entry + 1] - index.entry_at[entry])
    n_items = len(index.ids)
    cell, score, _ = _sums(passage[src] * n_items + index.item[post], index.weight[post], passages * n_items)
    m = score >= threshold - eps
    passage, item, score = cell[m] // n_items, cell[m] % n_items, score[m]
    text = np.searchsorted(base, passage, "right") - 1
    return text, passage - base[text], item, score


def _search(index_var, threshold: float, overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = index_var.value
        for b in batches:
            col = b.column(1)
            size = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)) if b.num_rows else []
            at = 0
            while at < b.num_rows:
                before = int(size[at - 1]) if at else 0
                end = max(at + 1, int(np.searchsorted(size, before + CHUNK_BYTES, "right")))
                words, counts = words_of(col.slice(at, end - at))
                rows = _verified(index, words, counts, threshold, overlap)
                if rows:
                    text, item, passage, score, q, a = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(at, end - at).take(pa.array(text)), pa.array([index.ids[i] for i in item], pa.int64()),
                         pa.array(passage, pa.int32()), pa.array(score, pa.float64()), pa.array(q, pa.float64()),
                         pa.array(a, pa.float64())],
                        ["doc_id", "item_id", "passage", "score", "question_overlap", "answer_overlap"])
                at = end
    return run


def _edited(index: Index, item: int, held, overlap: float) -> bool:
    """Whether question and answer as one sequence hold, and neither side is missing as a whole.

    A side is there if a shingle of the sequence that touches it is held, or half of its words are.
    """
    k, want = index.wholes[item]
    got = held(k, want)
    if len(np.unique(want[got])) < (overlap - 1e-9) * len(np.unique(want)):
        return False
    q, a = index.sides[item]
    at = np.arange(len(want))
    return all(not len(side) or got[touch].any() or 2 * held(1, shingles(side, np.array([len(side)]), 1)[0]).sum() >= len(side)
               for side, touch in ((q, at < len(q)), (a, at + k > len(q))))


def _verified(index: Index, words, counts, threshold: float, overlap: float) -> list[tuple]:
    """The best passage of every text and item that verifies."""
    best: dict[tuple[int, int], tuple] = {}
    ends = np.cumsum(counts)
    grams: dict[tuple[int, int, int], np.ndarray] = {}
    for text, passage, item, score in zip(*retrieve(index, words, counts, threshold), strict=True):
        a = ends[text] - counts[text] + passage * index.span
        z = min(int(ends[text]), int(a) + 2 * index.span)
        def held(k, want, a=a, z=z):
            have = grams.get((a, z, k))
            if have is None:
                have = grams[(a, z, k)] = shingles(words[a:z], np.array([z - a]), k)[0]
            return np.isin(want, have)
        shares = [float(held(k, want).mean()) if len(want) else 1.0 for k, want in (index.questions[item], index.answers[item])]
        if min(shares) >= overlap - 1e-9 or _edited(index, item, held, overlap):
            row = (int(text), int(item), int(passage), float(score), *shares)
            old = best.get(row[:2])
            if old is None or (sum(shares), -passage) > (old[4] + old[5], -old[2]):
                best[row[:2]] = row
    return list(best.values())


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, passage, score, question_overlap, answer_overlap) of every leak, best passage of each.

    ``items``: item_id, question, answer. A leak is a passage whose BM25 score reaches
    ``threshold`` of the item's own and which holds at least ``overlap`` of the five-word shingles of
    the question and of the answer (a side with fewer words: its whole sequence; a side
    without words holds), or of the question with the answer after it as one sequence, of which neither
    side may be missing as a whole: there a changed or missing word weighs the same wherever it stands. All items above the threshold are verified, none is cut off.

    Null or empty texts hold nothing; items with neither question nor answer words, like null ones, are left
    out; repeated rows and ids are each answered; empty tables give an empty result. Other columns are not read.

    Documents are read once per index and never shuffled. An index, which is broadcast, holds at most
    about INDEX_BYTES of items; a larger benchmark is searched in several, each with the document frequencies of its own items.
    """
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("question").cast("string"), F.lit("")).alias("question"),
                         F.coalesce(F.col("answer").cast("string"), F.lit("")).alias("answer"))
    total = items.agg(F.sum(F.octet_length("question") + F.octet_length("answer"))).first()[0] or 0
    n = max(1, -(-total // INDEX_BYTES))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for i in range(n):
        part = items.filter(F.pmod(F.xxhash64("item_id", "question", "answer"), F.lit(n)) == i)
        rows = sorted(part.distinct().coalesce(1).toLocalIterator(), key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["question"], r["answer"]))
        index = docs.sparkSession.sparkContext.broadcast(build_index([tuple(r) for r in rows]))
        got = src.mapInArrow(_search(index, threshold, overlap), "doc_id long, item_id long, passage int, score double, "
                             "question_overlap double, answer_overlap double")
        out = got if out is None else out.unionByName(got)
    return out


def question_and_answer(benchmark: DataFrame) -> DataFrame:
    """The given benchmark's rows in the schema of an item: the first three quarters of the words ask, the rest answers."""
    words = F.split(F.trim(F.coalesce(F.col("text"), F.lit(""))), r"\s+")
    cut = F.ceil(F.size(words) * 0.75).cast("int")
    return benchmark.select("item_id", F.array_join(F.slice(words, 1, cut), " ").alias("question"),
                            F.array_join(F.slice(words, cut + 1, F.size(words)), " ").alias("answer"))
