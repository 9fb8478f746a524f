"""Ranked lexical search: term-at-a-time over short lists, document-at-a-time over long ones.

Spark turns the documents into blocks of an inverted index over the query terms, counts them, and every task then answers all
queries on its blocks. A query's short lists are summed term by term into accumulators. These accumulators, in document
order and with their largest sums known, are from then on one more list beside the long ones. All of them are walked
together document by document, in pieces of PIECE documents: a piece whose bounds cannot
reach the score of the k-th best document so far is skipped whole, and within a piece the lists that cannot bring a document among the best
by themselves are only looked up for documents that the other lists have found. Each task keeps k documents a query; Spark merges them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from actlake.session import stored

from .hashing import batch_bytes, word_chunks

#: Bytes that part terms: the ASCII characters that are neither digits nor letters.
NO_TERM = np.zeros(256, bool)
NO_TERM[:128] = True
NO_TERM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
#: Bytes of text that one numpy pass takes; a longer text is taken in pieces.
CHUNK_BYTES = 1 << 20
#: Documents and postings of a block of the index, documents of a piece that is skipped or walked.
BLOCK_DOCS, BLOCK_POSTINGS, PIECE = 8192, 1 << 20, 512
#: A list is short if it holds at most this share of the documents.
SHORT_SHARE = 1 / 32
#: Query terms (with repeats over queries) that go to the tasks at a time; more queries are answered in several passes.
QUERY_TERMS = 1 << 20
#: Parts of a query's candidates that are ranked by themselves before the last ranking.
MERGE_PARTS = 64
INDEX_SCHEMA = ("ids array<long>, lens array<long>, terms array<int>, sizes array<int>, docs array<int>, tfs array<int>, "
                "n_docs long, n_terms long")


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item id, text) -> (item id, distinct term hashes)."""
    for b in batches:
        raw, off = batch_bytes(b.column(1))
        out: list[list[np.ndarray]] = [[] for _ in range(b.num_rows)]
        for at, words, counts in word_chunks(raw, off, CHUNK_BYTES, NO_TERM):
            for k, part in enumerate(np.split(words, np.cumsum(counts)[:-1])):
                out[at + k].append(part)
        terms = [np.unique(np.concatenate(x)).view(np.int64) if x else np.zeros(0, np.int64) for x in out]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(terms, pa.list_(pa.int64()))], ["item", "terms"])


class Vocabulary:
    """The distinct query terms, with a table that turns most other words away."""

    def __init__(self, terms: np.ndarray):
        self.terms = np.sort(terms)
        self.maybe = np.zeros(1 << max(16, int(len(terms)).bit_length() + 4), bool)
        self.maybe[self._cell(self.terms)] = True

    def _cell(self, h: np.ndarray) -> np.ndarray:
        return h & np.uint64(len(self.maybe) - 1)

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``words`` that hold a query term, their term numbers)."""
        at = np.flatnonzero(self.maybe[self._cell(words)])
        if not len(at):
            return at, at
        term = np.minimum(np.searchsorted(self.terms, words[at]), len(self.terms) - 1)
        hit = self.terms[term] == words[at]
        return at[hit], term[hit]


def _blocks(vocabulary):
    """(doc id, text) -> one row for each block of the index; postings are ordered by term, then document."""
    def run(batches):
        voc = vocabulary.value
        ids, lens, post, tfs, n_post = [], [], [], [], 0
        last, last_doc = None, -1

        def block():
            doc_ids, n = pa.concat_arrays(ids), np.concatenate(lens)
            key, tf = np.concatenate(post), np.concatenate(tfs)
            order = np.argsort(key, kind="stable")  # a text that came in pieces has several counts of a term
            key, tf = key[order], tf[order]
            new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            key, tf = key[new], np.add.reduceat(tf, new) if len(new) else tf
            terms, sizes = np.unique(key >> 32, return_counts=True)
            row = {"ids": doc_ids, "lens": n, "terms": terms, "sizes": sizes, "docs": key & 0xFFFFFFFF, "tfs": tf}
            kinds = {"ids": pa.int64(), "lens": pa.int64()}
            cols = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, kinds.get(k, pa.int32()))
                                             if not isinstance(v, pa.Array) else v) for k, v in row.items()]
            cols += [pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64())]
            return pa.RecordBatch.from_arrays(cols, [*row, "n_docs", "n_terms"])

        for b in batches:
            raw, off = batch_bytes(b.column(1))
            docs = b.column(0).cast(pa.int64())
            for at, words, counts in word_chunks(raw, off, CHUNK_BYTES, NO_TERM):
                same = last is b and at == last_doc  # the next chunk of one text
                if not same and (sum(len(x) for x in lens) + len(counts) > BLOCK_DOCS or n_post > BLOCK_POSTINGS) and ids:
                    yield block()
                    ids, lens, post, tfs, n_post = [], [], [], [], 0
                base = sum(len(x) for x in lens) - bool(same)
                if same:
                    lens[-1][-1] += len(words)
                else:
                    ids.append(docs.slice(at, len(counts)))
                    lens.append(counts.astype(np.int64))
                place, term = voc.find(words)
                doc = np.searchsorted(np.cumsum(counts), place, "right") + base
                key, tf = np.unique(term.astype(np.int64) << 32 | doc, return_counts=True)
                post.append(key)
                tfs.append(tf)
                n_post += len(key)
                last, last_doc = b, at + len(counts) - 1
        if ids:
            yield block()
    return run


class Best:
    """The k best (score, document) of one query; equal scores by document, documents without an id last."""

    def __init__(self, k: int):
        self.k, self.bar = k, 1
        self.score, self.null, self.doc = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, null: np.ndarray, doc: np.ndarray) -> None:
        self.score = np.concatenate([self.score, score])
        self.null = np.concatenate([self.null, null])
        self.doc = np.concatenate([self.doc, doc])
        if len(self.score) >= self.k:
            order = np.lexsort((self.doc, self.null, -self.score))[:self.k]
            self.score, self.null, self.doc = self.score[order], self.null[order], self.doc[order]
            self.bar = max(1, int(self.score[-1]))  # an equal score may still win by its document


class Block:
    """One block of the index with the impact of every posting and the bounds of its pieces."""

    def __init__(self, ids: pa.Array, lens: np.ndarray, terms: np.ndarray, sizes: np.ndarray, docs: np.ndarray, tfs: np.ndarray,
                 n_docs: int, n_terms: int):
        self.n = len(lens)
        self.null = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy()
        if 50 * n_docs * int(lens.max(initial=0)) < 1 << 63:
            m = 50 + (50 * n_docs * lens) // max(1, n_terms)
        else:
            m = np.array([50 + 50 * n_docs * int(x) // n_terms for x in lens], np.int64)
        self.docs, ends = docs, np.cumsum(sizes)
        tf = tfs.astype(np.int64)
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[docs])
        self.at = dict(zip(terms.tolist(), zip((ends - sizes).tolist(), ends.tolist(), strict=True), strict=True))
        self.edges = np.append(np.arange(0, self.n, PIECE), self.n)
        self.cut: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def pieces(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """(where each piece begins in the term's list, the largest impact of each piece)."""
        if term not in self.cut:
            a, z = self.at[term]
            cut = a + np.searchsorted(self.docs[a:z], self.edges)
            self.cut[term] = cut, _largest(self.impact, cut)
        return self.cut[term]


def _largest(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The largest value of each piece [cut[i], cut[i + 1]); 0 where it is empty."""
    out = np.zeros(len(cut) - 1, np.int64)
    some = np.flatnonzero(np.diff(cut))
    if len(some):
        # pieces without values lie between the others, so each slice ends where the next begins
        out[some] = np.maximum.reduceat(values[:cut[-1]], cut[some])
    return out


def search_block(block: Block, short: list[tuple[int, int]], long: list[tuple[int, int]], best: Best) -> None:
    """Add the documents of a block that are among a query's best. ``short`` and ``long`` hold (term, weight)."""
    # term at a time: the short lists become accumulators
    total = np.zeros(block.n, np.int64)
    for term, weight in short:
        if term in block.at:
            a, z = block.at[term]
            total[block.docs[a:z]] += weight * block.impact[a:z]
    found = np.flatnonzero(total)
    # every list: documents, values, weight, where pieces begin, bounds of pieces
    lists = []
    if len(found):
        cut = np.searchsorted(found, block.edges)
        lists.append((found, total[found], 1, cut, _largest(total[found], cut)))
    for term, weight in long:
        if term in block.at:
            cut, most = block.pieces(term)
            lists.append((block.docs, block.impact, weight, cut, weight * most))
    if not lists:
        return
    bounds = np.stack([x[4] for x in lists])
    reach = bounds.sum(axis=0)
    # document at a time
    for p in range(len(block.edges) - 1):
        if reach[p] < best.bar:
            continue
        low, high = block.edges[p], block.edges[p + 1]
        order = np.argsort(-bounds[:, p], kind="stable")
        left = int(reach[p])  # what the lists that are not read yet can add at most
        score = np.zeros(high - low, np.int64)
        cand = None
        for k in order:
            if not bounds[k, p]:
                break
            docs, values, weight, cut, _ = lists[k]
            a, z = cut[p], cut[p + 1]
            if cand is None and left < best.bar:  # from here on no new document can come in
                cand = np.flatnonzero(score + left >= best.bar)
            if cand is None:
                score[docs[a:z] - low] += weight * values[a:z]
            elif len(cand):
                place = np.minimum(a + np.searchsorted(docs[a:z], cand + low), z - 1)
                score[cand] += np.where(docs[place] == cand + low, weight * values[place], 0)
            left -= int(bounds[k, p])
            if cand is not None:
                cand = cand[score[cand] + left >= best.bar]
                if not len(cand):
                    break
        cand = np.flatnonzero(score >= best.bar) if cand is None else cand[score[cand] >= best.bar]
        if len(cand):
            best.add(score[cand], block.null[low + cand], block.ids[low + cand])


def _search(queries, k: int):
    """Blocks -> (query, doc_id, score): the k best documents of each query among the blocks of a task."""
    def run(batches):
        asked, n_docs, n_terms = queries.value
        best = [Best(k) for _ in asked]
        for b in batches:
            for r in range(b.num_rows):
                col = lambda c: b.column(c)[r].values  # noqa: B023, E731
                ints = {c: col(c).to_numpy() for c in ("lens", "terms", "sizes", "docs", "tfs")}
                block = Block(col("ids"), **ints, n_docs=n_docs, n_terms=n_terms)
                for (short, long), top in zip(asked, best, strict=True):
                    search_block(block, short, long, top)
        for q, top in enumerate(best):
            if len(top.score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(top.score), q), pa.int32()), pa.array(top.doc, pa.int64(), mask=top.null), pa.array(top.score)],
                    ["query", "doc_id", "score"])
    return run


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", query_col: str = "text", short_share: float = SHORT_SHARE) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` highest-scoring documents of every item, score above 0.

    Terms are runs of letters, digits and all characters beyond ASCII; only A-Z are lower-cased; equal by 64-bit hash. With N
    documents that have a term, L terms of all of them, n of one, df documents with a term, tf times in one: weight
    w = floor(1000 ln((2N + 2) / (2 df + 1))), m = 50 + 50 n N div L, score = sum of w ((10**9 tf) div (1000 tf + 20 m)) over the
    item's distinct terms. Equal scores are ranked by doc_id (null last).

    Null texts have no terms and are no documents. Every row of ``docs`` is a document and every row of ``items`` a query, also
    if it repeats another one; an item without terms, or an empty table, gives no rows. Other columns are not read. An index of
    the query terms is written when this is called, and counted; queries go to the tasks in passes of about QUERY_TERMS terms,
    each with an index of its own terms. ``short_share`` changes the work, not the result.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    asked = items.select(F.col(item_col).alias("item"), F.coalesce(F.col(query_col).cast("string"), F.lit("")).alias("text"))
    item_type = asked.schema["item"].dataType
    terms = stored(asked.mapInArrow(_terms_of, asked.select("item").schema.add("terms", T.ArrayType(T.LongType()))), "queries").filter(F.size("terms") > 0)
    n_terms = terms.agg(F.sum(F.size("terms"))).first()[0] or 0
    passes = -(-n_terms // QUERY_TERMS)
    result = None
    for p in range(passes):
        mine = terms.filter(F.pmod(F.xxhash64("item", "terms"), F.lit(passes)) == p).collect()
        if not mine:
            continue
        part = _rank(spark, src, [r["item"] for r in mine], [np.array(r["terms"], np.int64).view(np.uint64) for r in mine],
                     k, short_share, item_type)
        result = part if result is None else result.unionByName(part)
    if result is None:
        result = spark.createDataFrame([], asked.select("item").schema.add("rank", T.IntegerType())
                                       .add("doc_id", T.LongType()).add("score", T.LongType()))
    return result.withColumnRenamed("item", "item_id")


def _rank(spark, src: DataFrame, names: list, queries: list[np.ndarray], k: int, short_share: float, item_type) -> DataFrame:
    voc = Vocabulary(np.unique(np.concatenate(queries)))
    index = stored(src.mapInArrow(_blocks(spark.sparkContext.broadcast(voc)), INDEX_SCHEMA), "postings")
    n_docs, n_terms = (x or 0 for x in index.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    # at most one row for each query term
    lists = index.select(F.inline(F.arrays_zip("terms", "sizes"))).groupBy("terms").agg(F.sum("sizes")).collect()
    df = np.zeros(len(voc.terms), np.int64)
    for t, n in lists:
        df[t] = n
    weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) if x else 0 for x in df]
    split = []
    for q in queries:
        used = [t for t in np.searchsorted(voc.terms, q).tolist() if weight[t] > 0]
        split.append(tuple([(t, weight[t]) for t in used if (df[t] <= short_share * n_docs) == is_short] for is_short in (True, False)))
    found = index.mapInArrow(_search(spark.sparkContext.broadcast((split, n_docs, n_terms)), k), "query int, doc_id long, score long")
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    found = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(MERGE_PARTS)))
    for keys in (("query", "part"), ("query",)):
        found = found.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    named = spark.createDataFrame(list(enumerate(names)), T.StructType([T.StructField("query", T.IntegerType()), T.StructField("item", item_type)]))
    return found.join(F.broadcast(named), "query").select("item", "rank", "doc_id", "score")
