"""Grouped prefix join: documents whose word-shingle sets have a Jaccard similarity of at least t.

A document's set is ordered by one global order (shingles that are frequent among
first prefixes come last, all others by hash). Its prefix holds the first steps of that order: pairs of
neighbours, the first shingle counting as a neighbour of the start. Of a set of n shingles at most
2 (1 - t) n steps are not steps of a set that links with it: a missing shingle breaks two, a further one of
the other set breaks one. So two sets that link share m steps among their first 2 (1 - t) n + m;
m grows with n. Unrelated long documents share many single shingles but hardly ever a step, so lists stay short at every size.
Below t = 3/4 the prefixes hold the shingles themselves, n - ceil(t n) + m of them. Documents with equal sets form a
class; classes with the same size and the same prefix form a group, so the inverted index
holds groups. Two groups that share many lists are paired in one of them: that of the least entry that both have
among their LEAST_ENTRIES least; only without one are they paired in each. Group pairs are filtered by size, by a
256-bit parity sketch (of a group: by the cells in which its members agree) and by the number of shared prefix entries,
expanded to member pairs, filtered again, and verified by exact intersection.

The join works in two rounds. Round one tries every class against its group's hub and the hubs of its longest lists: the
set nearest to what most sets of the list hold, the original of near copies. What links becomes one component. Round two pairs
everything that is left between different components, leaving out each list's
dominant component against itself, so a large group of near copies costs rows in
proportion to its members and never all its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .bloom import repeat_filter
from .common import connected_components, held, written
from .hashing import batch_bytes, hash_words, mix, shingles

#: A shingle that more prefixes hold goes to the end of the order; at least this, and so many
#: that the list of such shingles, which is broadcast, has at most HOT_LIST entries.
HOT_PREFIXES = 64
HOT_LIST = 1_000_000
#: Bytes of text that one numpy pass takes at a time.
CHUNK_BYTES = 512 << 10
#: One shared prefix shingle more is asked for every so many shingles of a set.
SHARE_STEP = 64
#: Hubs that round one tries for a class, those of its longest lists first.
HUBS = 2
#: So many least prefix entries go with a posting, to tell the one list of several in which two groups are paired.
LEAST_ENTRIES = 8
#: From this similarity on, prefixes hold steps; at least half of a set's steps are then in every set that links with it.
STEPS_FROM = (3, 4)
SKETCH = ["b0", "b1", "b2", "b3"]
#: Sketch cells in which the members of a group differ.
VARY = ["v0", "v1", "v2", "v3"]


def _chunks(batches: Iterator[pa.RecordBatch], only=None) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, bytes, offsets) in pieces of whole texts of about CHUNK_BYTES.

    With ``only``, a filter of ids, the texts of other ids are passed over; null ids are kept.
    """
    for b in batches:
        if only is not None and b.num_rows:
            ids = b.column(0)
            keep = only.maybe_repeated(ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64))
            b = b.filter(pa.array(keep | ids.is_null().to_numpy(zero_copy_only=False)))
        raw, off = batch_bytes(b.column(1))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + CHUNK_BYTES, "right")) - 1)
            yield b.column(0).slice(at, end - at), raw[off[at]:off[end]], off[at:end + 1] - off[at]
            at = end


class Sets:
    """The shingle sets of one piece of documents: values of document i ascending in [starts[i], starts[i + 1])."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, k: int):
        words, counts = hash_words(raw, off)
        v, n = shingles(words, counts, k)
        ends = np.cumsum(n)
        for a, z in zip(ends - n, ends, strict=True):
            v[a:z].sort()
        doc = np.repeat(np.arange(len(n)), n)
        keep = np.ones(len(v), bool)
        keep[1:] = (v[1:] != v[:-1]) | (doc[1:] != doc[:-1])
        self.values = v[keep]
        self.n = np.bincount(doc[keep], minlength=len(n))
        self.starts = np.concatenate([[0], np.cumsum(self.n)])

    def of(self, i: int) -> np.ndarray:
        return self.values[self.starts[i]:self.starts[i + 1]]

    def firsts(self, size: np.ndarray, hot: np.ndarray) -> list[np.ndarray]:
        """The first ``size`` shingles of every document; hot holds the hot shingles by value, with their ranks in the order.
        Also sets ``hot``, the number of hot shingles in each set."""
        if not len(hot):
            self.hot = np.zeros(len(self.n), np.int64)
            return [self.of(i)[:size[i]] for i in range(len(self.n))]
        at = np.minimum(np.searchsorted(hot[0], self.values), len(hot[0]) - 1)
        is_hot, rank = hot[0][at] == self.values, hot[1][at]
        upto = np.concatenate([[0], np.cumsum(is_hot)])
        self.hot = upto[self.starts[1:]] - upto[self.starts[:-1]]
        out = []
        for i in range(len(self.n)):
            a, z = self.starts[i], self.starts[i + 1]
            x, m = self.values[a:z], is_hot[a:z]
            p = x[~m][:size[i]]
            if len(p) < size[i]:
                late = x[m][np.argsort(rank[a:z][m], kind="stable")]
                p = np.concatenate([p, late[:size[i] - len(p)]])
            out.append(p)
        return out

    def shingle_prefixes(self, t: tuple[int, int], hot: np.ndarray) -> list[np.ndarray]:
        """The shingles that two linked sets share some of."""
        return self.firsts(np.minimum(self.n, self.n - -(-t[0] * self.n // t[1]) + 1 + self.n // SHARE_STEP), hot)

    def prefixes(self, t: tuple[int, int], hot: np.ndarray) -> list[np.ndarray]:
        """The prefix of every document: steps of the order, or shingles where the similarity is low."""
        if t[0] * STEPS_FROM[1] < t[1] * STEPS_FROM[0]:
            return self.shingle_prefixes(t, hot)
        size = 2 * (t[1] - t[0]) * self.n // t[1] + 1 + self.n // SHARE_STEP
        return [_steps(x) for x in self.firsts(np.minimum(self.n, size), hot)]

    def sketches(self) -> list[np.ndarray]:
        """Four 64-bit words per document: the parity of shingles at each of 256 cells."""
        some = self.n > 0
        out = []
        for w in range(4):
            bits = np.where((self.values >> np.uint64(6)) & np.uint64(3) == w,
                            np.uint64(1) << (self.values & np.uint64(63)), np.uint64(0))
            col = np.zeros(len(self.n), np.uint64)
            if some.any():
                col[some] = np.bitwise_xor.reduceat(bits, self.starts[:-1][some])
            out.append(col.view(np.int64))
        return out

    def digest(self, i: int) -> int:
        return _long(self.of(i).tobytes())


def _steps(x: np.ndarray) -> np.ndarray:
    """A hash of every shingle with the one before it."""
    before = np.zeros_like(x)
    before[1:] = x[:-1]
    return mix(mix(before) + x)


def _long(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _hot_arrays(hot) -> np.ndarray | tuple:
    return hot.value if hot is not None else ()


def _prefix_tokens(k, t, hot):
    """First shingles of every document, as one long column."""
    def run(batches):
        for _, raw, off in _chunks(batches):
            p = Sets(raw, off, k).shingle_prefixes(t, _hot_arrays(hot))
            if p:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p).view(np.int64))], ["token"])
    return run


def _documents(k, t, hot):
    """(doc_id, n, hot, cid, gid, sketch, prefix, least): size, hot shingles, class, group, prefix and two least shingles
    of every document."""
    def run(batches):
        for ids, raw, off in _chunks(batches):
            s = Sets(raw, off, k)
            p = s.prefixes(t, _hot_arrays(hot))
            cid = [s.digest(i) if s.n[i] else None for i in range(len(s.n))]
            gid = [_long(np.append(x, np.uint64(n)).tobytes()) for x, n in zip(p, s.n, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(s.n, pa.int64()), pa.array(s.hot, pa.int64()), pa.array(cid, pa.int64()), pa.array(gid, pa.int64()),
                 *(pa.array(x) for x in s.sketches()), _lists(p), _lists([s.of(i)[:2] for i in range(len(p))])],
                ["doc_id", "n", "hot", "cid", "gid", *SKETCH, "prefix", "least"])
    return run


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([len(x) for x in parts])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat.view(np.int64)))


def _in_filter(filt):
    @F.arrow_udf("boolean")  # of Arrow: a task needs no pandas
    def maybe(value: pa.Array) -> pa.Array:
        return pa.array(filt.maybe_repeated(value.to_numpy(zero_copy_only=False).view(np.uint64)))
    return maybe


def _of_groups(again, b: pa.RecordBatch) -> np.ndarray:
    """Which rows (gid, shared) are groups: those of several documents, and documents with a prefix of their own."""
    gid, shared = b.column(0), b.column(1)
    return shared.to_numpy(zero_copy_only=False) | ~again.maybe_repeated(gid.to_numpy(zero_copy_only=False).view(np.uint64))


def _entries(again, kept):
    """Of (gid, shared, prefix) the entries that ``kept`` lets through, none of a row that is no group. One function asks both
    filters, so that a task needs one Python worker and no entry passes it that goes."""
    @F.arrow_udf("array<long>")
    def entries(gid: pa.Array, shared: pa.Array, prefix: pa.Array) -> pa.Array:
        n = np.diff(prefix.offsets.to_numpy())
        flat = prefix.flatten().to_numpy(zero_copy_only=False)
        is_group = _of_groups(again, pa.RecordBatch.from_arrays([gid, shared], ["gid", "shared"]))
        keep = np.repeat(is_group, n)
        keep[keep] = kept.maybe_repeated(flat[keep].view(np.uint64))
        ends = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], np.cumsum(n)])]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat[keep]))
    return entries


def _prefixes_of(again):
    """The prefix entries of the groups in a batch of (gid, shared, prefix), for a filter."""
    def values(b: pa.RecordBatch) -> np.ndarray:
        return b.filter(pa.array(_of_groups(again, b))).column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    return values


def _wanted_sets(k, ids, classes):
    """(cid, tokens) of the classes asked for, once a task: only texts with their ids are read."""
    def run(batches):
        sent: set[int] = set()
        for _, raw, off in _chunks(batches, ids):
            s = Sets(raw, off, k)
            cid = np.array([s.digest(i) if s.n[i] else 0 for i in range(len(s.n))], np.int64)
            cids, toks = [], []
            for i in np.flatnonzero(classes.maybe_repeated(cid.view(np.uint64)) & (s.n > 0)):
                if (c := int(cid[i])) not in sent:
                    sent.add(c)
                    cids.append(c)
                    toks.append(s.of(i))
            if cids:
                yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), _lists(toks)], ["cid", "tokens"])
    return run


def _kept(df: DataFrame, name: str) -> DataFrame:
    """Written in files of an even size: what makes the rows keeps its own number of tasks."""
    return written(df.hint("rebalance"), name)


def _share(n: Column, more: Column, t: tuple[int, int]) -> Column:
    """Prefix entries that linked sets of n and ``more`` >= n shingles share, at least.

    By their sizes the sets lack at most x and y of each other's shingles, which break 2 x + y of the steps of the one;
    so many of a prefix may be missing, and the first of the others are in both prefixes.
    """
    least = F.floor(n / SHARE_STEP) + 1
    if t[0] * STEPS_FROM[1] < t[1] * STEPS_FROM[0]:
        return least
    both = F.floor((t[0] * (n + more) + (t[0] + t[1] - 1)) / (t[0] + t[1]))

    def left(size: Column, other: Column) -> Column:
        prefix = F.least(size, F.floor(2 * (t[1] - t[0]) * size / t[1] + 1e-9) + 1 + F.floor(size / SHARE_STEP))
        return prefix - 2 * (size - both) - (other - both)
    return F.greatest(least, F.least(left(n, more), left(more, n)))


def _close(a: str, b: str, t: tuple[int, int]) -> Column:
    """Sizes within the threshold: necessary for a link."""
    return (F.least(f"{a}.n", f"{b}.n") * t[1]) >= (F.greatest(f"{a}.n", f"{b}.n") * t[0])


def _alike(a: str, b: str, t: tuple[int, int], groups: bool = False) -> Column:
    """Sketches differ in no more cells than a linked pair's shingles can: necessary for a link. Of groups only the
    cells in which either's members agree are compared: necessary for a link of any two members."""
    total = F.col(f"{a}.n") + F.col(f"{b}.n")
    differ = F.lit(0)
    for w, v in zip(SKETCH, VARY, strict=True):
        differ = differ + F.expr(f"bit_count(({a}.{w} ^ {b}.{w}) & ~({a}.{v} | {b}.{v}))" if groups else f"bit_count({a}.{w} ^ {b}.{w})")
    return differ <= total - 2 * F.ceil(total * t[0] / (t[0] + t[1]) - 1e-9)


def jaccard_join(docs: DataFrame, k: int = 3, t: tuple[int, int] = (90, 100), id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, class_id.

    Words are the maximal runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased; a set holds the
    distinct k-word shingles (fewer words: the whole sequence). Documents link when
    t[1] * intersection >= t[0] * union. component_id is the least id reachable by links;
    links inside a component beyond those that span it are not looked for.
    Null, empty and blank texts have an empty set, link with nothing and are their own
    component. Rows with equal ids or repeated rows are each answered; a null id is passed over as
    a component's name unless the component has no other. Other columns are not read.

    Equality of shingles and of sets is by 64-bit hashes. Texts are read twice, those of candidates
    twice again, and never shuffled; only prefix postings that may be shared, and the sets of candidate pairs, are. Building the
    frame runs jobs that write tables. Broadcast: the
    hot list (at most HOT_LIST longs) and filters (at most 32 MB each).
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n_docs = src.count()  # sizes the filters
    counts = held(src.mapInArrow(_prefix_tokens(k, t, None), "token long").groupBy("token").agg(F.count("*").alias("c"))
                  .filter(f"c > {HOT_PREFIXES}"))
    # each listed shingle has over `least` of at most sum(c) prefix rows
    listed, rows = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    least = HOT_PREFIXES if listed <= HOT_LIST else max(HOT_PREFIXES, rows // HOT_LIST)
    got = counts.filter(F.col("c") > least).orderBy("c", "token").toPandas() if listed else None
    counts.unpersist()
    hot = None
    if got is not None and len(got):
        tokens = got["token"].to_numpy().view(np.uint64)
        order = np.argsort(tokens)
        hot = spark.sparkContext.broadcast((tokens[order], order.astype(np.int64)))

    own = written(src.mapInArrow(_documents(k, t, hot), "doc_id long, n long, hot long, cid long, gid long, b0 long, b1 long, "
                                 "b2 long, b3 long, prefix array<long>, least array<long>"), "sets")
    rows = own.filter("n > 0")
    classes = _kept(rows.groupBy("cid").agg(*(F.first(c).alias(c) for c in ["gid", "n", "hot", "least", *SKETCH])), "classes")
    # a group of one document goes through as it is; only possibly repeated groups shuffle
    again = repeat_filter(rows.select("gid"), n_docs)
    cols = ["gid", "cid", "n", "prefix", *SKETCH]
    several = written(rows.filter(_in_filter(again)("gid")).groupBy("gid").agg(
        F.min("cid").alias("cid"), F.max("cid").alias("last"), F.first("n").alias("n"), F.first("prefix").alias("prefix"),
        *(F.bit_and(w).alias(w) for w in SKETCH), *(F.bit_or(w).bitwiseXOR(F.bit_and(w)).alias(v) for w, v in zip(SKETCH, VARY, strict=True))),
        "several")
    # every document, and the groups of several; a document whose prefix may be repeated is no group
    either = rows.select(*cols, *(F.lit(0).cast("long").alias(v) for v in VARY), F.lit(True).alias("single"), F.lit(False).alias("shared")) \
        .unionByName(several.select(*cols, *VARY, F.expr("cid = last").alias("single"), F.lit(True).alias("shared")))
    groups = either.filter(F.col("shared") | ~_in_filter(again)("gid"))
    n_prefix = groups.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]
    filt = repeat_filter(either.select("gid", "shared", "prefix"), int(n_prefix), k=1, values=_prefixes_of(again))

    # Round one: hubs. In a group, and among classes of near sizes (buckets within a factor of 1 / t) that share one of their
    # two least shingles, as similar sets mostly do. A guess, which only spares work: round two misses nothing.
    bucket = F.floor(F.log("n") / F.lit(float(np.log(t[1] / t[0])))).alias("bucket")
    hubs = classes.groupBy("gid").agg(_typical("cid").alias("hub"), F.count("*").alias("m")).filter("m > 1")
    in_group = classes.alias("a").join(hubs.alias("h"), F.expr("a.gid = h.gid")).filter("a.cid <> h.hub") \
        .select(F.col("a.cid").alias("a"), F.col("h.hub").alias("b"))
    lists = classes.select(F.explode("least").alias("token"), bucket, "cid", "n", "hot", *SKETCH)
    heads = _hubs(lists, ["token", "bucket"]).withColumn("bucket", F.explode(F.expr("sequence(bucket - 1, bucket + 1)")))
    stars = lists.alias("a").join(heads.alias("b"), F.expr("a.token = b.token and a.bucket = b.bucket")) \
        .filter(F.expr("a.cid <> b.cid") & _close("a", "b", t) & _alike("a", "b", t)) \
        .groupBy(F.col("a.cid").alias("a")).agg(F.collect_set(F.struct("m", F.col("b.cid").alias("cid"))).alias("hubs")) \
        .select("a", F.explode(F.slice(F.sort_array("hubs", False), 1, HUBS)).alias("b")).select("a", F.col("b.cid").alias("b"))
    tried = _kept(_pairs(in_group.unionByName(stars)), "star-pairs")
    links = _kept(_verify(src, own, tried, k, t), "links-1")
    comps = connected_components(links)

    # Round two: what lies between different components.
    member = _kept(classes.join(comps.withColumnRenamed("node", "cid"), "cid", "left")
                     .withColumn("comp", F.coalesce("comp", "cid")), "members")
    group = member.groupBy("gid").agg(F.min("comp").alias("comp"), F.max("comp").alias("last"), F.max(F.expr("comp <> cid")).alias("moved"),
                                       F.count("*").alias("m"))
    inner = member.join(group.filter("comp <> last").select("gid"), "gid", "left_semi")
    within = _between(inner, "gid", t, F.lit(True)).select("a", "b")
    # A group goes by its least class; one of several components is its own component here and can never be left out.
    # A group of one class that no link has moved is its own component and needs no row here.
    linked = group.filter("moved or comp <> last").select("gid", F.expr("comp <> last").alias("mixed"), F.col("comp").alias("whole"))
    every = either.select("gid", "cid", "n", "single", "shared", "prefix", F.slice(F.sort_array("prefix"), 1, LEAST_ENTRIES).alias("low"), *SKETCH, *VARY)

    def postings(kept) -> DataFrame:
        entries = every.withColumn("token", F.explode(_entries(again, kept)("gid", "shared", "prefix"))).drop("shared", "prefix")
        return entries.join(linked, "gid", "left").withColumn(
            "comp", F.when(F.col("mixed"), F.lit(None)).otherwise(F.coalesce("whole", "cid"))).drop("gid", "mixed", "whole")
    # lists of one component have no pairs: what is left is told by a filter and exact in the join
    held_by = postings(filt).drop("low").groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("comp").alias("k"), F.count("*").alias("c"))
    mixed = held(held_by.filter("lo < hi or (k < c and c > 1)").select("token"))
    lists = postings(repeat_filter(mixed, mixed.count(), min_count=1))
    mixed.unpersist()
    # two groups of different components differ in every list that they share, so the list of an entry that both have is there
    here = F.expr("coalesce(array_min(array_intersect(a.low, b.low)), a.token) = a.token")
    met = _between(lists, "token", t, F.expr("a.single and b.single"), here, _alike("a", "b", t, groups=True))
    met = _kept(met.filter("agree").drop("agree").distinct(), "met")
    pairs = _kept(_sharing(met, groups, t), "group-pairs")
    # groups of one class are classes already, and have been compared as such; only others are expanded
    # a group of one component is ``whole``: what lies in that component need not be expanded on the other side, which goes first; of two
    # mixed groups the smaller one does
    whole = member.select("cid", "gid").join(group.select("gid", F.when(F.expr("comp = last"), F.col("comp")).alias("whole"), "m"), "gid")
    wide = pairs.filter("not plain").join(whole.toDF("ga", "a", "wa", "ma"), "a").join(whole.toDF("gb", "b", "wb", "mb"), "b") \
        .withColumn("first", F.expr("wa is null and (wb is not null or ma <= mb)"))
    wide = wide.select(F.expr("if(first, ga, gb)").alias("x"), F.expr("if(first, gb, ga)").alias("y"), F.expr("if(first, wb, wa)").alias("w"))
    across = wide.join(member.alias("a"), F.expr("x = a.gid and (w is null or a.comp <> w)")) \
        .join(member.alias("b"), F.expr("y = b.gid and a.comp <> b.comp") & _close("a", "b", t) & _alike("a", "b", t)) \
        .select(F.col("a.cid").alias("a"), F.col("b.cid").alias("b")).unionByName(pairs.filter("plain").select("a", "b"))
    left = _kept(_pairs(within.unionByName(across)).join(tried, ["a", "b"], "left_anti"), "pairs-2")
    more = _kept(_verify(src, own, left, k, t), "links-2")
    # the components themselves are the nodes now
    of = member.select("cid", "comp")
    merged = more.join(of.toDF("a", "ca"), "a").join(of.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    comps = connected_components(merged).toDF("comp", "whole")
    first_id = rows.groupBy("cid").agg(F.min("doc_id").alias("first_id"))
    label = of.join(comps, "comp", "left").join(first_id, "cid").select("cid", "first_id", F.coalesce("whole", "comp").alias("comp"))
    label = _kept(label, "labels")
    label = label.join(label.groupBy("comp").agg(F.min("first_id").alias("component_id")), "comp").select("cid", "component_id")
    return own.select("doc_id", "n", "cid").join(label, "cid", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.col("cid").alias("class_id"))


def _typical(value: str) -> Column:
    """That of the set with the most hot shingles."""
    return F.max_by(value, F.struct(F.col("hot") / F.col("n"), F.col("cid")))


def _hubs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, m, cid, n, sketch): the hub of every list, which has m rows.

    For each byte of the sketch the value that most rows of the list have is found; the hub is the set whose sketch is nearest
    to these. Of near copies that change different places it is the original, which resembles each of them more than
    they do each other. Of two rows it is the one with more hot shingles.
    """
    first = held(rows.groupBy(*keys).agg(F.count("*").alias("m"), _typical("cid").alias("cid")))
    voters = rows.join(first.filter("m > 2").select(*keys), keys, "left_semi")
    word = F.element_at(F.array(*SKETCH), F.expr("cast(at div 8 as int) + 1"))
    votes = voters.select(*keys, *SKETCH, F.explode(F.sequence(F.lit(0), F.lit(31))).alias("at")) \
        .select(*keys, "at", F.call_function("shiftrightunsigned", word, F.expr("8 * (at % 8)")).bitwiseAND(F.lit(255)).alias("byte"))
    most = votes.groupBy(*keys, "at", "byte").agg(F.count("*").alias("c")) \
        .groupBy(*keys, "at").agg(F.max(F.expr("c * 256 + byte")).alias("top")) \
        .groupBy(*keys).agg(*(F.expr(f"bit_or(if(at div 8 = {i}, shiftleft(top & 255L, 8 * (at % 8)), 0L))").alias(f"most_{w}")
                              for i, w in enumerate(SKETCH)))
    away = F.expr(" + ".join(f"bit_count({w} ^ most_{w})" for w in SKETCH))
    voted = voters.join(most, keys).groupBy(*keys).agg(F.count("*").alias("m"), F.min_by("cid", F.struct(away, F.col("cid"))).alias("cid"))
    return first.filter("m <= 2").unionByName(voted).join(rows.select(*keys, "cid", "n", *SKETCH), [*keys, "cid"])


def _pairs(df: DataFrame) -> DataFrame:
    return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _sharing(met: DataFrame, groups: DataFrame, t: tuple[int, int]) -> DataFrame:
    """(a, b, plain) of the pairs of groups whose prefixes share as many entries as their sizes ask for."""
    asked = met.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    few = repeat_filter(asked, 2 * met.count(), min_count=1)
    entries = groups.filter(_in_filter(few)("cid")).select("cid", "prefix")
    both = met.join(entries.toDF("a", "pa"), "a").join(entries.toDF("b", "pb"), "b")
    return both.filter(F.size(F.array_intersect("pa", "pb")) >= _share(F.col("n"), F.col("more"), t)).select("a", "b", "plain")


def _between(rows: DataFrame, key: str, t: tuple[int, int], plain: Column, here: Column | None = None,
             agree: Column | None = None) -> DataFrame:
    """Pairs (a, b, n, more, plain) of classes in one list of ``key`` with different components, once a list; n and more are their sizes.
    With ``here``, only in the lists for which it holds; ``agree`` is given as a column.

    Each list's most frequent component is not paired with itself: one side leaves it out, and lists of a single component
    give nothing. A null component (a mixed group) differs from all. ``plain`` says when both stand for one class, so
    that their sketches can be compared.
    """
    by_comp = rows.filter("comp is not null").groupBy(key, "comp").agg(F.count("*").alias("m"))
    top = by_comp.groupBy(key).agg(F.max(F.struct("m", "comp")).alias("top")).select(key, F.col("top.comp").alias("top"))
    rest = rows.join(top, key, "left").filter("comp is null or not (comp <=> top)")
    # two classes of the rest meet twice; the smaller one leads
    once = F.expr("(a.comp is not null and a.comp <=> b.top) or a.cid < b.cid")
    return rows.alias("a").join(rest.alias("b"), F.expr(f"a.{key} = b.{key}") & F.expr(
        "a.cid <> b.cid and (a.comp is null or b.comp is null or a.comp <> b.comp)") & once & _close("a", "b", t)
        & (~plain | _alike("a", "b", t)) & (F.lit(True) if here is None else here)) \
        .select(F.least("a.cid", "b.cid").alias("a"), F.greatest("a.cid", "b.cid").alias("b"), F.least("a.n", "b.n").alias("n"),
                F.greatest("a.n", "b.n").alias("more"), plain.alias("plain"), *([] if agree is None else [agree.alias("agree")]))


def _verify(src: DataFrame, own: DataFrame, pairs: DataFrame, k: int, t: tuple[int, int]) -> DataFrame:
    """The pairs that link, by exact intersection of their sets."""
    asked = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
    # one document of each class; its text is read again
    asked = _kept(own.select("cid", "doc_id").join(asked, "cid", "left_semi").groupBy("cid").agg(F.min("doc_id").alias("doc_id")), "asked")
    n = asked.count()
    classes = repeat_filter(asked.select("cid"), n, min_count=1)
    ids = repeat_filter(asked.select("doc_id").filter("doc_id is not null"), n, min_count=1)
    sets = src.mapInArrow(_wanted_sets(k, ids, classes), "cid long, tokens array<long>")
    sets = written(sets.join(asked, "cid", "left_semi").groupBy("cid").agg(F.first("tokens").alias("tokens")), "wanted-sets")
    both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("tokens").alias("ta")), "a") \
        .join(sets.select(F.col("cid").alias("b"), F.col("tokens").alias("tb")), "b")
    common = F.size(F.array_intersect("ta", "tb"))
    return both.withColumn("i", common).filter(
        t[1] * F.col("i") >= t[0] * (F.size("ta") + F.size("tb") - F.col("i"))).select("a", "b")
