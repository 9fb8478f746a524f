"""Repeated runs of lines, by a suffix array over line-ID sequences built by distributed prefix doubling.

Every line is a symbol. Round by round, a suffix's rank over h lines and the rank of the suffix h lines
further give its rank over 2h lines: the distinct pairs are sorted and numbered
across the cluster, and joined back. A suffix whose rank is its alone has no longest common prefix
with any other of that length and is settled; only the others go on, so the tables shrink. Suffixes with equal
ranks over ``min_lines`` lines are the interval of the suffix array whose common prefixes reach
that length: its first member stays and the lines of all others are deleted. Shorter runs count by their
words: with ``min_words``, every length up to ``min_lines`` is ranked. Longer ones need no ranks of their own, for a
repeated run of more lines is covered by its repeated runs of ``min_lines``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .common import join_stats, written

#: Lines in the shortest run that counts as repeated.
MIN_LINES = 3
#: Words over which a shorter run counts too, as the query op3_line_runs asks; bytes that count as one word at least, for text without blanks.
MIN_WORDS = 50
WORD_BYTES = 20


def _numbered(distinct: DataFrame, cols: list[str], rows: int) -> DataFrame:
    """Distinct rows with ``rank``: their place in the global order of ``cols``.

    The rows are dealt to sorted ranges and written; each range numbers its own rows and
    adds the rows of the ranges before it.
    """
    dealt = written(distinct.repartitionByRange(*cols).withColumn("part", F.spark_partition_id()), "ranges", rows)
    sizes = dealt.groupBy("part").agg(F.count("*").alias("c"))
    # one row for each range, so a window over all of them is as long as the number of partitions
    before = sizes.select("part", (F.sum("c").over(W.orderBy("part")) - F.col("c")).alias("before"))
    own = F.row_number().over(W.partitionBy("part").orderBy(*cols))
    return dealt.withColumn("own", own).join(F.broadcast(before), "part") \
        .withColumn("rank", F.col("before") + F.col("own")).drop("part", "own", "before")


def _ranked(rows: DataFrame, cols: list[str], total: int) -> DataFrame:
    """Rows (doc, uid, pos) whose ``cols`` occur more than once, with their common ``rank``."""
    names = rows.groupBy(*cols).agg(F.count("*").alias("c")).filter("c > 1")
    names = written(_numbered(names, cols, total).withColumn("name", F.xxhash64(*cols)), "names", total)
    out = join_stats(rows.withColumn("name", F.xxhash64(*cols)), names.withColumnsRenamed({c: f"{c}_" for c in cols}),
                     "name", "c", total)
    same = F.lit(True)
    for c in cols:
        same = same & (F.col(c) == F.col(f"{c}_"))
    words = [c for c in ("own", "words") if c in rows.columns]
    return written(out.filter(same).select("doc", "uid", "pos", *words, F.col("rank").alias("r")), "suffixes", total)


def _pairs(ranks: DataFrame, h: int) -> DataFrame:
    """(doc, uid, pos, r, s): the ranks of a suffix and of the one h lines further in its text.

    Where words are counted, h is 1: the longer run has those of its first line and of the run one line further.
    """
    if "words" not in ranks.columns:
        further = ranks.select("uid", (F.col("pos") - h).alias("pos"), F.col("r").alias("s"))
        return ranks.join(further, ["uid", "pos"])
    further = ranks.select("uid", (F.col("pos") - 1).alias("pos"), F.col("r").alias("s"), F.col("words").alias("more"))
    return ranks.join(further, ["uid", "pos"]).withColumn("words", F.col("own") + F.col("more")).drop("more")


def _late(ranks: DataFrame, lines: int, total: int) -> DataFrame:
    """(uid, pos, end) of the runs of so many lines that also start earlier."""
    first = ranks.groupBy("r").agg(F.min(F.struct("doc", "uid", "pos")).alias("first"), F.count("*").alias("c"))
    late = join_stats(ranks, first, "r", "c", total).filter(F.expr("first <> struct(doc, uid, pos)"))
    return late.select("uid", "pos", (F.col("pos") + lines).alias("end"))


def remove_repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, id_col: str = "doc_id", text_col: str = "text",
                          min_words: int | None = None) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed, runs (start, lines: deleted maximal runs, from 0), text (what stays).

    Lines are the pieces between line feeds, compared byte for byte (by 64-bit hash). A line goes if it lies in a run of
    ``min_lines`` lines, or with ``min_words`` in a run of fewer lines with more than so many words, that also starts
    earlier: in a smaller doc_id, or earlier in the same text. Words are parted by white space; a line has at least
    one for each WORD_BYTES bytes. Runs are judged on the input. A null text stays null with no lines; an empty text is one empty line; a text with fewer lines loses none. A null
    id is before all others; texts that share an id are ordered by a hash of their text; rows that repeat both
    are one document, each with its result. A text of which nothing is left becomes empty. Other columns are not read.

    Texts shuffle once, to meet their runs. A line or run that a large share of all rows holds is counted by partial
    aggregates and joined back by ``join_stats``.
    """
    if min_lines < 1:
        raise ValueError("min_lines must be at least 1")
    docid, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    uid = F.xxhash64(docid, text)

    def symbol(x):
        if min_words is None:
            return F.xxhash64(x)
        words = F.greatest(F.regexp_count(x, F.lit(r"\S+")), F.floor(F.octet_length(x) / WORD_BYTES).cast("int"))
        return F.struct(F.xxhash64(x).alias("line"), words.cast("long").alias("own"))
    lines = docs.filter(text.isNotNull()).select(
        F.coalesce(docid, F.lit(-(2**63))).alias("doc"), uid.alias("uid"),
        F.posexplode(F.transform(F.split(text, "\n", -1), symbol)).alias("pos", "line"))
    lines = lines.withColumn("pos", F.col("pos").cast("long"))
    if min_words is not None:
        lines = lines.select("doc", "uid", "pos", F.col("line.line").alias("line"), F.col("line.own").alias("own"),
                             F.col("line.own").alias("words"))
    twice = docs.groupBy(docid.alias("i"), uid.alias("u")).agg(F.count("*").alias("n")).filter("n > 1")
    lines = written(lines, "lines")
    if twice.limit(1).count():
        lines = written(lines.dropDuplicates(["uid", "pos"]), "lines-once")
    total = lines.count()
    ranks, h = _ranked(lines, ["line"], total), 1
    late = None
    if min_words is None:
        while 2 * h <= min_lines:
            ranks, h = _ranked(_pairs(ranks, h), ["r", "s"], total), 2 * h
        if h < min_lines:  # the last length overlaps itself
            ranks = _ranked(_pairs(ranks, min_lines - h), ["r", "s"], total)
    else:  # shorter runs may have the words: every length gets its ranks
        while h < min_lines:
            short = _late(ranks.filter(F.col("words") > min_words), h, total)
            late = short if late is None else late.unionByName(short)
            ranks, h = _ranked(_pairs(ranks, 1), ["r", "s"], total), h + 1
    last = _late(ranks, min_lines, total)
    late = last if late is None else late.unionByName(last)
    lost = late.select("uid", F.explode(F.expr("sequence(pos, end - 1)")).alias("pos"))
    lost = lost.groupBy("uid").agg(F.array_sort(F.collect_set("pos")).alias("lost"))
    # neighbouring lines join into one deleted run
    begin = F.filter("lost", lambda p, i: (i == 0) | (p > F.get("lost", i - 1) + 1))
    finish = F.filter("lost", lambda p, i: (i == F.size("lost") - 1) | (F.get("lost", i + 1) > p + 1))
    late = lost.select("uid", F.zip_with(begin, finish, lambda a, z: F.struct(
        a.alias("start"), (z + 1 - a).alias("lines"))).alias("runs"))
    out = docs.select(docid.alias("doc_id"), text.alias("text"), uid.alias("uid")).join(late, "uid", "left")
    out = out.withColumn("all", F.split("text", "\n", -1)).withColumn("runs", F.coalesce("runs", F.array().cast("array<struct<start: bigint, lines: bigint>>")))
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["lines"])
    # what stays between the deleted runs
    edge = F.concat(F.array(F.lit(0).cast("long")), F.transform("runs", lambda r: r["start"] + r["lines"]))
    until = F.concat(F.transform("runs", lambda r: r["start"]), F.array(F.size("all").cast("long")))
    kept = F.flatten(F.zip_with(edge, until, lambda a, z: F.slice(F.col("all"), (a + 1).cast("int"), (z - a).cast("int"))))
    return out.select("doc_id", F.coalesce(F.size("all"), F.lit(0)).cast("long").alias("n_lines"),
                      removed.alias("n_removed"), "runs",
                      F.when(F.size("runs") == 0, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
