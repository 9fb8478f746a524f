"""Documents to training shards: language, near duplicates, benchmark leaks, mixture, shards.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of documents. Rows
are told apart by a hash of id and text, so null and repeated ids are no special case; rows that repeat
both are copies, of which the near-duplicate stage keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from actlake.llm import decontaminate, lang_id, mixing, ngram_join, sharding
from actlake.llm.common import held, written
from actlake.session import ensure_checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ROW = "pipeline_row"
#: Near duplicates: five words, similarity 0.8.
SHINGLE_WORDS, SIMILARITY = 5, (80, 100)
MIX_SEED, MIX_POWER, MIX_EPOCHS = "mix-1", 0.7, 1.0
SHARDS = 40


def _row() -> F.Column:
    return F.xxhash64("doc_id", "text").alias(ROW)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised: dictionaries are fitted on the labelled ones, then every
    text is classified; ``und`` and narrow margins go. lang keeps its given value."""
    model = lang_id.fit_dictionaries(docs)
    return lang_id.predict(docs.select(*COLUMNS), model).filter("accepted").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of similar texts stays: the least doc_id (null last). Texts without words are no copies of each other."""
    rows = docs.select(_row(), "doc_id", "text")
    found = held(ngram_join.jaccard_join(rows, SHINGLE_WORDS, SIMILARITY, id_col=ROW).select(
        F.col("doc_id").alias(ROW), "component_id"))
    # only rows with a partner take part; all others stay as they are
    sizes = found.groupBy("component_id").agg(F.count("*").alias("n")).filter("n > 1")
    grouped = held(found.join(sizes, "component_id", "left_semi").distinct())
    ids = docs.select(_row(), "doc_id").join(grouped, ROW)
    stays = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(ROW))).alias("k"))
    go = held(grouped.join(stays.select(F.col(f"k.{ROW}").alias(ROW)), ROW, "left_anti").select(ROW))
    kept = docs.select(*COLUMNS, _row()).join(go, ROW, "left_anti")
    twice = found.groupBy(ROW).agg(F.count("*").alias("n")).filter("n > 1").select(ROW)
    if not twice.limit(1).count():
        return kept.select(*COLUMNS)
    once = kept.join(twice, ROW, "left_anti").select(*COLUMNS)
    return once.unionByName(kept.join(twice, ROW, "left_semi").dropDuplicates([ROW]).select(*COLUMNS))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    items = decontaminate.question_and_answer(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = decontaminate.find_leaks(docs.select(_row(), "text"), items, id_col=ROW)
    leaks = held(leaks.select(F.col("doc_id").alias(ROW)).distinct())
    leaks.count()  # their size is known now: where they are few no text is shuffled
    return docs.select(*COLUMNS, _row()).join(leaks, ROW, "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents by their Poisson counts so that source shares follow count ** 0.7."""
    return mixing.poisson_mix(docs.select(*COLUMNS), MIX_SEED, power=MIX_POWER, epochs=MIX_EPOCHS).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every document copy: doc_id, size, text_crc32, shard (0 to 39), slot."""
    return sharding.shard_groups(docs, n_shards=SHARDS).drop("group")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("mixture", mix_sources),
    ("shards", shard),
]
#: SQL cannot express the first stage; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    ensure_checkpoint_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
