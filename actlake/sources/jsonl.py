"""Prompt and completion readers.

JSON lines, plain or zstd-compressed, with an explicit schema: blank and
whitespace-only lines are skipped, a malformed line fails the job, extra
fields are ignored. Several files, folders or globs are one read; each row keeps its
file's position (``src_ord``: the order of the given paths, then the file name) and
its place inside the file (``line_ord``: the split's offset in the file, then the
row) so "last row wins" can be decided after a shuffle, however the
file was split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROMPT_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("prompt", T.StringType())])
COMPLETION_SCHEMA = T.StructType([T.StructField("prompt_id", T.LongType()),
                                  T.StructField("completion_idx", T.IntegerType()),
                                  T.StructField("text", T.StringType())])


def file_order(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, src_ord) of every file the paths name, by path given (the last mention counts), then name.

    Files are listed by Spark, so names have the form that a read of them reports.
    """
    named: dict[str, int] = {}
    for i, p in enumerate(paths):
        listing = spark.read.format("binaryFile").load(p).select(F.col("_metadata.file_path").alias("f"))
        for r in listing.toLocalIterator():
            named[r["f"]] = i
    order = sorted(named, key=lambda f: (named[f], f))
    return spark.createDataFrame([(f, i) for i, f in enumerate(order)], "file string, src_ord int")


def read_jsonl(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """Explicit schema, FAILFAST; adds src_ord and line_ord. A row of a file that was not
    listed (it came between listing and reading) fails the job."""
    if not paths:
        raise ValueError("no input files")
    df = (spark.read.schema(schema).option("mode", "FAILFAST").json(paths)
          .select("*", F.col("_metadata.file_path").alias("file"),
                  F.struct(F.col("_metadata.file_block_start").alias("split"),
                           F.monotonically_increasing_id().alias("row")).alias("line_ord")))
    out = df.join(file_order(spark, paths), "file", "left")
    missing = F.raise_error(F.concat(F.lit("no position known for input file "), F.col("file"))).cast("int")
    return out.withColumn("src_ord", F.coalesce("src_ord", missing)).drop("file")


def read_prompts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """S3: prompt files -> ``prompt_id, prompt, src_ord, line_ord``."""
    df = read_jsonl(spark, list(paths), PROMPT_SCHEMA)
    return df.select(F.col("id").alias("prompt_id"), "prompt", "src_ord", "line_ord")


def read_completions(spark: SparkSession, paths: list[str], repartition: int | None = None) -> DataFrame:
    """S3: completion files (``.jsonl`` or ``.jsonl.zst``); compressed files are
    one task each, so spread the rows before heavy work."""
    df = read_jsonl(spark, list(paths), COMPLETION_SCHEMA)
    if repartition:
        df = df.repartition(repartition, "prompt_id")
    return df.select("prompt_id", "completion_idx", "text", "src_ord", "line_ord")
