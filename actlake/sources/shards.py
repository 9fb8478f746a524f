"""Readers for stored activations and their metadata.

``activations`` is Parquet partitioned by ``run_id, layer`` and sorted by
``(prompt_id, completion_idx, token_pos)`` inside files, so a point lookup is
a partition filter plus Parquet min/max pruning, not a scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import GuardError
from ..functions.codec import decode_activations

INDEX_SCHEMA = T.StructType([
    T.StructField("prompt_id", T.LongType()), T.StructField("completion_idx", T.IntegerType()),
    T.StructField("layer", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("n_tokens", T.IntegerType())])

MANIFEST_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()), T.StructField("layers", T.ArrayType(T.IntegerType())),
    T.StructField("d_model", T.IntegerType()), T.StructField("dtype", T.StringType()),
    T.StructField("bytes_per_elem", T.IntegerType()), T.StructField("has_scales", T.BooleanType()),
    T.StructField("total_tokens_per_layer", T.MapType(T.StringType(), T.LongType())),
    T.StructField("n_sequences", T.LongType())])

CAPTURE_SCHEMA = T.StructType([
    T.StructField("batch_id", T.LongType()), T.StructField("gpu_id", T.LongType()),
    T.StructField("global_rank", T.LongType()), T.StructField("layer", T.IntegerType()),
    T.StructField("flat_pos", T.IntegerType()), T.StructField("vec", T.ArrayType(T.FloatType())),
    T.StructField("rids", T.ArrayType(T.StringType())), T.StructField("seq_lens", T.ArrayType(T.IntegerType())),
    T.StructField("prefix_lens", T.ArrayType(T.IntegerType()))])

ACTIVATION_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("layer", T.IntegerType()), T.StructField("prompt_id", T.LongType()),
    T.StructField("completion_idx", T.IntegerType()), T.StructField("token_pos", T.IntegerType()), T.StructField("dtype", T.StringType()),
    T.StructField("payload", T.BinaryType()), T.StructField("scale", T.FloatType())])

_SHARD_RE = r"/(shard_[^/]+)/[^/]+$"


def shard_of_path() -> F.Column:
    return F.regexp_extract(F.col("_metadata.file_path"), _SHARD_RE, 1)


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """S4 + S7 + T4: every ``shard_*/meta.json`` under ``root`` (or ``root/meta.json``),
    with the legacy defaults for dtype and bytes per element."""
    paths = [f"{root.rstrip('/')}/shard_*/meta.json"]
    df = _read_json_glob(spark, paths, MANIFEST_SCHEMA, multi_line=True)
    if df is None:
        df = _read_json_glob(spark, [f"{root.rstrip('/')}/meta.json"], MANIFEST_SCHEMA, multi_line=True)
        if df is None:
            raise GuardError(f"{root} holds neither shard folders nor a meta.json")
    return df.select(
        shard_of_path().alias("shard"), "model", "layers", "d_model",
        F.coalesce("dtype", F.lit("bfloat16")).alias("dtype"),
        F.coalesce("bytes_per_elem", F.lit(2)).alias("bytes_per_elem"),
        F.coalesce("has_scales", F.lit(False)).alias("has_scales"),
        F.transform_keys("total_tokens_per_layer", lambda k, v: k.cast("int")).alias("total_tokens_per_layer"),
        "n_sequences")


def read_index(spark: SparkSession, root: str) -> DataFrame:
    """S5 + T4: the sequence index of every shard, with its append order."""
    df = _read_json_glob(spark, [f"{root.rstrip('/')}/shard_*/index.jsonl"], INDEX_SCHEMA)
    if df is None:
        df = _read_json_glob(spark, [f"{root.rstrip('/')}/index.jsonl"], INDEX_SCHEMA)
        if df is None:
            raise GuardError(f"no index under {root}")
    # lines of a file in order: by the split's offset in the file, then by row
    return df.select(shard_of_path().alias("shard"), "*", F.struct(
        F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row")).alias("append_ord"))


def _read_json_glob(spark, paths, schema, multi_line=False):
    from pyspark.errors import AnalysisException
    try:
        r = spark.read.schema(schema).option("mode", "FAILFAST")
        return r.option("multiLine", str(multi_line).lower()).json(paths)
    except AnalysisException:
        return None


def read_directions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """S8 input: ``(key, vec)`` rows; parse with ``operators.steer.parse_directions``."""
    return spark.read.format(fmt).load(path).select("key", F.col("vec").cast("array<float>").alias("vec"))


def read_capture(spark: SparkSession, path: str) -> DataFrame:
    """Captured token rows (each carries its batch arrays)."""
    return spark.read.schema(CAPTURE_SCHEMA).parquet(path)


def read_activations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_runs(spark: SparkSession, root: str, run_ids=None) -> DataFrame:
    """All runs under ``root`` (one directory per run, as ``plans.jobs.ingest_job``
    writes them), each read through its own root, so that a streamed run's commit
    log decides which of its files exist (a read of several roots at once would pass it
    over). Only run directory names are listed, on the session's file system."""
    from ..session import child_dirs
    dirs = [x for x in child_dirs(spark, root) if run_ids is None or x.rsplit("/", 1)[-1] in set(run_ids)]
    if not dirs:
        raise GuardError(f"{root} holds no run of those asked for")
    out = spark.read.parquet(dirs[0])
    for x in dirs[1:]:
        out = out.unionByName(spark.read.parquet(x))
    return out


def read_sequence(acts: DataFrame, run_id: str, layer: int, prompt_id: int, completion_idx: int,
                  strict: bool = True) -> DataFrame:
    """J8 + O3: one sequence at one layer, ordered by token, decoded to fp32.

    With ``strict`` an absent sequence raises ``KeyError`` (one small probe).
    """
    x = acts.where((F.col("run_id") == run_id) & (F.col("layer") == layer)
                   & (F.col("prompt_id") == prompt_id) & (F.col("completion_idx") == completion_idx))
    if strict and not x.select("token_pos").limit(1).collect():
        raise KeyError(f"run {run_id} stores no sequence ({prompt_id}, {completion_idx}) at layer {layer}")
    if "payload" in x.columns:
        x = decode_activations(x)
    return x.orderBy("token_pos")


def _folder(spark: SparkSession, path: str, run_id: str, layer: int) -> str:
    """The folder of a run's layer, its name as Spark writes it."""
    escaped = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(run_id)
    return f"{path.rstrip('/')}/run_id={escaped}/layer={layer}"


def lookup_sequences(spark: SparkSession, path: str, run_id: str, layer: int, keys: DataFrame | list[tuple[int, int]]) -> DataFrame:
    """J8 on a table in buckets: the rows of some sequences (prompt_id, completion_idx) of a run at a layer, in no order.

    Only the folders of the keys' buckets are listed and opened, one file each (more where a bucket outgrew the file size).
    ``keys`` may be a frame; what reaches the driver is at most one number per bucket of the table.
    """
    from ..sinks.tables import BUCKET, read_layout, sequence_bucket
    from ..session import exists
    n = read_layout(spark, path)
    if not isinstance(keys, DataFrame):
        keys = spark.createDataFrame(keys, "prompt_id long, completion_idx int")
    keys = keys.select("prompt_id", "completion_idx").distinct()
    folder = _folder(spark, path, run_id, layer)
    wanted = [r[0] for r in keys.select(sequence_bucket(n).alias(BUCKET)).distinct().collect()]
    paths = [p for b in sorted(wanted) if exists(spark, p := f"{folder}/{BUCKET}={b}")]
    if not paths:
        return spark.createDataFrame([], ACTIVATION_SCHEMA)
    rows = spark.read.option("basePath", path).parquet(*paths).withColumn("run_id", F.lit(run_id))
    return rows.join(keys, ["prompt_id", "completion_idx"], "left_semi").select(*ACTIVATION_SCHEMA.names)


def lookup_sequence(spark: SparkSession, path: str, run_id: str, layer: int, prompt_id: int, completion_idx: int, strict: bool = True) -> DataFrame:
    """J8 + O3 on a table in buckets: one sequence, ordered by token, decoded; its one folder is opened. ``strict`` as ``read_sequence``."""
    from ..sinks.tables import BUCKET, read_layout, sequence_bucket
    from ..session import exists
    n = read_layout(spark, path)
    key = spark.range(1).select(F.lit(prompt_id).cast("bigint").alias("prompt_id"), F.lit(completion_idx).cast("int").alias("completion_idx"))
    bucket = key.select(sequence_bucket(n)).first()[0]
    folder = f"{_folder(spark, path, run_id, layer)}/{BUCKET}={bucket}"
    if not exists(spark, folder):
        if strict:
            raise KeyError(f"run {run_id} stores no sequence ({prompt_id}, {completion_idx}) at layer {layer}")
        return decode_activations(spark.createDataFrame([], ACTIVATION_SCHEMA))
    rows = spark.read.option("basePath", path).parquet(folder).withColumn("run_id", F.lit(run_id))
    return read_sequence(rows.select(*ACTIVATION_SCHEMA.names), run_id, layer, prompt_id, completion_idx, strict)
