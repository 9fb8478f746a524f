"""Continuous ingest of captured batches (R1-R7) with Structured Streaming.

Each captured token row carries its batch's ``rids / seq_lens / prefix_lens``
arrays, so demux is row-local (``operators.demux.demux_rows``): the stream
needs no join and no state. The same functions run in batch mode.

* R1  readStream (file source) -> layer / replica / prefill filters -> demux
      -> encode -> writeStream Parquet partitioned by run_id, layer.
* R2  back-pressure: ``maxFilesPerTrigger`` / ``maxBytesPerTrigger``.
* R3  drain and stop: ``trigger(availableNow=True)`` + ``awaitTermination``.
* R4  failures surface through ``StreamingQuery.exception()`` and a raise.
* R5  incremental manifest: per-micro-batch token counts of sequences, put once per epoch
      into a log that merges its tables (``epochlog``); the manifest is their sum.
* R6  resume: the checkpoint makes restarts exactly-once.
* R7  replica duplicates: in the stream by one bit of state per token, dropped at the run's end (``streaming.dedup``); in
      a job when the run has ended, in the shuffle that sorts it (``sinks.tables.write_activations`` with ``dedup``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import RunConfig
from ..functions.codec import encode_activations
from ..operators.demux import capturing_replica, demux_rows, dp_rank, is_prefill, with_offsets
from ..sources.shards import CAPTURE_SCHEMA


def capture_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = 64,
                   max_bytes_per_trigger: str | None = None) -> DataFrame:
    """S9 + R2: captured token rows as a stream with bounded work per trigger."""
    r = spark.readStream.schema(CAPTURE_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    if max_bytes_per_trigger:
        r = r.option("maxBytesPerTrigger", max_bytes_per_trigger)
    return r.parquet(path)


def capture_to_tokens(tokens: DataFrame, cfg: RunConfig) -> DataFrame:
    """P3 + P4 + P5 + P6 + W2 + P7 on token rows carrying batch arrays, not yet encoded.

    Works on a static DataFrame and on a stream alike.
    """
    x = tokens
    if cfg.layers:
        x = x.where(F.col("layer").isin(list(cfg.layers)))
    x = x.where(capturing_replica(F.col("global_rank"), cfg.tp) & is_prefill())
    x = with_offsets(x).withColumn("dp_rank", dp_rank(F.col("gpu_id"), cfg.tp))
    x = demux_rows(x)
    return x.select(F.lit(cfg.run_id).alias("run_id"), "layer", "prompt_id", "completion_idx", "token_pos",
                    "rid", "dp_rank", "batch_id", "vec")


def capture_to_activations(tokens: DataFrame, cfg: RunConfig, d_model: int | None = None) -> DataFrame:
    """``capture_to_tokens`` + V8; with ``d_model`` vectors of another length fail the job."""
    return encode_activations(capture_to_tokens(tokens, cfg), cfg.dtype, d_model=d_model)


def start_ingest(stream: DataFrame, cfg: RunConfig, out_path: str, checkpoint: str,
                 available_now: bool = True, processing_time: str | None = None,
                 d_model: int | None = None) -> StreamingQuery:
    """R1 + R3 + R6: start the ingest query (exactly-once through the checkpoint).

    Files come as small as the triggers; ``plans.jobs.ingest_job`` rewrites the run sorted when it has ended.
    """
    return stream_writer(capture_to_activations(stream, cfg, d_model), checkpoint, available_now, processing_time).start(out_path)


def stream_writer(acts: DataFrame, checkpoint: str, available_now: bool = True, processing_time: str | None = None):
    """The Parquet sink of a stream of activation rows, one folder per run and layer."""
    w = (acts.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint).partitionBy("run_id", "layer"))
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w


def drain(q: StreamingQuery, timeout_s: float | None = None) -> None:
    """R3 + R4: wait for the query's end; re-raise its failure. With a limit, a query that has
    not ended by then is stopped and ``TimeoutError`` is raised: what it wrote is a part of the run."""
    ended = True
    if timeout_s is None:
        q.awaitTermination()
    else:
        ended = q.awaitTermination(timeout_s)
    exc = q.exception()
    if exc is not None:
        raise RuntimeError(f"ingest failed: {exc}")
    if not ended:
        q.stop()
        raise TimeoutError(f"ingest has not ended after {timeout_s} s; its output is incomplete")


def sequence_counts(rows: DataFrame) -> DataFrame:
    """Rows of a manifest log: tokens per sequence and layer of a run; a sequence that comes in parts is one row."""
    return rows.groupBy("run_id", "layer", "prompt_id", "completion_idx").agg(F.sum("tokens").cast("bigint").alias("tokens"))


def start_manifest_updates(stream: DataFrame, cfg: RunConfig, out_path: str, checkpoint: str,
                           available_now: bool = True) -> StreamingQuery:
    """Per-epoch token counts per (run, layer, sequence) in a log that stays short (``epochlog``); a replay changes nothing."""
    from .epochlog import EpochLog
    # counted before any vector is encoded: the scan reads no vector column
    counts = capture_to_tokens(stream, cfg).select("run_id", "layer", "prompt_id", "completion_idx", F.lit(1).cast("bigint").alias("tokens"))

    def per_batch(df: DataFrame, epoch: int) -> None:
        EpochLog(df.sparkSession, out_path, sequence_counts).put(int(epoch), df)

    w = counts.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def read_manifest_updates(spark: SparkSession, out_path: str) -> DataFrame:
    """R5 read side: current tokens and sequences per (run, layer). Sequences are those with a parsed request id; the others share a key."""
    from .epochlog import EpochLog
    rows = EpochLog(spark, out_path, sequence_counts).read()
    return rows.groupBy("run_id", "layer").agg(F.sum("tokens").cast("bigint").alias("total_tokens"),
                                               F.count_if(F.col("prompt_id") >= 0).alias("n_sequences"))
