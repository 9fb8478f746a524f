"""Index and shards while a run is ingested (K7, W1, K3): every trigger appends its sequences to the shard that is open.

A trigger's sequences are the records of one append, in order of prompt and rollout. They go on where the last trigger stopped: in
the open shard until it reaches the limit, then in the next (``operators.layout.rotate_shards``), and after the rows that
each layer of it holds. What is carried from trigger to trigger is the open shard's number, its bytes and its rows by
layer: a table of as many rows as layers. It is kept with the epoch it belongs to, so a trigger that is replayed starts from the same place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..config import RunConfig
from ..functions.text import SHARD_DIR
from ..operators.layout import index_offsets, rotate_shards
from ..session import child_dirs, exists, stored
from .epochlog import EpochLog
from .ingest import capture_to_tokens

OPEN = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("bytes", T.LongType()), T.StructField("layer", T.IntegerType()),
                     T.StructField("end", T.LongType())])


class OpenShard:
    """The open shard after each epoch: number, bytes, and per layer the rows it holds (``<path>/state/epoch-...``)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, f"{path.rstrip('/')}/state"

    def _epochs(self) -> dict[int, str]:
        if not exists(self.spark, self.path):
            return {}
        return {int(d.rsplit("-", 1)[1]): d for d in child_dirs(self.spark, self.path)}

    def before(self, epoch: int) -> tuple[int, int, DataFrame]:
        """(shard, bytes, (layer, end)) as the last epoch before this one left it."""
        older = [e for e in self._epochs() if e < epoch]
        rows = self.spark.read.schema(OPEN).json(self._epochs()[max(older)]).collect() if older else []
        ends = self.spark.createDataFrame([(r["layer"], r["end"]) for r in rows if r["layer"] is not None], "layer int, end long")
        return (rows[0]["shard"], rows[0]["bytes"], ends) if rows else (0, 0, ends)

    def put(self, epoch: int, rows: DataFrame) -> None:
        """One row per layer, or one with a null layer. The epoch before stays, for a replay of this one."""
        rows.coalesce(1).write.mode("overwrite").json(f"{self.path}/epoch-{epoch:010d}")
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for e, d in self._epochs().items():
            if e < epoch - 1:
                p = jvm.org.apache.hadoop.fs.Path(d)
                p.getFileSystem(conf).delete(p, True)


def _no_merge(rows: DataFrame) -> DataFrame:
    return rows


def rotate_batch(spark: SparkSession, seqs: DataFrame, epoch: int, cfg: RunConfig, d_model: int, path: str) -> None:
    """One append: ``seqs`` (layer, prompt_id, completion_idx, n_tokens) become index rows (shard, start) of the epoch."""
    log, opened = EpochLog(spark, f"{path.rstrip('/')}/index", _no_merge), OpenShard(spark, path)
    seqs = stored(seqs, "append")
    number, held, ends = opened.before(epoch)
    token = d_model * cfg.bytes_per_elem + (4 if cfg.dtype == "int8" else 0)
    key, order = ["prompt_id", "completion_idx"], F.struct("prompt_id", "completion_idx")
    whole = seqs.groupBy(*key).agg((F.sum("n_tokens") * token).cast("bigint").alias("n_bytes")).withColumn("append_ord", order)
    shards, end = rotate_shards(whole, cfg.shard_bytes, open_shard=number, open_bytes=held)
    rows = seqs.join(shards.select(*key, "shard"), key).withColumn("append_ord", order)
    prior = ends.withColumn("shard", F.lit(number))
    index = index_offsets(rows, "append_ord", partition=("shard", "layer"), prior_end=prior)
    index = stored(index.select("shard", "layer", *key, "start", "n_tokens", F.lit(epoch).cast("long").alias("epoch")), "append-index")
    last = end.first()
    now, filled = (last["_shard"], last["_carried"]) if last else (number, held)
    # what the open shard holds now: what it held before if it is still the same, and what this append put there
    rest = index.where(F.col("shard") == now).select("layer", (F.col("start") + F.col("n_tokens")).alias("end"))
    if now == number:
        rest = rest.unionByName(ends)
    rest = rest.groupBy("layer").agg(F.max("end").alias("end"))
    state = spark.range(1).select(F.lit(now).cast("int").alias("shard"), F.lit(filled).cast("long").alias("bytes")) \
        .join(rest, F.lit(True), "left").select(*OPEN.names)
    log.put(epoch, index)
    opened.put(epoch, state)


def start_rotating_index(stream: DataFrame, cfg: RunConfig, d_model: int, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Index a captured run as it arrives; no vector is read. ``read_rotating_index`` gives the rows so far."""
    keys = capture_to_tokens(stream, cfg).select("layer", "prompt_id", "completion_idx")

    def per_batch(df: DataFrame, epoch: int) -> None:
        seqs = df.groupBy("layer", "prompt_id", "completion_idx").agg(F.count(F.lit(1)).cast("int").alias("n_tokens"))
        rotate_batch(df.sparkSession, seqs, int(epoch), cfg, d_model, path)

    w = keys.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def read_rotating_index(spark: SparkSession, path: str) -> DataFrame:
    """Index rows of all appends: shard (its folder's name), layer, prompt_id, completion_idx, start, n_tokens, epoch."""
    rows = EpochLog(spark, f"{path.rstrip('/')}/index", _no_merge).read()
    return rows.withColumn("shard", F.format_string(SHARD_DIR, F.col("shard")))
