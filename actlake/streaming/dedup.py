"""Replica duplicates in the stream (R7): each token key once per run, with state that ends with the run.

Every data-parallel replica may capture the same request, so a run's stream holds copies of a token key. A stateful
operator remembers, per sequence of a run, which token positions have passed: one bit each, in a RocksDB state store that keeps
its cold sequences on disk. Sequences are grouped into a fixed number of buckets of their run. A run has no
event time, so nothing can expire; it has an end: a marker row that its writer adds when all replicas have finished
(``mark_run_end``). The marker is sent to every bucket of the run, and each bucket drops all it remembers.

The first copy to arrive stays; of those that arrive together the one of the lowest replica. Rows whose request id could not
be parsed share a fallback key and are told apart by batch, as in ``sinks.tables.first_replica``: all of them pass and none is remembered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import GuardError, RunConfig
from ..sources.shards import CAPTURE_SCHEMA
from .ingest import capture_to_activations, stream_writer

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The flat position of a run's end marker.
END_MARK = -1
#: Buckets of a run; fixed for the life of a checkpoint. A bucket is one task's work in a trigger.
BUCKETS = 256

SEQUENCE = T.StructType([T.StructField("layer", T.IntegerType()), T.StructField("prompt_id", T.LongType()),
                         T.StructField("completion_idx", T.IntegerType())])
POSITIONS = T.StructType([T.StructField("bits", T.BinaryType())])


def mark_run_end(spark: SparkSession, path: str) -> None:
    """Add the end marker to a run's captured files. All replicas must have written what they have."""
    end = spark.createDataFrame([(None,) * len(CAPTURE_SCHEMA)], CAPTURE_SCHEMA).withColumn("flat_pos", F.lit(END_MARK))
    end.coalesce(1).write.mode("append").parquet(path)


class FirstCopies(StatefulProcessor):
    """Rows of one bucket of a run: what has not passed before goes on."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("positions", SEQUENCE, POSITIONS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ended = False
        for part in rows:
            ended |= bool(part["run_end"].any())
            part = part[~part["run_end"]].drop(columns=["run_end", "bucket"])
            if len(part):
                yield self._fresh(part)
        if ended and self.seen.exists():
            self.seen.clear()

    def _fresh(self, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["dp_rank", "batch_id"], kind="stable")
        keep = np.ones(len(part), bool)
        parsed = np.flatnonzero((part["prompt_id"] >= 0).to_numpy())
        for sequence, at in part.iloc[parsed].groupby(list(SEQUENCE.names), sort=False).indices.items():
            at = parsed[at]
            pos = part["token_pos"].to_numpy()[at].astype(np.int64)
            key = tuple(int(x) for x in sequence)
            old = self.seen.getValue(key)  # None for a sequence that is new
            bits = np.unpackbits(np.frombuffer(bytes(old[0]), np.uint8)) if old else np.zeros(0, np.uint8)
            if len(bits) <= pos.max():
                bits = np.append(bits, np.zeros((int(pos.max()) // 8 + 1) * 8 - len(bits), np.uint8))
            first = np.zeros(len(pos), bool)
            first[np.unique(pos, return_index=True)[1]] = True
            fresh = first & (bits[pos] == 0)
            keep[at] = fresh
            if fresh.any():
                bits[pos] = 1
                self.seen.updateValue(key, (np.packbits(bits).tobytes(),))
        return part[keep]

    def close(self) -> None:
        pass


def first_copies(acts: DataFrame, ends: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """R7 on a stream of activation rows: one row of each token key of a run; order is lost.

    ``ends``: (run_id), one row for each run that has ended; its state is dropped after the rows of the same trigger. Rows of
    a run that come after its end are a new run's: nothing is left to compare them with. A position or layer must not be null.
    """
    if buckets < 1:
        raise GuardError(f"buckets must be at least 1, got {buckets}")
    unparsed = F.when(F.col("prompt_id") < 0, F.col("batch_id"))
    bucket = F.pmod(F.xxhash64("layer", "prompt_id", "completion_idx", unparsed), F.lit(buckets)).cast("int")
    rows = acts.withColumn("bucket", bucket).withColumn("run_end", F.lit(False))
    to_all = ends.select("run_id", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in acts.schema if f.name != "run_id"]
    marks = to_all.select("run_id", *blank, "bucket", F.lit(True).alias("run_end")).select(*rows.columns)
    return (rows.unionByName(marks).groupBy("run_id", "bucket")
            .transformWithStateInPandas(FirstCopies(), T.StructType(acts.schema.fields), "append", "none"))


def start_dedup_ingest(stream: DataFrame, cfg: RunConfig, out_path: str, checkpoint: str, available_now: bool = True,
                       processing_time: str | None = None, d_model: int | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """``ingest.start_ingest`` with each token key stored once (R7): captured rows of all replicas and the run's end marker.

    State is held in RocksDB and, with the checkpoint, survives a restart: copies that come after it are still known.
    """
    acts = capture_to_activations(stream, cfg, d_model)
    ends = stream.where(F.col("flat_pos") == END_MARK).select(F.lit(cfg.run_id).alias("run_id"))
    spark = stream.sparkSession
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)  # a query keeps the setting that it is started with
    try:
        return stream_writer(first_copies(acts, ends, buckets), checkpoint, available_now, processing_time).start(out_path)
    finally:
        spark.conf.set(STATE_STORE, before)


def state_rows(q: StreamingQuery) -> int:
    """Sequences that the query's state holds after its last trigger."""
    last = q.lastProgress
    return sum(int(op["numRowsTotal"]) for op in last["stateOperators"]) if last else 0
