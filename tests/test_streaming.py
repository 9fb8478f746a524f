"""Streaming ingest equals the batch job; a restart adds nothing."""

import os

from pyspark.sql import functions as F

from actlake.catalog.q_io import STREAM_CFG, capture_rows
from actlake.functions.codec import decode_activations
from actlake.streaming.ingest import (capture_stream, capture_to_activations, drain, read_manifest_updates,
                                      start_ingest, start_manifest_updates)

from .conftest import SF


def _rows(df):
    x = decode_activations(df).select("layer", "prompt_id", "completion_idx", "token_pos", "vec")
    return sorted((r.layer, r.prompt_id, r.completion_idx, r.token_pos, tuple(r.vec)) for r in x.collect())


def test_stream_equals_batch_and_restart_is_idempotent(spark, tmpdir_fresh):
    src, out, ck = (os.path.join(tmpdir_fresh, n) for n in ("src", "out", "ck"))
    capture_rows(spark, SF).repartition(3).write.parquet(src)
    batch = capture_to_activations(spark.read.parquet(src), STREAM_CFG)
    q = start_ingest(capture_stream(spark, src, max_files_per_trigger=1), STREAM_CFG, out, ck)
    drain(q, 300)
    first = _rows(spark.read.parquet(out))
    assert first == _rows(batch) and len(first) > 0
    q2 = start_ingest(capture_stream(spark, src, max_files_per_trigger=1), STREAM_CFG, out, ck)
    drain(q2, 300)
    assert _rows(spark.read.parquet(out)) == first


def test_incremental_manifest(spark, tmpdir_fresh):
    src, out, ck = (os.path.join(tmpdir_fresh, n) for n in ("src", "man", "ck"))
    capture_rows(spark, SF).repartition(2).write.parquet(src)
    q = start_manifest_updates(capture_stream(spark, src, max_files_per_trigger=1), STREAM_CFG, out, ck)
    drain(q, 300)
    got = {(r.run_id, r.layer): r.total_tokens for r in read_manifest_updates(spark, out).collect()}
    expect = capture_to_activations(spark.read.parquet(src), STREAM_CFG).groupBy("run_id", "layer").count()
    assert got == {(r.run_id, r.layer): r["count"] for r in expect.collect()}


def test_failure_surfaces(spark, tmpdir_fresh):
    import pytest
    from actlake.config import RunConfig
    src, out, ck = (os.path.join(tmpdir_fresh, n) for n in ("src", "out", "ck"))
    capture_rows(spark, SF).write.parquet(src)
    bad = RunConfig(run_id="x", layers=(16,), dtype="bfloat16")
    stream = capture_stream(spark, src).withColumn("vec", F.when(F.col("flat_pos") >= 0,
                                                                  F.raise_error(F.lit("boom"))))
    q = start_ingest(stream.where(F.col("layer") == 16), bad, out, ck)
    with pytest.raises(Exception):
        drain(q, 300)
