"""Replica duplicates in the stream: every token key once per run, across triggers and restarts, and state that ends with the run."""

import os

import pytest
from pyspark.sql import functions as F

from actlake.catalog.q_io import CAPTURE_LAYER, capture_rows
from actlake.config import GuardError, RunConfig
from actlake.streaming.dedup import first_copies, mark_run_end, start_dedup_ingest, state_rows
from actlake.streaming.ingest import capture_stream, capture_to_activations, drain, start_ingest

from .conftest import SF

CFG = RunConfig(run_id="r", layers=(CAPTURE_LAYER,), tp_size=1)


def _keys(df):
    return sorted((r.prompt_id, r.completion_idx, r.token_pos, r.batch_id if r.prompt_id < 0 else None, r.dp_rank)
                  for r in df.select("prompt_id", "completion_idx", "token_pos", "batch_id", "dp_rank").collect())


def test_copies_pass_once_over_triggers_and_restarts(spark, tmpdir_fresh):
    src, out, ck = (os.path.join(tmpdir_fresh, n) for n in ("src", "out", "ck"))
    rows = capture_rows(spark, SF).cache()
    for replica in (0, 1, 2):
        rows.withColumn("gpu_id", F.lit(replica).cast("long")).repartition(3).write.mode("append").parquet(src)
        q = start_dedup_ingest(capture_stream(spark, src, 1), CFG, out, ck, d_model=64, buckets=5)
        drain(q, 600)
        assert state_rows(q) > 0
    all_copies = capture_to_activations(spark.read.parquet(src), CFG)
    got = _keys(spark.read.parquet(out))
    parsed = [k[:3] for k in got if k[0] >= 0]
    assert len(parsed) == len(set(parsed)) > 0
    assert set(parsed) == {k[:3] for k in _keys(all_copies.where("prompt_id >= 0"))}
    assert {k[4] for k in got if k[0] >= 0} == {0}  # the first to arrive
    assert sum(k[0] < 0 for k in got) == all_copies.where("prompt_id < 0").count() > 0
    # the end marker changes no row and leaves no state; the plain stream and the batch job pass over it
    mark_run_end(spark, src)
    q = start_dedup_ingest(capture_stream(spark, src, 1), CFG, out, ck, d_model=64, buckets=5)
    drain(q, 600)
    assert state_rows(q) == 0 and _keys(spark.read.parquet(out)) == got
    assert capture_to_activations(spark.read.parquet(src), CFG).count() == all_copies.count()
    # a run that starts after the end is a new one
    rows.repartition(1).write.mode("append").parquet(src)
    q = start_dedup_ingest(capture_stream(spark, src, 1), CFG, out, ck, d_model=64, buckets=5)
    drain(q, 600)
    assert state_rows(q) > 0 and len(_keys(spark.read.parquet(out))) > len(got)


def test_one_trigger_keeps_the_lowest_replica_and_drops_state_at_once(spark, tmpdir_fresh):
    src, out, ck = (os.path.join(tmpdir_fresh, n) for n in ("src", "out", "ck"))
    rows = capture_rows(spark, SF)
    both = rows.withColumn("gpu_id", F.lit(3).cast("long")).unionByName(rows.withColumn("gpu_id", F.lit(1).cast("long")))
    both.coalesce(1).write.parquet(src)
    mark_run_end(spark, src)
    q = start_dedup_ingest(capture_stream(spark, src, None), CFG, out, ck, buckets=2)
    drain(q, 600)
    got = _keys(spark.read.parquet(out).where("prompt_id >= 0"))
    assert {k[4] for k in got} == {1} and len({k[:3] for k in got}) == len(got) > 0
    assert state_rows(q) == 0


def test_the_state_store_setting_is_the_sessions_again(spark, tmpdir_fresh):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    src, out, ck = (os.path.join(tmpdir_fresh, n) for n in ("src", "out", "ck"))
    capture_rows(spark, SF).limit(5).coalesce(1).write.parquet(src)
    drain(start_dedup_ingest(capture_stream(spark, src), CFG, out, ck, buckets=1), 600)
    assert spark.conf.get(key) == before
    with pytest.raises(GuardError):
        first_copies(capture_to_activations(spark.read.parquet(src), CFG), spark.createDataFrame([], "run_id string"), 0)


def test_plain_stream_ignores_the_marker(spark, tmpdir_fresh):
    src, out, ck = (os.path.join(tmpdir_fresh, n) for n in ("src", "out", "ck"))
    capture_rows(spark, SF).coalesce(1).write.parquet(src)
    n = capture_to_activations(spark.read.parquet(src), CFG).count()
    mark_run_end(spark, src)
    drain(start_ingest(capture_stream(spark, src, 1), CFG, out, ck), 600)
    assert spark.read.parquet(out).count() == n
