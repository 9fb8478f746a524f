"""Plan shape: no nested-loop or Cartesian joins; pushdown; native vector maths."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from actlake.catalog import QUERIES
from actlake.functions.codec import encode_activations
from actlake.sinks.tables import write_activations
from actlake.sources import fixtures as fx
from actlake.sources.shards import read_sequence

from .conftest import SF

WRITES = {"stream_ingest", "legacy_roundtrip", "doc_compare_metrics"}
JOBS = {n for n, e in QUERIES.items() if e.build.__module__.endswith(".q_jobs")}


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITES - JOBS))
def test_no_nested_loop_or_cartesian(spark, name):
    p = plan_text(E.queries()[name](spark, SF))
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p, p


@pytest.mark.parametrize("name", ["run_diff", "steer_apply", "quant_int8", "arch_residual", "zero_ranges",
                                  "demux_vectors", "plan", "layer_filter"])
def test_vector_maths_stays_native(spark, name):
    p = plan_text(E.queries()[name](spark, SF))
    for node in ("ArrowEvalPython", "BatchEvalPython", "MapInArrow", "MapInPandas", "FlatMapGroupsInPandas"):
        assert node not in p, (node, p)


def test_point_lookup_prunes_partitions_and_pushes_filters(spark, tmpdir_fresh):
    path = os.path.join(tmpdir_fresh, "acts")
    acts = encode_activations(fx.vectors(spark, SF), "bfloat16")
    write_activations(acts, path, 64, 2, mode="overwrite", n_partitions=4)
    stored = spark.read.parquet(path)
    x = read_sequence(stored, "base", 32, 3, 0, strict=True)
    p = plan_text(x)
    assert "PartitionFilters: [isnotnull(run_id" in p and "layer" in p.split("PartitionFilters:")[1].split("]")[0]
    assert "PushedFilters: [IsNotNull(prompt_id), IsNotNull(completion_idx), EqualTo(prompt_id,3)" in p, p
    rows = x.collect()
    assert [r.token_pos for r in rows] == sorted(r.token_pos for r in rows) and len(rows) > 0
    with pytest.raises(KeyError):
        read_sequence(stored, "base", 32, 10 ** 9, 0, strict=True)


def test_demux_join_is_broadcast_after_size_check(spark):
    p = plan_text(E.queries()["demux_vectors"](spark, SF))
    assert "BroadcastHashJoin" in p


def _nodes(plan):
    yield plan
    it = plan.children().iterator()
    while it.hasNext():
        yield from _nodes(it.next())


def _output_names(node):
    it = node.output().iterator()
    out = []
    while it.hasNext():
        out.append(it.next().name())
    return out


def test_bucketed_runs_compare_without_shuffling_payloads(spark):
    from actlake.operators import compare as C
    from actlake.session import scratch_path
    from actlake.sinks.tables import write_activations_bucketed
    acts = encode_activations(fx.vectors(spark, SF), "bfloat16")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # buckets = shuffle partitions
    write_activations_bucketed(acts, "acts_bucketed_t", n, path=scratch_path(spark, "acts_bucketed_t"))
    t = spark.table("acts_bucketed_t")
    a, b = C.run_slice(t, "base", completion_idx=0), C.run_slice(t, "variant", completion_idx=0)
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        m = C.pair_metrics(C.token_pairs(a, b))
        plan = m._jdf.queryExecution().executedPlan()
        moved = [n.nodeName() for n in _nodes(plan)
                 if "Exchange" in n.nodeName() and any("payload" in c for c in _output_names(n))]
        assert moved == [], moved
        assert m.count() > 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_a_lookup_in_buckets_opens_its_file_alone(spark, tmpdir_fresh):
    from actlake.config import GuardError
    from actlake.sinks.tables import buckets_for, read_layout
    from actlake.sources.shards import lookup_sequence, lookup_sequences
    path = os.path.join(tmpdir_fresh, "acts")
    v = spark.range(400).select(F.explode(F.array(*(F.lit(x) for x in ("base", "other run/x")))).alias("run_id"), F.col("id").alias("prompt_id"))
    v = v.select("run_id", F.lit(16).alias("layer"), "prompt_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("completion_idx"))
    v = v.select("*", F.explode(F.sequence(F.lit(0), (F.col("prompt_id") % 3).cast("int"))).alias("token_pos"))
    acts = encode_activations(v.withColumn("vec", F.array_repeat(F.col("prompt_id").cast("float"), 4)), "bfloat16").cache()
    write_activations(acts, path, 4, 2, mode="overwrite", validate=False, buckets=100)
    stored = spark.read.parquet(path)
    assert len(stored.inputFiles()) == 200 and stored.count() == acts.count()
    for run in ("base", "other run/x"):
        x = lookup_sequence(spark, path, run, 16, 77, 1)
        assert len(x.inputFiles()) == 1 and [r.token_pos for r in x.collect()] == [0, 1, 2]
        keys = [(5, 0), (5, 1), (399, 0), (1000, 0)]
        some = lookup_sequences(spark, path, run, 16, keys)
        assert len(some.inputFiles()) <= 4
        assert sorted((r.prompt_id, r.completion_idx, r.token_pos) for r in some.collect()) == [(5, c, t) for c in (0, 1) for t in range(3)] + [(399, 0, 0)]
        assert read_sequence(stored, run, 16, 77, 1).count() == 3
    # a second write goes to the same buckets; another layout is an error; what is absent is told
    write_activations(acts.where("run_id = 'base'").withColumn("layer", F.lit(7)), path, 4, 2, validate=False, buckets=100)
    assert lookup_sequence(spark, path, "base", 7, 77, 1).count() == 3
    with pytest.raises(GuardError, match="100 buckets"):
        write_activations(acts, path, 4, 2, validate=False, buckets=50)
    with pytest.raises(GuardError, match="not laid out"):
        read_layout(spark, os.path.join(tmpdir_fresh, "none"))
    for key in ((5000, 0), (5, 7)):
        with pytest.raises(KeyError):
            lookup_sequence(spark, path, "base", 16, *key)
        assert lookup_sequence(spark, path, "base", 16, *key, strict=False).count() == 0
    assert lookup_sequences(spark, path, "none", 16, [(1, 0)]).count() == 0
    assert buckets_for(10 << 40, 5) == 4096 and buckets_for(0, 0) == 1
