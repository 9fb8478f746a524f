"""What the driver is asked to hold: jobs of a filter and of a search, plans of the components."""

import random
import uuid

import numpy as np
import pytest

from actlake.llm import bloom, common, decontaminate as D


@pytest.fixture()
def many_partitions(spark):
    """Forty shuffle partitions that stay forty, as on a table dealt over many."""
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def _jobs(spark, run):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.sparkContext.setLocalProperty("spark.job.description", None)


def test_filter_comes_in_few_jobs(spark, many_partitions):
    rows = spark.range(3000).selectExpr("xxhash64(id % 2000) as h")
    filt, jobs = _jobs(spark, lambda: bloom.repeat_filter(rows, 3000))
    asked = np.array([r["h"] for r in spark.range(2000).selectExpr("xxhash64(id) as h").collect()], np.int64).view(np.uint64)
    got = filt.maybe_repeated(asked)
    assert got[:1000].all() and got[1000:].sum() < 20
    assert 0 < jobs < 10


def test_filter_of_several_jobs(spark, monkeypatch):
    monkeypatch.setattr(bloom, "JOB_BITS", bloom.SLICE_BITS)
    rows = spark.range(300_000).selectExpr("xxhash64(id % 250000) as h")
    filt = bloom.repeat_filter(rows, 300_000)
    asked = np.array([r["h"] for r in spark.range(250_000).selectExpr("xxhash64(id) as h").collect()], np.int64).view(np.uint64)
    got = filt.maybe_repeated(asked)
    assert filt.n_bits > 4 * bloom.SLICE_BITS and got[:50_000].all() and got[50_000:].mean() < 0.05


def test_items_come_in_one_job(spark, many_partitions):
    items = spark.createDataFrame([(i, f"what is number {i}", f"it is {i}") for i in range(100)], "item_id long, question string, answer string")
    docs = spark.createDataFrame([(1, "so what is number 7 then it is 7"), (2, "none"), (3, None)], "doc_id long, text string")
    _, jobs = _jobs(spark, lambda: D.find_leaks(docs, items))
    assert 0 < jobs < 8


def test_components_plan_stays_small(spark, monkeypatch):
    plans = []
    real = common.written
    monkeypatch.setattr(common, "written", lambda df, name: [plans.append(df._jdf.queryExecution().sparkPlan().toString()), real(df, name)][1])
    rng = random.Random(3)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    got = {r["node"]: r["comp"] for r in common.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    up = {x: x for ab in links for x in ab}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: top(x) for x in linked}
    assert len(plans) > 1 and max(p.count("FileScan") for p in plans[1:]) <= 4
