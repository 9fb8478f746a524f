"""The log of triggers stays short and counts each epoch once; rotation while a run arrives equals the single writer's."""

import os
import random

import pytest
from pyspark.sql import functions as F

from actlake.config import RunConfig
from actlake.operators.layout import assign_shards, rotate_shards
from actlake.streaming.epochlog import EpochLog
from actlake.streaming.ingest import sequence_counts
from actlake.streaming.rotate import OpenShard, read_rotating_index, rotate_batch


def _sums(rows):
    return rows.groupBy("k").agg(F.sum("n").alias("n"))


def _rows(spark, epoch):
    return spark.createDataFrame([(k, 1 << epoch % 20) for k in ("a", "b")[:1 + epoch % 2]], "k string, n long")


def test_every_epoch_counts_once_whatever_dies(spark, tmpdir_fresh, monkeypatch):
    log = EpochLog(spark, os.path.join(tmpdir_fresh, "log"), _sums, fan=3)
    with pytest.raises(FileNotFoundError):
        log.read()
    want = {"a": 0, "b": 0}
    for epoch in range(14):
        for k in ("a", "b")[:1 + epoch % 2]:
            want[k] += 1 << epoch % 20
        if epoch == 8:  # dies after the epoch's table, before the merge
            with monkeypatch.context() as m:
                add = EpochLog._add
                m.setattr(EpochLog, "_add", lambda self, rows, a, z: add(self, rows, a, z) if a == z else (_ for _ in ()).throw(OSError()))
                with pytest.raises(OSError):
                    log.put(epoch, _rows(spark, epoch))
        assert log.put(epoch, _rows(spark, epoch)) == (epoch != 8)
        assert not log.put(epoch, _rows(spark, epoch))  # a replay
        if epoch in (0, 5, 8, 13):
            assert {r.k: r.n for r in log.read().collect()} == {k: n for k, n in want.items() if n}
    assert not log.put(3, _rows(spark, 3))
    assert [(a, z) for a, z, _ in log.tables()] == [(0, 8), (9, 11), (12, 12), (13, 13)]
    assert len(log.read().inputFiles()) == 4
    with pytest.raises(ValueError):
        EpochLog(spark, "x", _sums, fan=1)


def test_a_thousand_epochs_are_few_tables(spark, tmpdir_fresh, monkeypatch):
    """The tables' names alone: folders stand for tables."""
    monkeypatch.setattr(EpochLog, "_add", lambda self, rows, a, z: os.makedirs(f"{self.path}/epochs-{a:010d}-{z:010d}", exist_ok=True))
    log = EpochLog(spark, os.path.join(tmpdir_fresh, "log"), lambda rows: rows)
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *p: None)
    most = 0
    for epoch in range(1000):
        log.put(epoch, None)
        found = [(a, z) for a, z, _ in log.tables()]
        assert found[0][0] == 0 and found[-1][1] == epoch and all(y[0] == x[1] + 1 for x, y in zip(found, found[1:]))
        most = max(most, len(found))
    assert most <= 20


def test_sequences_that_come_in_parts_are_one(spark):
    rows = spark.createDataFrame([("r", 1, 5, 0, 1), ("r", 1, 5, 0, 2), ("r", 2, 5, 0, 4)], "run_id string, layer int, prompt_id long, completion_idx int, tokens long")
    assert sorted(tuple(r) for r in sequence_counts(rows).collect()) == [("r", 1, 5, 0, 3), ("r", 2, 5, 0, 4)]


def _walk(sizes, limit, shard=0, held=0):
    out = []
    for n in sizes:
        if held >= limit:
            shard, held = shard + 1, 0
        out.append(shard)
        held += n
    return out, (shard, held) if held < limit or not sizes else (shard, held)


@pytest.mark.parametrize("seed,buckets", [(1, None), (2, 1), (3, 7), (4, 30)])
def test_rotation_from_any_open_shard(spark, seed, buckets):
    rnd = random.Random(seed)
    limit = rnd.choice([5, 20, 100])
    start = rnd.choice([0, 3, limit, limit + 9])
    sizes = {run: [rnd.choice([0, 1, 3, 7, 40]) for _ in range(n)] for run, n in (("a", 200), ("b", 1), ("c", 37))}
    rows = [(run, i, n) for run, s in sizes.items() for i, n in enumerate(s)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "run string, append_ord long, n_bytes long")
    out, end = rotate_shards(df, limit, "append_ord", ["run"], buckets, 7, start)
    got = {(r.run, r.append_ord): r.shard for r in out.collect()}
    ends = {r.run: (r._shard, r._carried) for r in end.collect()}
    for run, s in sizes.items():
        want, (shard, held) = _walk(s, limit, 7, start)
        assert [got[run, i] for i in range(len(s))] == want
        # a full shard is closed there or by the next sequence
        assert ends[run] in {(shard, held), (shard + 1, 0)} and (held < limit) <= (ends[run] == (shard, held))
    assert assign_shards(df.limit(0), limit, partition=("run",)).count() == 0


def test_appends_go_on_where_the_last_one_stopped(spark, tmpdir_fresh):
    cfg = RunConfig(run_id="r", layers=(3, 4), tp_size=1, shard_bytes=600, dtype="int8")
    rnd, path, token = random.Random(9), os.path.join(tmpdir_fresh, "roll"), 8 + 4
    shard = held = 0
    ends, want = {}, set()
    for epoch in range(4):
        seqs = [(layer, p, 0, rnd.randint(0, 9)) for p in range(epoch * 10, epoch * 10 + (0 if epoch == 2 else 7)) for layer in (3, 4)]
        df = spark.createDataFrame(seqs, "layer int, prompt_id long, completion_idx int, n_tokens int")
        for _ in range(1 + (epoch == 1)):  # one trigger is replayed
            rotate_batch(spark, df, epoch, cfg, 8, path)
        for p in sorted({s[1] for s in seqs}):
            if held >= cfg.shard_bytes:
                shard, held = shard + 1, 0
            for layer, q, c, n in seqs:
                if q == p:
                    at = ends.get((shard, layer), 0)
                    want.add((f"shard_{shard:04d}", layer, p, c, at, n, epoch))
                    ends[shard, layer] = at + n
                    held += n * token
    got = {tuple(r) for r in read_rotating_index(spark, path).select("shard", "layer", "prompt_id", "completion_idx", "start", "n_tokens", "epoch").collect()}
    assert got == want and shard >= 2
    assert sorted(OpenShard(spark, path)._epochs()) == [2, 3]
