"""Document-scale queries: what is shuffled and what lies on disk."""

import os
import re

import pytest

from pyspark.sql import functions as F

from actlake.catalog import q_docs as Q
from actlake.operators import demux as D
from actlake.session import _scratch_root, local_path
from actlake.sources import fixtures as fx


def _tables(spark, path):
    docs = [(i, "a b  c " * (i % 5), "en", "s", 0) for i in range(40)] + [(7, "d e", "en", "s", 0), (9, None, "en", "s", 0), (None, "f", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, [float(i), 1.0], 0) for i in range(30)], "vec_id long, embedding array<float>, label int") \
        .write.parquet(f"{path}/embeddings.parquet")


def test_capture_shuffles_no_token(spark, tmpdir_fresh):
    _tables(spark, tmpdir_fresh)
    conf = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(conf)
    spark.conf.set(conf, "16")  # neither table is small
    try:
        toks, meta = fx.doc_capture(spark, tmpdir_fresh)
        x = D.demux(toks, meta, tp_size=1)
        plan = x._jdf.queryExecution().executedPlan().toString()
        got = {r["prompt_id"]: (r["n"], r["last"]) for r in x.groupBy("prompt_id").agg(F.count("*").alias("n"), F.max("token_pos").alias("last")).collect()}
    finally:
        spark.conf.set(conf, old)
    lines = plan.split("\n")
    at = next(i for i, line in enumerate(lines) if "Generate explode(sequence" in line)
    assert "SortMergeJoin [batch_id" in plan
    depth = [re.search(r"[A-Z]", line).start() if re.search(r"[A-Z]", line) else 0 for line in lines]
    above, low = [], depth[at]
    for i in range(at - 1, -1, -1):  # the nodes over the one that makes the token rows
        if depth[i] < low:
            above.append(lines[i])
            low = depth[i]
    assert any("BroadcastHashJoin [vec_id" in line for line in above) and not any("Exchange" in line for line in above)
    want = {i: (3 * (i % 5), 3 * (i % 5) - 1) for i in range(40) if i % 5 and i // 4 not in (1, 2)}
    assert {k: v for k, v in got.items() if k // 4 not in (1, 2)} == want
    assert not any(k // 4 == 2 for k in got)  # a length is missing: the batch is dropped
    assert got[7][0] in (12, 16)  # two documents of one id in either order: the tokens of each at the offsets of both, up to the batch end


def _compared(spark, path, monkeypatch, slice_bytes):
    """The metrics, and for each written run the bytes of stored payloads that were on disk after it."""
    seen, write = [], Q.write_activations_bucketed

    def spy(acts, name, *args, **kw):
        assert "payload" in acts.columns and not any("Exchange" in x and "payload" in x for x in acts._jdf.queryExecution().executedPlan().toString().split("\n"))
        write(acts, name, *args, **kw)
        alive = [t.name for t in spark.catalog.listTables() if t.name.startswith("doc_")]
        seen.append(sum(spark.table(t).agg(F.coalesce(F.sum(F.octet_length("payload")), F.lit(0))).first()[0] for t in alive))

    monkeypatch.setattr(Q, "SLICE_BYTES", slice_bytes, raising=False)
    monkeypatch.setattr(Q, "write_activations_bucketed", spy)
    rows = sorted(map(tuple, Q.q_doc_compare_metrics(spark, path).collect()))
    monkeypatch.undo()
    return rows, seen


def test_compared_runs_are_stored_in_slices(spark, tmpdir_fresh, monkeypatch):
    docs = [(i, "a b  c " * (5 + i % 5), "en", "s", 0) for i in range(60)] + [(60, None, "en", "s", 0), (61, "", "en", "s", 0), (None, "x y", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmpdir_fresh}/documents.parquet")
    spark.createDataFrame([(i, [float(i) + 0.3, 1.7 * i, -1.0], 0) for i in range(30)], "vec_id long, embedding array<float>, label int") \
        .write.parquet(f"{tmpdir_fresh}/embeddings.parquet")
    old = {t.name for t in spark.catalog.listTables()}
    rows, seen = _compared(spark, tmpdir_fresh, monkeypatch, 3000)
    payload = sum(3 * (5 + i % 5) for i in range(60)) * 3 * 3  # three words a repeat, three elements, two bytes and one
    assert max(seen) < payload / 2 and len(seen) > 4
    assert sum(seen[1::2]) == payload  # after the second run of a slice both are there: every token of each is stored once
    assert {t.name for t in spark.catalog.listTables()} == old
    left = [f for d, _, files in os.walk(local_path(_scratch_root(spark))) for f in files if "doc-slice" in d or "doc_bf16" in d]
    assert not left
    whole, once = _compared(spark, tmpdir_fresh, monkeypatch, 1 << 30)
    assert len(once) == 2 and rows == whole and [r[1] for r in rows] == list(range(60)) and rows[7][3] == 21


def test_scratch_scope_ends_with_an_error(spark):
    from actlake.session import exists, scratch_path, scratch_scope
    with pytest.raises(ValueError), scratch_scope(spark, "outer"):
        kept = scratch_path(spark, "t")
        spark.range(3).write.parquet(kept)
        raise ValueError
    after = scratch_path(spark, "t")
    assert not exists(spark, kept) and "outer" in kept and "outer" not in after


def test_vectors_come_in_pieces(spark, tmpdir_fresh, monkeypatch):
    _tables(spark, tmpdir_fresh)
    whole, meta = fx.doc_capture(spark, tmpdir_fresh)
    want = sorted(map(tuple, whole.where("batch_id > 2").collect()))
    monkeypatch.setattr(fx, "VEC_BROADCAST", 100, raising=False)
    monkeypatch.setattr(fx, "VEC_PIECE", 300, raising=False)  # 30 vectors of two elements: 720 bytes
    conf = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(conf)
    spark.conf.set(conf, "16")
    try:
        toks, meta = fx.doc_capture(spark, tmpdir_fresh)
        x = D.demux(toks, meta, tp_size=1)
        plan = x._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, toks.where("batch_id > 2").collect()))
        runs = fx.doc_tokens(spark, tmpdir_fresh)
        dealt = runs.groupBy("prompt_id").count()._jdf.queryExecution().executedPlan().toString()
        n_runs = runs.count()
    finally:
        spark.conf.set(conf, old)
    assert got == want and len(got) == 3 * sum(i % 5 for i in range(12, 40)) and n_runs == 3 * sum(i % 5 for i in range(40)) + 2
    for p, least in ((plan, 3), (dealt, 3)):
        assert p.count("BroadcastHashJoin [vec_id") >= least and "SortMergeJoin [vec_id" not in p
        assert not [line for line in p.split("\n") if "Exchange hashpartitioning" in line and "REPARTITION_BY_NUM" not in line], p
    assert "Union" in plan and "SortMergeJoin [batch_id" in plan
