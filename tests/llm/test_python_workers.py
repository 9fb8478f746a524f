"""What a task asks of its Python workers: their memory counts as the executor's."""

import os
import random
import subprocess
import sys

import numpy as np

from actlake.llm import bloom, lang_id as LI, ngram_join as NJ

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_language_needs_no_pandas(spark):
    code = "import sys, actlake.llm.lang_id; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=REPO, check=False).returncode == 0
    texts = ["kato mire solan", None, "", "12 34", "brough thwick ling", "kato " * 3000, "été brough"]
    model = {"xx": b"kato mire solan pu", "yy": b"brough thwick ling ster"}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in LI.predict(docs, model).collect()}
    comp = LI._compressors(model, LI.LEVEL)
    assert got == {i: LI.classify(t, comp) for i, t in enumerate(texts)}


def test_join_tasks_run_one_python_function(spark, monkeypatch):
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(6)]
    texts = [*base, base[0], base[1] + " end", base[2].upper(), None, ""]
    postings, filtered = [], []
    between, repeat_filter = NJ._between, NJ.repeat_filter
    monkeypatch.setattr(NJ, "_between", lambda rows, key, *a: [postings.append(_plan(rows)) if key == "token" else None, between(rows, key, *a)][1])
    monkeypatch.setattr(NJ, "repeat_filter", lambda rows, *a, **b: [filtered.append(_plan(rows)), repeat_filter(rows, *a, **b)][1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in NJ.jaccard_join(docs, 3, (90, 100)).collect()}
    assert got == {i: {6: 0, 7: 1, 8: 2}.get(i, i) for i in range(len(texts))}
    plan, = postings
    assert plan.count("ArrowEvalPython") == 1
    # what a filter is built of comes from a table or a cache, not from another Python function
    assert filtered and not any("EvalPython" in p for p in filtered if "InMemoryTableScan" not in p)


def test_filter_asks_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(bloom, "PIECE_HASHES", 7)
    h = [x * 0x9E3779B97F4A7C15 % 2**63 for x in range(1, 101)]
    rows = spark.createDataFrame([(x,) for x in [*h, *h[:40]]], "h long")
    filt = bloom.repeat_filter(rows, 140)
    for n in (0, 1, 7, 8, 100):
        asked = np.array(h[:n], np.uint64)
        assert list(filt.maybe_repeated(asked)[:40]) == [True] * min(n, 40)
        assert filt.maybe_repeated(asked)[40:].sum() <= 3


def test_filter_leaves_nothing_on_disk(spark):
    kept = spark.sparkContext._jsc.getPersistentRDDs
    before = set(kept())
    filt = bloom.repeat_filter(spark.range(500).selectExpr("id % 400 as h"), 500)
    assert filt.maybe_repeated(np.arange(100, dtype=np.uint64)).all()
    assert set(kept()) <= before
