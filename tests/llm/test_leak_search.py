"""What the search for benchmark leaks holds in a task, and what it shuffles."""

import random
import tracemalloc
from types import SimpleNamespace

import pyarrow as pa

import corpus_pipeline as CP
from actlake.llm import decontaminate as D


def test_search_holds_small_arrays():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(600)]
    items = [(i, " ".join(rng.choices(words, k=30)), " ".join(rng.choices(words, k=10))) for i in range(200)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(1200)]
    for i in range(0, 1200, 100):
        texts[i] += f" {items[i // 100][1]} {items[i // 100][2]}"
    batch = pa.RecordBatch.from_arrays([pa.array(range(1200), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    search = D._search(SimpleNamespace(value=D.build_index(items)), D.THRESHOLD, D.OVERLAP)
    tracemalloc.start()
    got = [(r["doc_id"], r["item_id"]) for b in search(iter([batch])) for r in b.to_pylist()]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x for x in got if x[0] % 100 == 0] == [(i, i // 100) for i in range(0, 1200, 100)]
    assert most < 40e6


def test_few_leaks_shuffle_no_text(spark, tmp_path):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(600)]
    items = [(i, " ".join(rng.choices(words, k=40))) for i in range(5)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [" ".join(rng.choices(words, k=100)) for _ in range(50)]
    texts[3] += " " + items[2][1]
    path = f"{tmp_path}/docs"
    spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in enumerate([*texts, None])],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2k")  # less than the texts
    try:
        kept = CP.decontaminate_benchmark(spark, spark.read.parquet(path), str(tmp_path))
        # the leaks are of known size: no sort-merge join, which shuffles the texts
        assert "SortMergeJoin" not in kept._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(51) if i != 3]
