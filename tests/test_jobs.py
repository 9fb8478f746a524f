"""End to end: files -> plan; capture -> two stored runs; verify; compare."""

import json
import os

from pyspark.sql import functions as F

from actlake.catalog.q_io import capture_rows
from actlake.config import RunConfig
from actlake.plans.jobs import compare_job, ingest_job, plan_job, verify_job
from actlake.sources import fixtures as fx

from .conftest import SF


def test_reference_workflow(spark, tmpdir_fresh):
    # prompt and completion files written from the conversations table
    pf = os.path.join(tmpdir_fresh, "prompts.jsonl")
    cf = os.path.join(tmpdir_fresh, "completions.jsonl")
    with open(pf, "w") as f:
        for r in fx.prompts(spark, SF).collect():
            f.write(json.dumps({"id": r.prompt_id, "prompt": r.prompt, "extra": 1}) + "\n")
    with open(cf, "w") as f:
        for r in fx.completions(spark, SF).collect():
            f.write(json.dumps({"prompt_id": r.prompt_id, "completion_idx": r.completion_idx, "text": r.text}) + "\n")
    cfg = RunConfig(model="m", layers=(16,), max_tokens=128, min_tokens=4, run_id="bf16")
    out = os.path.join(tmpdir_fresh, "run")
    summary = plan_job(spark, [pf], [cf], cfg, out)
    n_plan = spark.read.json(f"{out}/plan").count()
    assert summary["n_pairs"] >= n_plan > 0 and summary["total_tokens"] > 0

    cap = os.path.join(tmpdir_fresh, "capture")
    capture_rows(spark, SF).repartition(2).write.parquet(cap)
    ingest_job(spark, cap, cfg, out, d_model=64)
    ingest_job(spark, cap, RunConfig(model="m", layers=(16,), dtype="float8_e4m3", run_id="fp8"), out,
               d_model=64, stream=True, checkpoint=os.path.join(tmpdir_fresh, "ck"))
    from actlake.sources.shards import read_runs
    acts = read_runs(spark, f"{out}/activations")
    assert {r.run_id for r in acts.select("run_id").distinct().collect()} == {"bf16", "fp8"}
    index = spark.read.parquet(f"{out}/index")
    man = spark.read.json(f"{out}/manifest")
    assert man.count() == 2

    v = verify_job(spark, acts, 64, index=index.withColumn("run_id", F.col("run_id")))
    assert {r.status for r in v["reconcile"].collect()} == {"ok"}
    assert all(r.n_bad_length == 0 for r in v["payloads"].collect())
    assert v["norms"].count() == 2 * 3

    c = compare_job(acts, "bf16", "fp8", layer=16)
    m = c["metrics"].collect()
    assert len(m) == c["keys"].count() > 0 and all(r.cos_min > 0.99 for r in m)
    assert "rid" in acts.columns and acts.where("prompt_id = -1").select("rid").distinct().count() >= 1
    assert c["positions"].count() > 0 and c["shift"].count() > 0 and c["drift"].count() > 0


def test_a_plan_runs_once_and_an_empty_one_is_refused(spark, tmpdir_fresh):
    """The tokenizer sees each sequence once: guard, plan file and summary come from one execution."""
    import json
    import os

    import pytest

    from actlake.config import GuardError, RunConfig
    from actlake.plans.jobs import plan_job
    seen = os.path.join(tmpdir_fresh, "seen")
    os.makedirs(seen)

    def factory():
        def tokens(texts):
            import uuid
            with open(os.path.join(seen, uuid.uuid4().hex), "w") as f:
                f.write("\n".join("x" for _ in texts))
            return [list(range(len(t.split()))) for t in texts]
        return tokens
    prompts, completions = (os.path.join(tmpdir_fresh, n) for n in ("p.jsonl", "c.jsonl"))
    with open(prompts, "w") as f, open(completions, "w") as g:
        for i in range(50):
            f.write(json.dumps({"id": i, "prompt": "a " * i}) + "\n")
            g.write(json.dumps({"prompt_id": i, "completion_idx": 0, "text": "b " * 5}) + "\n")
    cfg = RunConfig(max_tokens=30, min_tokens=8)
    got = plan_job(spark, [prompts], [completions], cfg, os.path.join(tmpdir_fresh, "out"), tokenizer=factory)
    assert sum(open(os.path.join(seen, f)).read().count("x") for f in os.listdir(seen)) == 50
    lines = spark.read.json(os.path.join(tmpdir_fresh, "out", "plan"))
    assert (got["n_pairs"], got["total_tokens"]) == (50, lines.agg({"n_tokens": "sum"}).first()[0])
    assert got["n_skipped"] == 50 - lines.count() and got["n_truncated"] > 0 and got["tok_per_s"] > 0
    with open(completions, "w") as g:
        g.write(json.dumps({"prompt_id": 1000, "completion_idx": 0, "text": "b"}) + "\n")
    with pytest.raises(GuardError, match="empty"):
        plan_job(spark, [prompts], [completions], cfg, os.path.join(tmpdir_fresh, "none"), tokenizer=factory)
    assert not os.path.exists(os.path.join(tmpdir_fresh, "none", "plan"))


def test_a_failed_stream_leaves_its_reason_in_the_summary(spark, tmpdir_fresh):
    import os

    import pytest

    from actlake.catalog.q_io import STREAM_CFG, capture_rows
    from actlake.streaming.ingest import capture_stream, start_ingest
    from actlake.streaming.report import drain_reported

    from .conftest import SF
    src, out = (os.path.join(tmpdir_fresh, n) for n in ("src", "out"))
    rows = capture_rows(spark, SF)
    rows.repartition(3).write.parquet(src)

    def start(width, name):
        return lambda: start_ingest(capture_stream(spark, src, 1), STREAM_CFG, os.path.join(out, name), os.path.join(out, "ck" + name), d_model=width)
    ok = drain_reported(spark, start(64, "a"), "a", os.path.join(out, "summary")).first()
    assert (ok.status, ok.reason, ok.n_triggers, ok.n_input_rows, ok.last_epoch) == ("ended", None, 3, rows.count(), 2)
    with pytest.raises(RuntimeError, match="elements instead of"):
        drain_reported(spark, start(63, "b"), "b", os.path.join(out, "summary"))
    kept = {r.run_id: r for r in spark.read.json(os.path.join(out, "summary")).collect()}
    assert kept["a"].status == "ended" and kept["b"].status == "failed" and "elements instead of" in kept["b"].reason
