import json
import os

import pytest
import zstandard as zstd

from actlake.operators.prompts import last_rollout, merge_prompts
from actlake.sources.jsonl import read_completions, read_prompts


def _write(path, lines, compress=False):
    data = "\n".join(lines).encode("utf-8")
    if compress:
        data = zstd.ZstdCompressor().compress(data)
    with open(path, "wb") as f:
        f.write(data)


def test_prompt_jsonl_rules(spark, tmpdir_fresh):
    p1 = os.path.join(tmpdir_fresh, "p1.jsonl")
    p2 = os.path.join(tmpdir_fresh, "p2.jsonl")
    _write(p1, [json.dumps({"id": 1, "prompt": "a", "extra": 5}), "", "   ", json.dumps({"id": 2, "prompt": "b"})])
    _write(p2, [json.dumps({"id": 1, "prompt": "a"})])
    df = read_prompts(spark, [p1, p2])
    rows = sorted((r.prompt_id, r.prompt, r.src_ord) for r in df.collect())
    assert rows == [(1, "a", 0), (1, "a", 1), (2, "b", 0)]
    assert sorted(r.prompt_id for r in merge_prompts(df).collect()) == [1, 2]


def test_malformed_line_fails(spark, tmpdir_fresh):
    p = os.path.join(tmpdir_fresh, "bad.jsonl")
    _write(p, [json.dumps({"id": 1, "prompt": "a"}), "{not json"])
    with pytest.raises(Exception):
        read_prompts(spark, [p]).collect()


def test_zstd_completions_last_wins(spark, tmpdir_fresh):
    c1 = os.path.join(tmpdir_fresh, "c1.jsonl.zst")
    c2 = os.path.join(tmpdir_fresh, "c2.jsonl.zst")
    rows1 = [json.dumps({"prompt_id": 1, "completion_idx": 0, "text": t}) for t in ("x", "y")]
    rows1.append(json.dumps({"prompt_id": 2, "completion_idx": 0, "text": "keep"}))
    _write(c1, rows1, compress=True)
    _write(c2, [json.dumps({"prompt_id": 1, "completion_idx": 0, "text": "z"}),
                json.dumps({"prompt_id": 1, "completion_idx": 1, "text": "other"})], compress=True)
    df = read_completions(spark, [c1, c2])
    got = {r.prompt_id: r.completion for r in last_rollout(df, 0).collect()}
    assert got == {1: "z", 2: "keep"}
    only_first = {r.prompt_id: r.completion for r in last_rollout(read_completions(spark, [c1]), 0).collect()}
    assert only_first == {1: "y", 2: "keep"}


def test_zstd_files_are_written_and_read_back(spark, tmpdir_fresh):
    from actlake.sinks.jsonl_zstd import write_jsonl_zstd
    rows = spark.range(1000).selectExpr("id as prompt_id", "cast(id % 3 as int) as completion_idx", "concat('t\u00e9xt \\n ', id) as text", "7 as more")
    path = os.path.join(tmpdir_fresh, "z z")
    write_jsonl_zstd(rows.repartition(3), path)
    assert sorted(os.listdir(path)) == [f"part-{i:05d}.jsonl.zst" for i in range(3)]
    back = read_completions(spark, [path + "/*.zst"])
    assert back.select("src_ord").distinct().count() == 3
    got = sorted((r.prompt_id, r.completion_idx, r.text) for r in back.collect())
    assert got == sorted((r.prompt_id, r.completion_idx, r.text) for r in rows.collect()) and "\n" in got[0][2]
