"""The legacy shard reader: only the files and rows asked for, the same rows however it is cut, errors where files disagree;
writes as one transaction: after a writer's death at any step readers and the next writer go on."""

import glob
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from actlake.functions.codec import encode_activations
from actlake.operators import layout as L
from actlake.sources import legacy as LG
from actlake.sources.legacy_reader import LegacyReader

KEY = ("shard", "layer", "prompt_id", "completion_idx")
D = 8


def _acts(spark, prompts, shards=("shard_0000",), layers=(5, 7), dtype="bfloat16"):
    rows = [(s, layer, p, c, t, [float(p + t + layer)] * D) for s in shards for layer in layers for p in prompts for c in (0, 1)
            for t in range(1 + p % 4)]
    df = spark.createDataFrame(rows, "shard string, layer int, prompt_id long, completion_idx int, token_pos int, vec array<float>")
    return encode_activations(df, dtype)


def _export(spark, acts, root, dtype="bfloat16"):
    idx = L.index_offsets(L.sequence_lengths(acts, KEY).withColumn("append_ord", F.struct("prompt_id", "completion_idx")),
                          "append_ord", partition=("shard", "layer"))
    LG.export_legacy(acts, idx, L.manifest(idx, "m", D, dtype), root)


def _rows(df):
    return sorted((r.shard, r.layer, r.prompt_id, r.completion_idx, r.token_pos, r.dtype, bytes(r.payload), r.scale) for r in df.collect())


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("legacy"))
    _export(spark, _acts(spark, range(1, 9), ("shard_0000", "shard_0001", "shard_0002"), dtype="int8"), path, "int8")
    return path


def test_where_is_exact(spark, root):
    every = _rows(_acts(spark, range(1, 9), ("shard_0000", "shard_0001", "shard_0002"), dtype="int8"))
    assert _rows(LG.read_legacy(spark, root)) == every
    for where, keep in [({"layer": [7]}, lambda r: r[1] == 7), ({"shard": ["shard_0001", "none"]}, lambda r: r[0] == "shard_0001"),
                        ({"prompt_id": [3, 6], "completion_idx": [1]}, lambda r: r[2] in (3, 6) and r[3] == 1),
                        ({"prompt_id": (2, 4), "token_pos": (1, None)}, lambda r: 2 <= r[2] <= 4 and r[4] >= 1),
                        ({"token_pos": [0, 2], "layer": (None, 5)}, lambda r: r[4] in (0, 2) and r[1] <= 5),
                        ({"prompt_id": []}, lambda r: False), ({"shard": ["none"]}, lambda r: False)]:
        assert _rows(LG.read_legacy(spark, root, where)) == [r for r in every if keep(r)], where
    # one DataFrame under several filters, and after them without
    df = LG.read_legacy(spark, root)
    assert df.where("layer = 7").count() == sum(r[1] == 7 for r in every)
    assert _rows(df.where("layer = 5").unionByName(df.where("layer = 7"))) == _rows(df) == every
    one = LG.read_legacy_sequence(spark, root, 7, 3, 1, "shard_0002")
    assert [r.token_pos for r in one.collect()] == [0, 1, 2, 3]
    with pytest.raises(Exception, match="where takes"):
        LG.read_legacy(spark, root, {"rid": ["x"]}).count()


def _planned(root, **options):
    return LegacyReader({"path": root, "parallelism": "64"} | options).partitions()


def test_the_plan_holds_only_what_is_asked_for(spark, root, monkeypatch):
    files = lambda parts: sorted({(f.shard, f.layer) for p in parts for f, *_ in p.ranges})
    assert files(_planned(root)) == [(f"shard_000{s}", layer) for s in range(3) for layer in (5, 7)]
    assert files(_planned(root, where='{"layer": [7], "shard": ["shard_0001"]}')) == [("shard_0001", 7)]
    # whole files are cut by their bytes, without a gap
    monkeypatch.setattr("actlake.sources.legacy_reader.LEAST_SPLIT", 1)
    parts = _planned(root, splitBytes="100")
    assert len(parts) > 12
    for f in {f for p in parts for f, *_ in p.ranges}:
        cuts = sorted((low, high) for p in parts for g, low, high, _ in p.ranges if g == f)
        assert cuts[0][0] == 0 and cuts[-1][1] == f.size and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))
    # a question for keys is cut by the indexes instead
    assert len(_planned(root, splitBytes="100", where='{"prompt_id": [3]}')) == 1
    plan = LG.read_legacy(spark, root, {"layer": [7]})._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and LG.read_legacy(spark, root, {"layer": [7], "shard": ["shard_0000"]}).rdd.getNumPartitions() == 1


@pytest.mark.parametrize("split", [40, 100, 1 << 20])
def test_rows_do_not_depend_on_the_cuts(spark, root, monkeypatch, split):
    monkeypatch.setattr("actlake.sources.legacy_reader.LEAST_SPLIT", 1)
    monkeypatch.setattr("actlake.sources.legacy_reader.BATCH_BYTES", 24)
    reader = LegacyReader({"path": root, "parallelism": "64", "splitBytes": str(split)})
    got = [tuple(r.values()) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(got) == _rows(LG.read_legacy(spark, root))


def test_policy(spark, tmpdir_fresh):
    root = os.path.join(tmpdir_fresh, "twice")
    _export(spark, _acts(spark, [2]), root)
    LG.append_legacy(_acts(spark, [2]).withColumn("payload", F.reverse("payload")), root, "m", D, "bfloat16")
    for policy in ("first", "last"):
        assert _rows(LG.read_legacy(spark, root, policy=policy)) == _rows(LG.import_legacy(spark, root, policy))
    assert _rows(LG.read_legacy(spark, root)) != _rows(LG.read_legacy(spark, root, policy="last"))
    with pytest.raises(Exception, match="policy"):
        LG.read_legacy(spark, root, policy="any").count()


@pytest.mark.parametrize("damage", ["absent", "torn", "past_end", "uncovered", "unlisted"])
def test_damage_fails_the_scan_of_its_layer(spark, tmpdir_fresh, damage):
    root = os.path.join(tmpdir_fresh, damage)
    _export(spark, _acts(spark, [1, 2, 3]), root)
    f, meta = (os.path.join(root, "shard_0000", x) for x in ("acts_layer_007.bin", "meta.json"))
    data = open(f, "rb").read()
    if damage == "absent":
        os.remove(f)
    elif damage == "unlisted":
        m = json.load(open(meta))
        json.dump(m | {"layers": [5]}, open(meta, "w"))
    else:
        open(f, "wb").write({"torn": data + b"x", "past_end": data[:-2 * D], "uncovered": data + data[:2 * D]}[damage])
    for where in (None, {"layer": [7]}):
        with pytest.raises(Exception, match=f"layer 7 {damage}"):
            LG.read_legacy(spark, root, where).count()
    assert LG.read_legacy(spark, root, {"layer": [5]}).count() == 18
    assert _rows(LG.read_legacy(spark, root, strict=False)) == _rows(LG.import_legacy(spark, root, strict=False))


def test_a_root_without_shards(spark, tmpdir_fresh):
    with pytest.raises(Exception, match="neither"):
        LG.read_legacy(spark, tmpdir_fresh).count()
    sd = os.path.join(tmpdir_fresh, "single")
    os.makedirs(sd)
    np.arange(2 * D, dtype="<u2").tofile(os.path.join(sd, "acts_layer_001.bin"))
    json.dump({"model": "m", "layers": [1], "d_model": D}, open(os.path.join(sd, "meta.json"), "w"))
    with open(os.path.join(sd, "index.jsonl"), "w") as f:
        f.write(json.dumps({"prompt_id": 9, "completion_idx": 1, "layer": 1, "start": 0, "n_tokens": 2, "more": 3}) + "\n")
    assert [r[:6] for r in _rows(LG.read_legacy(spark, sd))] == [("", 1, 9, 1, t, "bfloat16") for t in (0, 1)]


def test_a_growing_root_gives_every_append_once(spark, tmpdir_fresh, monkeypatch):
    from actlake.sources.legacy_reader import LegacyStreamReader
    from actlake.streaming.ingest import drain
    root, out, ck = (os.path.join(tmpdir_fresh, n) for n in ("root", "out", "ck"))
    monkeypatch.setattr(LegacyStreamReader, "TAIL", 5)

    def read():
        q = LG.stream_legacy(spark, root).writeStream.format("parquet").option("checkpointLocation", ck).trigger(availableNow=True).start(out)
        drain(q, 300)
        return _rows(spark.read.parquet(out))
    steps = [_acts(spark, [1, 2]), _acts(spark, [3], shards=("shard_0001",)), _acts(spark, [4]), _acts(spark, [4])]
    want = []
    for n, acts in enumerate(steps):
        _export(spark, acts, root) if n < 2 else LG.append_legacy(acts, root, "m", D, "bfloat16")
        want += _rows(acts)
        assert read() == sorted(want)
    assert read() == sorted(want)
    # a line that is not whole yet waits
    path = os.path.join(root, "shard_0001", "index.jsonl")
    whole = os.path.getsize(path)
    with open(path, "a") as f:
        f.write('{"prompt_id": 3, "completion_idx"')
    assert read() == sorted(want)
    reader = LegacyStreamReader({"path": root})
    assert reader.latestOffset()["shard_0001"] == whole and reader.initialOffset() == {}
    assert [(p.shard, p.low) for p in reader.partitions({"shard_0000": 10}, reader.latestOffset())] == [("shard_0000", 10), ("shard_0001", 0)]
    with open(path, "a") as f:
        f.write(': 0, "layer": 5, "start": 0, "n_tokens": 1}\n')
    first = next(r for r in _rows(steps[1]) if r[1] == 5 and r[4] == 0)
    assert read() == sorted([*want, first])


# ------------------------------------------------------------------ a writer that dies

class Death(Exception):
    pass


def _dies(*_, **__):
    raise Death


STEPS = ["payload", "index", "meta", "decision", "first move", "before meta moves", "folder"]


@pytest.mark.parametrize("step,first", [(s, False) for s in STEPS] + [("meta", True), ("decision", True)])
def test_death_after_each_step(spark, tmpdir_fresh, monkeypatch, step, first):
    """``first``: the writer makes the shard; else it appends to it. Attempt files of a dead writer are no trouble to the next."""
    root = os.path.join(tmpdir_fresh, "r")
    before = _acts(spark, [4, 2])
    os.makedirs(root)
    if not first:
        _export(spark, before, root)
    new = _acts(spark, [3, 1], dtype="bfloat16")
    with monkeypatch.context() as m:
        if step == "payload":  # the index job fails in its tasks, after the payload job
            m.setattr(LG, "json_row", lambda *a: F.raise_error(F.lit("death")))
        elif step == "index":
            m.setattr(LG.F, "to_json", lambda *a: F.raise_error(F.lit("death")))
        elif step == "meta":
            m.setattr(LG, "decide_legacy", _dies)
        elif step == "decision":
            m.setattr(LG, "_carry_out", _dies)
        elif step == "folder":
            from pyarrow import fs as pafs

            class Fs(pafs.LocalFileSystem):
                def delete_dir(self, path):
                    raise Death
            m.setattr(LG, "_fs", lambda uri: (Fs(), "/" + uri[5:].lstrip("/") if uri.startswith("file:") else uri))
        else:
            publish, moved = LG._publish, []

            def some(fs, attempt, final):
                if moved and step == "first move" or final.endswith("meta.json"):
                    raise Death
                publish(fs, attempt, final)
                moved.append(final)
            m.setattr(LG, "_publish", some)
        with pytest.raises(Exception):  # noqa: B017
            if first:
                _export(spark, new, root)
            else:
                LG.append_legacy(new, root, "m", D, "bfloat16")
    held = step not in STEPS[:3]
    if first and not held:
        assert not glob.glob(os.path.join(root, "shard_0000", "[!_]*"))
    else:
        want = (_rows(before) if not first else []) + (_rows(new) if held else [])
        assert _rows(LG.read_legacy(spark, root)) == sorted(want)
        if step == "before meta moves":
            assert _rows(LG.import_legacy(spark, root)) == sorted(want)
    # the next writer
    more = _acts(spark, [6])
    if first and not held:
        _export(spark, more, root)
    else:
        LG.append_legacy(more, root, "m", D, "bfloat16")
    want = sorted(_rows(more) + (_rows(before) if not first else []) + (_rows(new) if held else []))
    assert _rows(LG.read_legacy(spark, root)) == want
    LG.recover_legacy(spark, root, discard=True)
    assert not glob.glob(os.path.join(root, "**", "_*"), recursive=True)
    assert _rows(LG.read_legacy(spark, root)) == want
