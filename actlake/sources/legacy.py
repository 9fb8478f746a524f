"""Legacy shard layout: index-driven import (S4-S7), export and append (K9).

Layout per shard directory (fixed by the existing tools)::

    acts_layer_{L:03d}.bin    token vectors, row-major, d_model x bytes per element
    scales_layer_{L:03d}.bin  int8 only: one little-endian fp32 scale per token
    index.jsonl               {prompt_id, completion_idx, layer, start, n_tokens}
    meta.json                 {model, layers, d_model, dtype, bytes_per_elem, ...}

Reading: ``read_legacy`` is a Python Data Source (``sources.legacy_reader``) that reads the files and rows it is
asked for. ``import_legacy`` reconciles index, manifest and files of the whole root first (``legacy_report``); an absent or
torn file, rows that no index entry covers and entries past a file's end are errors unless the caller asks to go on without them.

Writing is one transaction. Rows are hash-partitioned by ``(shard, layer)`` and sorted by the flat row, so exactly one task
writes each layer file, sequentially, as an attempt file; index and manifest follow the same way, and nothing is published yet. Each of these
jobs leaves the list of its files in the transaction's folder ``_txn-...`` under the root. When all have ended, a ``COMMIT`` file there
decides: then the files are moved to their names, layer files first, ``meta.json`` last, and the folder goes. A writer that dies before
the decision leaves the old state and some attempt files, one that dies after it leaves a folder that whoever opens the
root next carries out (``recover_legacy``). An existing file is an error, unless the shard is
re-opened: then its bytes are kept and the new rows must continue where they end. A layer file is as large as its shard,
which rotation bounds (``layout.assign_shards``). File access goes through ``pyarrow.fs`` on the paths as Spark resolves them.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..config import require_empty
from ..functions.text import LAYER_FILE, SCALE_FILE, json_row
from ..operators.layout import index_offsets, manifest as manifest_of, sequence_lengths
from ..operators.verify import resolve_duplicates
from ..session import qualified, stored
from .legacy_reader import LegacyReader, LegacyStreamReader, SPLIT_BYTES, open_fs as _fs
from .shards import read_index, read_manifest

FORMAT = "actlake_legacy"
KEYED_SCHEMA = ("shard string, layer int, prompt_id bigint, completion_idx int, token_pos int, "
                "dtype string, payload binary, scale float")
BATCH_BYTES = 16 * 1024 * 1024
KEY = ["shard", "layer", "prompt_id", "completion_idx"]
INDEX_COLS = ("prompt_id", "completion_idx", "layer", "start", "n_tokens")


# --------------------------------------------------------------------------- reading

def layer_files(spark: SparkSession, root: str) -> DataFrame:
    """(shard, layer, path, file_bytes) of every layer file under ``root``, from the listing alone."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "acts_layer_*.bin").load(root).select("path", "length"))
    return files.select(F.regexp_extract("path", r"/(shard_[^/]+)/[^/]+$", 1).alias("shard"),
                        F.regexp_extract("path", r"acts_layer_([0-9]+)\.bin$", 1).cast("int").alias("layer"),
                        "path", F.col("length").alias("file_bytes"))


def legacy_report(spark: SparkSession, root: str) -> DataFrame:
    """A4 / D19 / J10 on legacy files: one row per (shard, layer) that the manifest, the index or a file names.

    ``status``: ``ok``; ``absent`` (listed or indexed, no file); ``unlisted`` (file or index rows without manifest
    entry); ``torn`` (bytes after the last whole row); ``past_end`` (index rows beyond the file); ``uncovered`` (stored
    rows that no index entry points at). The first that holds is given. No payload is read.
    """
    meta = read_manifest(spark, root).select("shard", F.explode("layers").alias("layer"), "dtype", "d_model", "bytes_per_elem")
    idx = read_index(spark, root).groupBy("shard", "layer").agg(
        F.count(F.lit(1)).alias("n_index_rows"), F.sum("n_tokens").cast("bigint").alias("index_tokens"),
        F.max(F.col("start") + F.col("n_tokens")).alias("index_end"))
    x = meta.join(layer_files(spark, root), ["shard", "layer"], "full_outer").join(idx, ["shard", "layer"], "full_outer")
    row = F.col("d_model") * F.col("bytes_per_elem")
    x = x.withColumn("tokens_in_file", F.floor(F.col("file_bytes") / row)).withColumn("torn_bytes", F.col("file_bytes") % row)
    seen = F.coalesce("index_tokens", F.lit(0))
    status = (F.when(F.col("d_model").isNull(), "unlisted").when(F.col("path").isNull(), "absent")
              .when(F.col("torn_bytes") > 0, "torn").when(F.col("index_end") > F.col("tokens_in_file"), "past_end")
              .when(seen < F.col("tokens_in_file"), "uncovered").otherwise("ok"))
    return x.select("shard", "layer", "dtype", "d_model", "bytes_per_elem", "path", "file_bytes", "tokens_in_file", "torn_bytes",
                    F.coalesce("n_index_rows", F.lit(0)).alias("n_index_rows"), seen.alias("index_tokens"), status.alias("status"))


def layer_file_report(spark: SparkSession, root: str) -> DataFrame:
    """Bytes, whole token rows and torn tail bytes of every layer file."""
    return legacy_report(spark, root).where("path is not null").select(
        "shard", "layer", "dtype", "file_bytes", "tokens_in_file", "torn_bytes")


def _read_sequences(batches):
    """Index rows with their file -> token rows. Rows come sorted by file and offset."""
    path = handle = scales = None
    try:
        for rb in batches:
            held, size = [], 0
            for r in rb.to_pylist():
                if r["path"] != path:
                    for h in (handle, scales):
                        if h is not None:
                            h.close()
                    path, (fs, p) = r["path"], _fs(r["path"])
                    handle = fs.open_input_file(p)
                    folder = p.rsplit("/", 1)[0]
                    scales = fs.open_input_file(f"{folder}/{SCALE_FILE % r['layer']}") if r["dtype"] == "int8" else None
                width = r["d_model"] * r["bytes_per_elem"]
                step = max(1, BATCH_BYTES // width)
                for lo in range(0, r["n_tokens"], step):
                    n = min(step, r["n_tokens"] - lo)
                    at = r["start"] + lo
                    raw = handle.read_at(n * width, at * width)
                    sc = np.frombuffer(scales.read_at(n * 4, at * 4), "<f4") if scales else None
                    if len(raw) != n * width or (sc is not None and len(sc) != n):
                        raise ValueError(f"{path} ends before row {at + n}")
                    held.append((r, lo, n, width, raw, sc))
                    size += len(raw)
                    if size >= BATCH_BYTES:
                        yield _token_rows(held)
                        held, size = [], 0
            if held:
                yield _token_rows(held)
    finally:
        for h in (handle, scales):
            if h is not None:
                h.close()


def _token_rows(held) -> pa.RecordBatch:
    n = np.array([h[2] for h in held])
    rows = pa.array(np.repeat(np.arange(len(held)), n))

    def col(name, kind):
        return pa.array([h[0][name] for h in held], kind).take(rows)
    pos = np.concatenate([np.arange(h[1], h[1] + h[2], dtype=np.int32) for h in held])
    ends = np.concatenate([[0], np.cumsum(np.repeat([h[3] for h in held], n))]).astype(np.int32)
    payload = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(h[4] for h in held))])
    scale = pa.concat_arrays([pa.array(h[5], pa.float32()) if h[5] is not None else pa.nulls(h[2], pa.float32()) for h in held])
    return pa.RecordBatch.from_arrays(
        [col("shard", pa.string()), col("layer", pa.int32()), col("prompt_id", pa.int64()), col("completion_idx", pa.int32()),
         pa.array(pos), col("dtype", pa.string()), payload, scale],
        ["shard", "layer", "prompt_id", "completion_idx", "token_pos", "dtype", "payload", "scale"])


def import_legacy(spark: SparkSession, root: str, policy: str = "first", strict: bool = True,
                  only: DataFrame | None = None) -> DataFrame:
    """S6 + S5 + S7 + W3: legacy shards -> activation rows, the sequences the index names.

    ``policy``: which of several index rows of a key counts, the ``first`` or the ``last`` appended. With ``strict``
    anything ``legacy_report`` finds wrong is an error; without it, sequences that lie whole in an
    existing file are read and the report says what is missing. ``only`` (key columns) names the sequences to read.
    """
    if policy not in ("first", "last"):
        raise ValueError(f"policy must be 'first' or 'last', got {policy!r}")
    recover_legacy(spark, root)
    report = legacy_report(spark, root)
    if strict:
        require_empty(report.where("status <> 'ok'").select("shard", "layer", "status", "tokens_in_file", "index_tokens", "torn_bytes"),
                      "legacy shards do not agree with their index and manifest")
    chosen = resolve_duplicates(read_index(spark, root), KEY, "append_ord", policy)
    if only is not None:
        chosen = chosen.join(only, KEY, "left_semi")
    files = report.where("path is not null and d_model is not null").select(
        "shard", "layer", "path", "dtype", "d_model", "bytes_per_elem", "tokens_in_file")
    x = chosen.join(files, ["shard", "layer"]).where(F.col("start") + F.col("n_tokens") <= F.col("tokens_in_file")).drop("tokens_in_file")
    width = F.col("d_model") * F.col("bytes_per_elem")
    total = report.agg(F.sum("file_bytes")).first()[0] or 0
    n = max(1, -(-total // SPLIT_BYTES), min(spark.sparkContext.defaultParallelism, total // (1 << 20)))
    spread = x.withColumn("_part", F.floor(F.col("start") * width / F.lit(max(1, total // n))))
    return (spread.repartition(int(n), "path", "_part").sortWithinPartitions("path", "start")
            .select(*KEY, "start", "n_tokens", "path", "dtype", "d_model", "bytes_per_elem")
            .mapInArrow(_read_sequences, KEYED_SCHEMA))


def read_legacy(spark: SparkSession, root: str, where: dict | None = None, policy: str = "first", strict: bool = True) -> DataFrame:
    """S6 + S5 + S7 + J8 as a scan. ``where`` asks by column (shard, layer, prompt_id, completion_idx, token_pos) for a list of
    values or a pair (from, to) with both ends, None where one is open; only those files and rows are read.

    Rows and policies are those of ``import_legacy``; with ``strict`` the layers that are read are checked where they
    are read, so what disagrees fails the action, not this call.
    """
    recover_legacy(spark, root)
    register(spark)
    asked = {c: {"from": x[0], "to": x[1]} if isinstance(x, tuple) else list(x) for c, x in (where or {}).items()}
    return (spark.read.format(FORMAT).option("policy", policy).option("strict", str(strict).lower()).option("where", json.dumps(asked))
            .option("parallelism", spark.sparkContext.defaultParallelism).load(qualified(spark, root)))


def stream_legacy(spark: SparkSession, root: str) -> DataFrame:
    """S9 + R1: rows of a root of legacy shards as they are appended, as a stream; new shards may come."""
    register(spark)
    return spark.readStream.format(FORMAT).load(qualified(spark, root))


def read_legacy_sequence(spark: SparkSession, root: str, layer: int, prompt_id: int, completion_idx: int, shard: str | None = None,
                         policy: str = "first") -> DataFrame:
    """J8 + O3 on a legacy root: one sequence at one layer, by position. Payloads stay as stored (``decode_activations``)."""
    where = {"layer": [layer], "prompt_id": [prompt_id], "completion_idx": [completion_idx]} | ({"shard": [shard]} if shard else {})
    return read_legacy(spark, root, where, policy).orderBy("token_pos")


# --------------------------------------------------------------------------- writing

@dataclass
class _Written(WriterCommitMessage):
    files: list = field(default_factory=list)  # (attempt file, final file)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options):
        self.root = options["path"]
        self.kind = options["kind"]
        self.reopen = str(options.get("reopen", "false")).lower() == "true"
        self.widths = {k: int(v) for k, v in json.loads(options.get("rowBytes", "{}")).items()}
        self.txn = options["txn"]
        self.mark = f"{self.txn[len(TXN):]}.{options['job']}"

    # ---- one task
    def write(self, iterator):
        fs, base = _fs(self.root)
        out = _Written()
        handles: dict = {}
        try:
            if self.kind == "payload":
                self._payload(fs, base, iterator, handles, out)
            else:
                self._text(fs, base, iterator, handles, out)
        finally:
            for h in handles.values():
                h.close()
        return out

    def _open(self, fs, base, shard, name, out, keep=True):
        """An attempt file for ``name``; a re-opened one starts with the bytes there are."""
        from pyarrow import fs as pafs
        folder = f"{base}/{shard}" if shard else base
        fs.create_dir(folder, recursive=True)
        final = f"{folder}/{name}"
        attempt = f"{folder}/_{self.mark}-{uuid.uuid4().hex}-{name}"
        exists = fs.get_file_info(final).type != pafs.FileType.NotFound
        if exists and keep and not self.reopen:
            raise FileExistsError(f"{final} exists; re-open the shard to append to it")
        out.files.append((attempt, final))
        h, size = fs.open_output_stream(attempt), 0
        if exists and keep:
            with fs.open_input_stream(final) as old:
                while chunk := old.read(1 << 24):
                    h.write(chunk)
                    size += len(chunk)
        return h, size

    def _payload(self, fs, base, iterator, handles, out):
        cur, expect, width = None, 0, 1
        for rb in iterator:
            if not rb.num_rows:
                continue
            shard = np.asarray(rb.column("shard").to_pylist(), dtype=object)
            layer = rb.column("layer").to_numpy(zero_copy_only=False)
            row = rb.column("flat_row").to_numpy(zero_copy_only=False)
            change = np.ones(rb.num_rows, dtype=bool)
            change[1:] = (shard[1:] != shard[:-1]) | (layer[1:] != layer[:-1])
            starts = np.append(np.flatnonzero(change), rb.num_rows)
            for i, j in zip(starts[:-1], starts[1:]):
                key = (shard[i], int(layer[i]))
                if key != cur:
                    for h in handles.values():
                        h.close()
                    handles.clear()
                    handles["data"], size = self._open(fs, base, key[0], LAYER_FILE % key[1], out)
                    dtype = rb.column("dtype")[int(i)].as_py()
                    width = self.widths[dtype]
                    if dtype == "int8":
                        handles["scale"], _ = self._open(fs, base, key[0], SCALE_FILE % key[1], out)
                    if size % width:
                        raise ValueError(f"layer file of {key} has a torn last row; it cannot be continued")
                    cur, expect = key, size // width
                rows = row[i:j]
                if rows[0] != expect or (len(rows) > 1 and not np.all(np.diff(rows) == 1)):
                    raise ValueError(f"rows of {key} do not follow on (at {rows[0]}, expected {expect})")
                expect = int(rows[-1]) + 1
                seg = rb.column("payload").slice(i, j - i)
                bufs = seg.buffers()
                o = np.frombuffer(bufs[1], dtype=np.int32)[seg.offset: seg.offset + len(seg) + 1]
                if int(o[-1] - o[0]) != (j - i) * width:
                    raise ValueError(f"payloads of {key} are not {width} bytes each")
                handles["data"].write(memoryview(bufs[2])[o[0]:o[-1]])
                if "scale" in handles:
                    handles["scale"].write(rb.column("scale").slice(i, j - i).to_numpy(zero_copy_only=False).astype("<f4").tobytes())

    def _text(self, fs, base, iterator, handles, out):
        """One line per row: the index (continued when re-opened) or a shard's meta.json (replaced)."""
        cur = None
        for rb in iterator:
            for shard, value in zip(rb.column("shard").to_pylist(), rb.column("value").to_pylist()):
                if shard != cur:
                    for h in handles.values():
                        h.close()
                    handles.clear()
                    cur = shard
                    name = "index.jsonl" if self.kind == "index" else "meta.json"
                    handles["text"], _ = self._open(fs, base, shard, name, out, keep=self.kind == "index")
                handles["text"].write((value + "\n").encode("utf-8"))

    # ---- the driver
    def commit(self, messages):
        """Leave the list of files for the transaction; nothing is published here."""
        fs, base = _fs(self.root)
        named = [pair for m in messages for pair in (m.files if m else ())]
        fs.create_dir(f"{base}/{self.txn}", recursive=True)
        with fs.open_output_stream(f"{base}/{self.txn}/{self.mark}.json") as out:
            out.write(json.dumps({"kind": self.kind, "files": named}).encode())
        self._sweep({attempt for attempt, _ in named})

    def abort(self, messages):
        self._sweep()

    def _sweep(self, named=frozenset()):
        """Remove attempt files of this job that no message names (failed or speculative tasks)."""
        fs, base = _fs(self.root)
        for path in _files(fs, base, f"_{self.mark}-"):
            if path not in named:
                fs.delete_file(path)


class LegacyShards(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return KEYED_SCHEMA

    def reader(self, schema):
        return LegacyReader(self.options)

    def streamReader(self, schema):  # noqa: N802
        return LegacyStreamReader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LegacyShards)


def export_legacy(acts: DataFrame, index: DataFrame, manifest: DataFrame, root: str, reopen: bool = False) -> None:
    """K9: write activations, index and manifest in the legacy layout, all or nothing.

    ``acts``: (shard, layer, prompt_id, completion_idx, token_pos, dtype, payload, scale);
    ``index``: (shard, layer, prompt_id, completion_idx, start, n_tokens, append_ord);
    ``manifest``: one row per shard (``operators.layout.manifest``). One width and row size per call and
    dtype. Existing layer or index files are an error unless ``reopen`` (``append_legacy``).
    """
    commit_legacy(acts.sparkSession, root, stage_legacy(acts, index, manifest, root, reopen))


def stage_legacy(acts: DataFrame, index: DataFrame, manifest: DataFrame, root: str, reopen: bool = False) -> str:
    """``export_legacy`` up to the decision: everything is written, nothing is visible. Returns the transaction for ``commit_legacy``."""
    from ..operators.joins import size_checked_broadcast
    spark = acts.sparkSession
    register(spark)
    recover_legacy(spark, root)
    root = qualified(spark, root)
    # one row per sequence and per shard, read by several jobs
    index, manifest = stored(index, "legacy-index"), stored(manifest, "legacy-manifest")
    starts = size_checked_broadcast(index.select(*KEY, "start"), 48)
    rows = acts.join(starts, KEY).select(
        "shard", "layer", (F.col("start") + F.col("token_pos")).alias("flat_row"), "dtype", "payload", "scale")
    widths: dict[str, int] = {}
    for m in manifest.select("d_model", "bytes_per_elem", "dtype").distinct().collect():
        if widths.setdefault(m["dtype"], m["d_model"] * m["bytes_per_elem"]) != m["d_model"] * m["bytes_per_elem"]:
            raise ValueError(f"the manifest gives {m['dtype']} two row sizes")
    txn = f"{TXN}{uuid.uuid4().hex}"
    jobs: list[str] = []

    def save(df, kind):
        jobs.append(kind)
        (df.write.format(FORMAT).option("kind", kind).option("txn", txn).option("job", len(jobs)).option("reopen", str(reopen).lower())
         .option("rowBytes", json.dumps(widths)).mode("append").save(root))
    save(rows.repartition("shard", "layer").sortWithinPartitions("shard", "layer", "flat_row"), "payload")
    save(index.repartition("shard").sortWithinPartitions("shard", "append_ord")
         .select("shard", json_row(*INDEX_COLS).alias("value")), "index")
    cols = [c for c in manifest.columns if c != "shard"]
    save(manifest.repartition("shard").select("shard", F.to_json(F.struct(*cols)).alias("value")), "meta")
    return txn


def commit_legacy(spark: SparkSession, root: str, txn: str) -> None:
    """Decide a staged transaction and carry it out."""
    root = qualified(spark, root)
    decide_legacy(root, txn)
    _carry_out(root, txn)


TXN, DECISION = "_txn-", "COMMIT"
#: The order in which a transaction's files are published.
KINDS = ("payload", "index", "meta")


def _files(fs, base: str, prefix: str) -> list[str]:
    from pyarrow import fs as pafs
    found = fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
    return [i.path for i in found if i.type == pafs.FileType.File and i.base_name.startswith(prefix)]


def decide_legacy(root: str, txn: str) -> None:
    """From here on the transaction holds: whoever opens the root carries it out."""
    fs, base = _fs(root)
    with fs.open_output_stream(f"{base}/{txn}/{DECISION}"):
        pass


def _publish(fs, attempt: str, final: str) -> None:
    """Move one file to its name. A file that has moved already is passed over, so this can be done again."""
    from pyarrow import fs as pafs
    if fs.get_file_info(attempt).type == pafs.FileType.NotFound:
        return
    if not isinstance(fs, pafs.LocalFileSystem) and fs.get_file_info(final).type != pafs.FileType.NotFound:
        fs.delete_file(final)  # the attempt file holds all of it; a local move replaces
    fs.move(attempt, final)


def _carry_out(root: str, txn: str) -> None:
    """Publish the files of a transaction that is decided; its folder goes last."""
    fs, base = _fs(root)
    lists = []
    for path in _files(fs, f"{base}/{txn}", ""):
        if path.endswith(".json"):
            with fs.open_input_stream(path) as s:
                lists.append(json.loads(s.read()))
    for kind in KINDS:
        for files in (x["files"] for x in lists if x["kind"] == kind):
            for attempt, final in files:
                _publish(fs, attempt, final)
    fs.delete_dir(f"{base}/{txn}")


def recover_legacy(spark: SparkSession, root: str, discard: bool = False) -> dict[str, int]:
    """Bring a root to a state that holds: decided transactions are carried out. ``discard`` also removes undecided ones with their
    attempt files; only where no writer is at work (one that is would lose its files). Returns how many of each there were."""
    from pyarrow import fs as pafs
    fs, base = _fs(qualified(spark, root))
    found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
    open_ = [i.base_name for i in found if i.type == pafs.FileType.Directory and i.base_name.startswith(TXN)]
    out = {"carried_out": 0, "discarded": 0}
    for txn in sorted(open_):
        if fs.get_file_info(f"{base}/{txn}/{DECISION}").type != pafs.FileType.NotFound:
            _carry_out(qualified(spark, root), txn)
            out["carried_out"] += 1
        elif discard:
            for path in _files(fs, base, f"_{txn[len(TXN):]}."):
                fs.delete_file(path)
            fs.delete_dir(f"{base}/{txn}")
            out["discarded"] += 1
    return out


def append_legacy(acts: DataFrame, root: str, model: str, d_model: int, dtype: str, order_cols=("prompt_id", "completion_idx")) -> None:
    """K9 on shards that exist: new sequences go after the rows each (shard, layer) already holds, all or nothing.

    The index continues (``index_offsets`` with the present ends), the manifest counts old and new rows. A key that is
    appended again keeps both index rows; readers choose (``import_legacy`` policy).
    """
    commit_legacy(acts.sparkSession, root, stage_append(acts, root, model, d_model, dtype, order_cols))


def stage_append(acts: DataFrame, root: str, model: str, d_model: int, dtype: str, order_cols=("prompt_id", "completion_idx")) -> str:
    """``append_legacy`` up to the decision; returns the transaction for ``commit_legacy``."""
    spark = acts.sparkSession
    recover_legacy(spark, root)
    old = read_index(spark, root)
    ends = old.groupBy("shard", "layer").agg(F.max(F.col("start") + F.col("n_tokens")).alias("end"))
    seqs = sequence_lengths(acts, KEY).withColumn("append_ord", F.struct(*order_cols))
    index = index_offsets(seqs, "append_ord", partition=("shard", "layer"), prior_end=ends)
    names = ["shard", *INDEX_COLS]
    index = stored(index, "append-index")
    both = old.select(*names).unionByName(index.select(*names)).join(index.select("shard").distinct(), "shard", "left_semi")
    return stage_legacy(acts, index, manifest_of(both, model, d_model, dtype), root, reopen=True)
