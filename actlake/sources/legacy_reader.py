"""Reader of the legacy shard layout as a Python Data Source: ``spark.read.format("actlake_legacy")``.

The plan comes from a listing alone: layer files and their sizes. What the option ``where`` asks of shard and layer drops
files, what it asks of keys and positions goes to the tasks; a plan of whole files is cut by their bytes, one for
single keys (of which a task reads little more than the index) by the bytes of the indexes. A task reads ``meta.json`` and
``index.jsonl`` of its shard, which rotation bounds, chooses its rows of the index and reads their sequences with
positioned I/O, neighbours at once. What disagrees is an error there (option ``strict``): the rules are those of ``legacy.legacy_report``.

``where`` is an option and not Spark's own pushdown of filters: what a Python reader accepts there is kept with the loaded
table, so a second query on the same DataFrame, with other filters or none, would read the first one's files.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.text import SCALE_FILE

SPLIT_BYTES = 128 * 1024 * 1024
#: Files smaller than this share a task even where tasks are idle.
LEAST_SPLIT = 1 << 20
BATCH_BYTES = 16 * 1024 * 1024
#: Index bytes that one task goes through when single keys are asked for.
INDEX_SPLIT = 16 * 1024 * 1024
LAYER_NAME = re.compile(r"acts_layer_([0-9]+)\.bin")
COLUMNS = ("shard", "layer", "prompt_id", "completion_idx", "token_pos")


def open_fs(uri: str):
    """File system and path of a location as Spark qualifies it (``file:/a/b``, ``scheme://host/a``)."""
    from pyarrow import fs as pafs
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


@dataclass(frozen=True)
class Bound:
    """What is asked of one column: a range with both ends and, if not None, a set."""

    low: float = -np.inf
    high: float = np.inf
    values: frozenset | None = None

    @classmethod
    def of(cls, asked) -> Bound:
        """From a list of values or ``{"from": a, "to": z}``, where one end may be missing."""
        if asked is None:
            return cls()
        if isinstance(asked, dict):
            low, high = asked.get("from"), asked.get("to")
            return cls(-np.inf if low is None else low, np.inf if high is None else high)
        return cls(values=frozenset(asked))

    def allows(self, v) -> bool:
        return (self.values is None or v in self.values) and (isinstance(v, str) or self.low <= v <= self.high)

    def mask(self, v: np.ndarray) -> np.ndarray:
        ok = (v >= self.low) & (v <= self.high)
        return ok if self.values is None else ok & np.isin(v, np.array(sorted(self.values), np.int64))


@dataclass(frozen=True)
class LayerFile:
    """A layer file of a shard, or (layer None) a shard without files."""

    shard: str
    folder: str
    layer: int | None = None
    size: int = 0


@dataclass
class LegacyPart(InputPartition):
    """Byte ranges of layer files: (file, from, to, layers that the shard has files of)."""

    ranges: list = field(default_factory=list)

    def __init__(self, ranges):
        super().__init__(None)
        self.ranges = ranges


class LegacyReader(DataSourceReader):
    """Options: ``path`` (as Spark qualifies it), ``where`` (JSON, see ``Bound.of``, by column), ``policy`` (``first``, ``last``), ``strict``,
    ``parallelism``, ``splitBytes``."""

    def __init__(self, options):
        self.root = options["path"]
        self.policy = options.get("policy", "first")
        self.strict = str(options.get("strict", "true")).lower() == "true"
        self.tasks = int(options.get("parallelism", 1))
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        asked = json.loads(options.get("where", "{}"))
        if set(asked) - set(COLUMNS):
            raise ValueError(f"where takes {COLUMNS}, got {sorted(asked)}")
        self.bounds = {c: Bound.of(asked.get(c)) for c in COLUMNS}
        if self.policy not in ("first", "last"):
            raise ValueError(f"policy must be 'first' or 'last', got {self.policy!r}")

    # ---- planning
    def _listed(self) -> tuple[list[LayerFile], dict[str, int]]:
        """(layer files, index bytes of each folder) of the shards that are asked for; the root itself if it holds none."""
        from pyarrow import fs as pafs
        fs, base = open_fs(self.root)
        found = fs.get_file_info(pafs.FileSelector(base, recursive=True))
        folders = {i.path: i.base_name for i in found if i.type == pafs.FileType.Directory and i.base_name.startswith("shard_")
                   and i.path.rsplit("/", 1)[0] == base.rstrip("/")} or {base.rstrip("/"): ""}
        if not any(i.path.rsplit("/", 1)[0] in folders and i.base_name in ("index.jsonl", "meta.json") for i in found):
            raise FileNotFoundError(f"{self.root} holds neither shard folders nor a shard")
        files, index, seen = [], {}, set()
        for i in found:
            folder = i.path.rsplit("/", 1)[0]
            if folder in folders and i.type == pafs.FileType.File and self.bounds["shard"].allows(folders[folder]):
                layer = LAYER_NAME.fullmatch(i.base_name)
                if layer:
                    files.append(LayerFile(folders[folder], folder, int(layer[1]), i.size))
                    seen.add(folder)
                elif i.base_name == "index.jsonl":
                    index[folder] = i.size
                elif i.base_name == "meta.json":
                    index.setdefault(folder, 0)
        files += [LayerFile(folders[x], x) for x in sorted(set(index) - seen)]
        return sorted(files, key=lambda f: (f.folder, -1 if f.layer is None else f.layer)), index

    def partitions(self):
        files, index = self._listed()
        layers: dict[str, tuple] = {}
        for f in files:
            layers[f.folder] = layers.get(f.folder, ()) + (() if f.layer is None else (f.layer,))
        wanted = [f for f in files if f.layer is None or self.bounds["layer"].allows(f.layer)]
        # a shard of which no file is read still answers for layers that it should have
        left = {f.folder: f.shard for f in files}
        files = wanted + [LayerFile(left[x], x) for x in sorted(set(left) - {f.folder for f in wanted})]
        by_key = self.bounds["prompt_id"].values is not None
        if by_key:
            target = INDEX_SPLIT
        else:
            target = min(self.split, max(LEAST_SPLIT, -(-sum(f.size for f in files) // self.tasks)))
        parts, held, size = [], [], 0
        for f in files:
            step = f.size if by_key or f.layer is None else target
            for low in range(0, max(1, f.size), max(1, step)):
                high = min(f.size, low + step)
                weight = index.get(f.folder, 0) if by_key else high - low
                if held and size + weight > target:
                    parts.append(LegacyPart(held))
                    held, size = [], 0
                held.append((f, low, high, layers[f.folder]))
                size += weight
        if held:
            parts.append(LegacyPart(held))
        return parts or [LegacyPart([])]

    # ---- one task
    def read(self, partition):
        shard = None
        for f, low, high, layers in partition.ranges:
            if shard is None or shard.folder != f.folder:
                shard = _Shard(self.root, f, self.policy, layers)
            if self.strict and low == 0:
                shard.check(f, self.bounds["layer"])
            if f.layer in shard.listed and shard.width:
                yield from self._sequences(shard, f, low, high)

    def _sequences(self, shard: _Shard, f: LayerFile, low: int, high: int):
        i = shard.index
        start, n, width = i["start"], i["n_tokens"], shard.width
        mine = shard.chosen & (i["layer"] == f.layer) & (n > 0) & (start * width >= low) & (start * width < high) \
            & ((start + n) * width <= f.size) & self.bounds["prompt_id"].mask(i["prompt_id"]) \
            & self.bounds["completion_idx"].mask(i["completion_idx"])
        at = np.flatnonzero(mine)
        if not len(at):
            return
        at = at[np.argsort(start[at], kind="stable")]
        token = self.bounds["token_pos"]
        first, last = max(0, token.low), token.high
        if token.values is not None:
            first, last = max(first, min(token.values, default=0)), min(last, max(token.values, default=-1))
        # the stretch of each sequence that is asked for, cut into pieces of a batch
        rows = max(1, BATCH_BYTES // width)
        held, size = [], 0
        fs, path = shard.fs, f"{f.folder}/acts_layer_{f.layer:03d}.bin"
        scales = fs.open_input_file(f"{f.folder}/{SCALE_FILE % f.layer}") if shard.dtype == "int8" else None
        with fs.open_input_file(path) as handle:
            for k in at.tolist():
                stop = int(min(n[k], last + 1))
                for a in range(int(first), stop, rows):
                    z = min(stop, a + rows)
                    held.append((k, a, z))
                    size += (z - a) * width
                    if size >= BATCH_BYTES:
                        yield from self._read(shard, f, handle, scales, held)
                        held, size = [], 0
            if held:
                yield from self._read(shard, f, handle, scales, held)
        if scales is not None:
            scales.close()

    def _read(self, shard: _Shard, f: LayerFile, handle, scales, pieces):
        """One Arrow batch of the pieces (index row, from token, to token); neighbours in the file are read at once."""
        i, width = shard.index, shard.width
        k, a, z = (np.array(x) for x in zip(*pieces, strict=True))
        begin, n = i["start"][k] + a, z - a
        joined = np.append(True, begin[1:] != begin[:-1] + n[:-1])
        heads = np.flatnonzero(joined)
        lens = np.add.reduceat(n, heads)
        raw, factors = [], []
        for at, rows in zip(begin[heads].tolist(), lens.tolist(), strict=True):
            data = handle.read_at(rows * width, at * width)
            if len(data) != rows * width:
                raise ValueError(f"{f.folder}, layer {f.layer}: the file ends before row {at + rows}")
            raw.append(data)
            if scales is not None:
                got = scales.read_at(rows * 4, at * 4)
                if len(got) != rows * 4:
                    raise ValueError(f"{f.folder}, layer {f.layer}: the scales end before row {at + rows}")
                factors.append(got)
        total = int(n.sum())
        row = np.repeat(np.arange(len(k)), n)
        pos = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + a[row]
        ends = (np.arange(total + 1) * width).astype(np.int32)
        payload = pa.Array.from_buffers(pa.binary(), total, [None, pa.py_buffer(ends), pa.py_buffer(b"".join(raw))])
        scale = pa.array(np.frombuffer(b"".join(factors), "<f4")) if scales is not None else pa.nulls(total, pa.float32())
        listed = self.bounds["token_pos"].values
        batch = pa.RecordBatch.from_arrays(
            [pa.repeat(f.shard, total), pa.repeat(pa.scalar(f.layer, pa.int32()), total), pa.array(i["prompt_id"][k][row]),
             pa.array(i["completion_idx"][k][row].astype(np.int32)), pa.array(pos.astype(np.int32)), pa.repeat(shard.dtype, total), payload, scale],
            ["shard", "layer", "prompt_id", "completion_idx", "token_pos", "dtype", "payload", "scale"])
        yield batch if listed is None else batch.filter(pa.array(self.bounds["token_pos"].mask(pos)))


INDEX = pa.schema([("prompt_id", pa.int64()), ("completion_idx", pa.int32()), ("layer", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int32())])


def _index_columns(lines) -> dict[str, np.ndarray]:
    """Index lines (a file-like object) as columns; without lines, empty ones."""
    from pyarrow import json as pj
    table = INDEX.empty_table() if lines is None else pj.read_json(
        lines, parse_options=pj.ParseOptions(explicit_schema=INDEX, unexpected_field_behavior="ignore"))
    return {c: table.column(c).to_numpy().astype(np.int64) for c in INDEX.names}


def _read_index(fs, path: str) -> dict[str, np.ndarray]:
    if not fs.get_file_info(path).size:
        return _index_columns(None)
    with fs.open_input_stream(path) as s:
        return _index_columns(s)


class _Shard:
    """Manifest and index of one shard folder."""

    def __init__(self, root: str, f: LayerFile, policy: str, layers: tuple):
        self.folder, self.layers = f.folder, layers
        self._open(root, f.folder)
        self.index = _read_index(self.fs, f"{f.folder}/index.jsonl") if self.has_index else _index_columns(None)
        i, n = self.index, len(self.index["start"])
        order = np.lexsort((np.arange(n) if policy == "first" else -np.arange(n), i["completion_idx"], i["prompt_id"], i["layer"]))
        key = np.stack([i[c][order] for c in ("layer", "prompt_id", "completion_idx")])
        new = np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))[:n]
        self.chosen = np.zeros(n, bool)
        self.chosen[order[new]] = True

    def _open(self, root: str, folder: str) -> None:
        from pyarrow import fs as pafs
        self.fs, _ = open_fs(root)
        has = {i.base_name for i in self.fs.get_file_info([f"{folder}/{x}" for x in ("meta.json", "index.jsonl")])
               if i.type == pafs.FileType.File}
        meta = {}
        if "meta.json" in has:
            with self.fs.open_input_stream(f"{folder}/meta.json") as s:
                meta = json.loads(s.read())
        self.dtype = meta.get("dtype") or "bfloat16"
        self.width = int(meta.get("d_model") or 0) * int(meta.get("bytes_per_elem") or 2)
        self.listed = set(meta.get("layers") or ())
        self.has_index = "index.jsonl" in has

    def check(self, f: LayerFile, wanted: Bound) -> None:
        """Raise if the file, the index and the manifest disagree about a layer that is read; the shard's first file answers for absent ones."""
        i, wrong = self.index, []
        if f.layer is None or f.layer == min(x for x in self.layers if wanted.allows(x)):
            wrong += [(x, "absent") for x in sorted((self.listed | set(np.unique(i["layer"]).tolist())) - set(self.layers)) if wanted.allows(x)]
        if f.layer is not None:
            here = i["layer"] == f.layer
            rows = f.size // self.width if self.width else 0
            if f.layer not in self.listed or not self.width:
                wrong.append((f.layer, "unlisted"))
            elif f.size % self.width:
                wrong.append((f.layer, "torn"))
            elif here.any() and int((i["start"] + i["n_tokens"])[here].max()) > rows:
                wrong.append((f.layer, "past_end"))
            elif int(i["n_tokens"][here].sum()) < rows:
                wrong.append((f.layer, "uncovered"))
        if wrong:
            raise ValueError(f"legacy shards do not agree with their index and manifest: {self.folder}: "
                             + ", ".join(f"layer {x} {why}" for x, why in wrong))


# --------------------------------------------------------------------------- a root that grows

class IndexRange(InputPartition):
    """Bytes [low, high) of a shard's index."""

    def __init__(self, folder: str, shard: str, low: int, high: int):
        super().__init__(None)
        self.folder, self.shard, self.low, self.high = folder, shard, low, high


class _Appended(_Shard):
    """Manifest and some new index rows of a shard; every row counts."""

    def __init__(self, root: str, p: IndexRange):
        self.folder = p.folder
        self._open(root, p.folder)
        with self.fs.open_input_file(f"{p.folder}/index.jsonl") as s:
            self.index = _index_columns(pa.BufferReader(s.read_at(p.high - p.low, p.low)))
        self.chosen = np.ones(len(self.index["start"]), bool)


class LegacyStreamReader(DataSourceStreamReader):
    """Rows that are appended to a root's shards while it grows (S9, R1): each index line once, with its tokens.

    The offset is the number of index bytes of every shard, up to the last whole line. A writer publishes payloads before the index
    that names them, and an append keeps what there is, so a range of lines always finds its rows. A key that is appended again comes again.
    """

    TAIL = 1 << 16

    def __init__(self, options):
        self.reader = LegacyReader(options)
        self.known: dict[str, int] = {}

    def initialOffset(self):  # noqa: N802
        return {}

    def latestOffset(self):  # noqa: N802
        from pyarrow import fs as pafs
        fs, base = open_fs(self.reader.root)
        base = base.rstrip("/")
        out = {}
        for i in fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True)):
            folder = i.path.rsplit("/", 1)[0]
            name = folder[len(base) + 1:]
            if i.base_name == "index.jsonl" and i.type == pafs.FileType.File and (not name or name.startswith("shard_") and "/" not in name):
                out[name] = self._lines(fs, i.path, i.size, self.known.get(name, 0))
        self.known |= out
        return out

    def _lines(self, fs, path: str, size: int, known: int) -> int:
        """Bytes up to the end of the last whole line."""
        with fs.open_input_file(path) as s:
            while size > known:
                low = max(known, size - self.TAIL)
                at = s.read_at(size - low, low).rfind(b"\n")
                if at >= 0:
                    return low + at + 1
                size = low
        return known

    def partitions(self, start, end):
        _, base = open_fs(self.reader.root)
        return [IndexRange(f"{base.rstrip('/')}/{name}".rstrip("/"), name, start.get(name, 0), high)
                for name, high in sorted(end.items()) if high > start.get(name, 0)]

    def read(self, partition):
        shard = _Appended(self.reader.root, partition)
        for layer in np.unique(shard.index["layer"]).tolist():
            info = shard.fs.get_file_info(f"{partition.folder}/acts_layer_{layer:03d}.bin")
            size = info.size or 0
            rows = shard.index["layer"] == layer
            if shard.width and int((shard.index["start"] + shard.index["n_tokens"])[rows].max()) * shard.width > size:
                raise ValueError(f"{partition.folder}: layer {layer} past_end: the index names rows that its file does not hold")
            if shard.width:
                yield from self.reader._sequences(shard, LayerFile(partition.shard, partition.folder, layer, size), 0, size)
