"""End-to-end jobs matching the reference's entry points, composed from the library.

* ``plan_job``    - extraction planning: prompt / completion files -> plan, run metadata, summary.
* ``ingest_job``  - captured batches (static or streaming) -> stored activations, index, manifest.
* ``verify_job``  - reconciliation, first sequences' norm health, payload audit (``verify_legacy_job``: of shard folders).
* ``compare_job`` - two stored runs at one layer: metrics, sampled positions, shift check, drift
  (``compare_legacy_job``: of two shard roots).

Each returns DataFrames (and writes what the reference writes); nothing is collected except
guard probes and the one-row summary.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import GuardError, RunConfig
from ..functions.text import REPLICA_DIR, SHARD_DIR
from ..operators import compare as C
from ..operators import layout as L
from ..operators import verify as VF
from ..sinks import tables as K
from ..sources.jsonl import read_completions, read_prompts
from ..sources.legacy import import_legacy, legacy_report, read_legacy
from ..sources.shards import read_capture, read_index
from ..streaming.ingest import capture_stream, capture_to_activations, drain, start_ingest
from . import extraction as X


def plan_job(spark: SparkSession, prompt_files: list[str], completion_files: list[str], cfg: RunConfig,
             out_dir: str, system=None, tokenizer=None) -> dict:
    """Plan an extraction run; writes ``plan``, ``runs`` and ``summary`` under ``out_dir``."""
    t0 = time.time()
    pairs = X.pairs(read_prompts(spark, prompt_files), read_completions(spark, completion_files), cfg)
    # the plan runs once: its narrow rows are written and counted, guard, plan file and summary take them from there
    planned, totals = X.observed_plan(X.sequences(pairs, cfg, system=system, tokenizer=tokenizer), cfg)
    K.write_plan(X.ordered_plan(X.keep_min_length(planned, cfg.min_tokens)), f"{out_dir}/plan")
    K.write_run_rows(K.run_meta(spark, cfg), f"{out_dir}/runs")
    summary = X.with_rate(totals, elapsed_s=time.time() - t0)
    K.write_run_rows(summary, f"{out_dir}/summary")
    return summary.first().asDict()


def sequence_order() -> F.Column:
    """The order sequences are appended in: prompt, then rollout (a pair, so no number can overflow or collide)."""
    return F.struct("prompt_id", "completion_idx")


def shard_index(stored: DataFrame, cfg: RunConfig, d_model: int, sharding: str) -> DataFrame:
    """Index rows of a stored run: run_id, shard, layer, prompt_id, completion_idx, start, n_tokens, append_ord.

    ``rotate``: shards ``shard_0000``, ``shard_0001``, ... close when a sequence (all its layers) brings them to
    ``cfg.shard_bytes`` (K7). ``replica``: one shard ``shard_dp00``, ... for each data-parallel replica (K8).
    """
    if sharding not in ("rotate", "replica"):
        raise GuardError(f"unknown sharding {sharding!r}")
    key = ["prompt_id", "completion_idx"]
    group = ["run_id", "layer", *key] + (["dp_rank"] if sharding == "replica" else [])
    seqs = L.sequence_lengths(stored, group).withColumn("append_ord", sequence_order())
    if sharding == "replica":
        seqs = seqs.withColumn("shard", F.format_string(REPLICA_DIR, F.col("dp_rank"))).drop("dp_rank")
    else:
        token = d_model * cfg.bytes_per_elem + (4 if cfg.dtype == "int8" else 0)
        whole = seqs.groupBy("run_id", *key).agg((F.sum("n_tokens") * token).cast("bigint").alias("n_bytes")) \
            .withColumn("append_ord", sequence_order())
        shards = L.assign_shards(whole, cfg.shard_bytes, "append_ord", partition=("run_id",))
        seqs = seqs.join(shards.select("run_id", *key, F.format_string(SHARD_DIR, F.col("shard")).alias("shard")), ["run_id", *key])
    return L.index_offsets(seqs, "append_ord", partition=("run_id", "shard", "layer"))


def ingest_job(spark: SparkSession, capture_path: str, cfg: RunConfig, out_dir: str, d_model: int,
               stream: bool = False, checkpoint: str | None = None, max_files_per_trigger: int = 64,
               sharding: str = "rotate", dedup: bool = True) -> dict:
    """Store captured batches as ``activations`` with index, manifest, replica markers, run metadata and summary.

    Each run has its own root ``out_dir/activations/<run_id>`` (partitioned by
    ``run_id, layer``, sorted by sequence). A streamed run is first appended by the stream under
    ``out_dir/incoming/<run_id>`` (exactly-once through ``checkpoint``, resumable) and, when the stream has ended, rewritten
    sorted like a batch run. Vectors of another length than ``d_model`` fail the encoder. ``dedup`` keeps one replica's copy
    of each token. Returns the summary row.
    """
    t0 = time.time()
    K.write_run_rows(K.run_meta(spark, cfg), f"{out_dir}/runs")
    batches = read_capture(spark, capture_path).select("batch_id", "gpu_id").distinct()
    K.write_run_rows(K.replica_markers(batches, cfg, d_model), f"{out_dir}/replicas")
    acts_path = f"{out_dir}/activations/{cfg.run_id}"
    if stream:
        if not checkpoint:
            raise ValueError("a streaming ingest needs a checkpoint location")
        incoming = f"{out_dir}/incoming/{cfg.run_id}"
        drain(start_ingest(capture_stream(spark, capture_path, max_files_per_trigger), cfg, incoming, checkpoint, d_model=d_model))
        acts = spark.read.parquet(incoming)
    else:
        acts = capture_to_activations(read_capture(spark, capture_path), cfg, d_model)
    K.write_activations(acts, acts_path, d_model, cfg.bytes_per_elem, mode="overwrite", validate=False, dedup=dedup)
    stored = spark.read.parquet(acts_path)
    if not dedup:
        K.check_unique_keys(stored.where("prompt_id >= 0"))
    index = shard_index(stored, cfg, d_model, sharding)
    index_path = f"{out_dir}/index/run_id={cfg.run_id}"
    K.write_index(index, index_path, mode="overwrite")
    written = spark.read.parquet(index_path)
    K.write_manifest(L.manifest(written, cfg.model, d_model, cfg.dtype), f"{out_dir}/manifest/run_id={cfg.run_id}")
    summary = written.agg(F.count_distinct("prompt_id", "completion_idx").alias("n_sequences"), F.sum("n_tokens").alias("tokens_all_layers"),
                          F.count_distinct("shard").alias("n_shards")).withColumn("run_id", F.lit(cfg.run_id)) \
        .withColumn("elapsed_s", F.lit(time.time() - t0))
    K.write_run_rows(summary, f"{out_dir}/summary")
    return summary.first().asDict()


def verify_job(spark: SparkSession, acts: DataFrame, d_model: int, index: DataFrame | None = None,
               k: int = 3) -> dict[str, DataFrame]:
    """Reconcile index and stored tokens, audit payloads, and the norm health of the
    first ``k`` sequences per layer."""
    if index is None:
        index = L.sequence_lengths(acts)
    idx = index if "append_ord" in index.columns else index.withColumn("append_ord", sequence_order())
    first = VF.first_k_sequences(idx, k, ("run_id", "layer"), "append_ord")
    sample = acts.join(first.select("run_id", "layer", "prompt_id", "completion_idx"),
                       ["run_id", "layer", "prompt_id", "completion_idx"], "left_semi")
    return {"reconcile": VF.reconcile(index, acts, d_model),
            "payloads": VF.payload_audit(acts, d_model),
            "norms": VF.norm_health(sample)}


def verify_legacy_job(spark: SparkSession, root: str, k: int = 3) -> dict[str, DataFrame]:
    """Read-back check of legacy shards: the file report, and the norm health of the first ``k`` sequences
    per (shard, layer), read from their files alone."""
    key = ("shard", "layer", "prompt_id", "completion_idx")
    first = VF.first_k_sequences(read_index(spark, root), k, ("shard", "layer"), "append_ord")
    rows = import_legacy(spark, root, strict=False, only=first.select(*key))
    return {"files": legacy_report(spark, root), "norms": VF.norm_health(rows, key)}


def compare_job(acts: DataFrame, run_a: str, run_b: str, layer: int, completion_idx: int = 0,
                prompt_ids=None, exclude_unparsed: bool = True) -> dict[str, DataFrame]:
    """The per-sequence report of two runs at one layer (keys present in both).

    Rows whose rid could not be parsed all share the fallback key
    ``prompt_id = -1``, so their token pairs would mix sequences; they are left
    out unless ``exclude_unparsed`` is False.
    """
    a = C.run_slice(acts, run_a, layer, completion_idx, prompt_ids)
    b = C.run_slice(acts, run_b, layer, completion_idx, prompt_ids)
    if exclude_unparsed:
        a, b = a.where(F.col("prompt_id") >= 0), b.where(F.col("prompt_id") >= 0)
    pairs = C.token_pairs(a, b)
    return {"keys": C.common_keys(a, b), "shapes": C.shapes(a, b), "metrics": C.pair_metrics(pairs),
            "positions": C.position_samples(pairs), "shift": C.shift_check(a, b),
            "drift": C.drift_by_position(pairs)}


def compare_legacy_job(spark: SparkSession, root_a: str, root_b: str, layer: int, completion_idx: int = 0,
                       prompt_ids=None) -> dict[str, DataFrame]:
    """``compare_job`` of two legacy shard roots. Only the layer's files are opened, and of them the sequences that are compared; each is
    checked where it is read."""
    where = {"layer": [layer], "completion_idx": [completion_idx]} | ({} if prompt_ids is None else {"prompt_id": prompt_ids})
    sides = [read_legacy(spark, root, where).withColumn("run_id", F.lit(name)).drop("shard") for name, root in (("a", root_a), ("b", root_b))]
    return compare_job(sides[0].unionByName(sides[1]), "a", "b", layer, completion_idx, prompt_ids)
