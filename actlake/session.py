"""Spark session and shared-folder helpers.

The library never creates its own cluster settings beyond what a job needs:
adaptive execution on (runtime coalescing, skew splitting, broadcast
conversion from exact map-side statistics), the Spark UI off, and a
checkpoint folder taken from ``spark.checkpoint.dir`` when the cluster names
one. A local folder is chosen only when that setting is absent (tests).
"""

from __future__ import annotations

import contextlib
import contextvars
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.driver.memory": "8g",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Vectors are wide rows: keep Arrow batches bounded by bytes, not only rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}

# Settings every job of this library relies on; applied to any session it is given.
# A join keyed on (sequence, token) may reuse a partitioning on the sequence key:
# one sequence is bounded by max_tokens, so this adds no skew and saves a shuffle
# of the vector rows per operator.
JOB_CONF = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # Wide vector rows: bound each Arrow batch handed to numpy (4,096 x 20 KB at d = 5,120).
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "actlake", extra: dict | None = None) -> SparkSession:
    """Return the active session or build one with the library defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Ship this package to the executors' Python workers (``addPyFile``).

    The zip is written once per application into the shared checkpoint
    folder; Spark distributes it to every executor.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import io
    import zipfile

    from pyarrow import fs as pafs
    pkg = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    base = spark.conf.get("spark.checkpoint.dir").rstrip("/")
    target = qualified(spark, f"{base}/actlake-pkg/{app}-{uuid.uuid4().hex[:8]}/actlake.zip")
    if target.startswith("file:"):
        fs, path = pafs.LocalFileSystem(), local_path(target)
    else:
        fs, path = pafs.FileSystem.from_uri(target)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(buf.getvalue())
    sc.addPyFile(path if target.startswith("file:") else target)
    _SHIPPED.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    Reads ``spark.checkpoint.dir``; only when it is unset and the master is
    ``local[...]`` (one process) a fresh folder under the system temp dir is
    set. On a cluster an unset folder is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share: "
                               f"a local folder serves only a local master, not {master!r}")
        d = tempfile.mkdtemp(prefix="actlake-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    for k, v in JOB_CONF.items():
        spark.conf.set(k, v)
    try:
        sc = spark.sparkContext
    except Exception:  # a remote (Connect) session: the server owns the context and Python path
        return d
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    ship_package(spark)
    return d


def _scratch_root(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/actlake/{spark.sparkContext.applicationId}"


_SCOPE = contextvars.ContextVar("scratch_scope", default="")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared checkpoint folder for a written table."""
    return f"{_scratch_root(spark)}/{_SCOPE.get()}{name}-{uuid.uuid4().hex[:12]}"


def _remove(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


@contextlib.contextmanager
def scratch_scope(spark: SparkSession, name: str) -> Iterator[None]:
    """Every ``scratch_path`` asked for in the block is removed at its end; nothing may read those tables later."""
    path = scratch_path(spark, name)
    mark = _SCOPE.set(f"{_SCOPE.get()}{path.rsplit('/', 1)[1]}/")
    try:
        yield
    finally:
        _SCOPE.reset(mark)
        _remove(spark, path)


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files and broadcasts of DataFrames that are no longer referred to: it does so when the driver's
    JVM collects its garbage, which may be long after."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def clear_scratch(spark: SparkSession) -> None:
    """Remove every table this application has written under ``scratch_path``. Results that still read them
    must have been written or collected before."""
    _remove(spark, _scratch_root(spark))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it again.

    The table replaces the lineage (an executor's loss costs no recomputation), what reads it
    may read it twice, and its columns are pruned and pushed down like those of any table.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with scheme and authority, as the session's default file system resolves it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).makeQualified(p).toString()


def child_dirs(spark: SparkSession, path: str) -> list[str]:
    """Qualified names of the folders directly under ``path``, sorted; hidden ones are left out."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(conf).listStatus(p)
    return sorted(s.getPath().toString() for s in found
                  if s.isDirectory() and not s.getPath().getName().startswith(("_", ".")))


def exists(spark: SparkSession, path: str) -> bool:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(conf).exists(p))


def local_path(p: str) -> str:
    """Strip a ``file:`` scheme for local file APIs."""
    if p.startswith("file:"):
        p = p[5:]
        while p.startswith("//"):
            p = p[1:]
    return os.path.abspath(p)
