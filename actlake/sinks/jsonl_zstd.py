"""JSON lines compressed with zstandard, as completion files come (S2): one file per task, named when its task has ended.

Spark reads ``.zst`` text but has no codec to write it, so this is a Python Data Source sink: a task compresses its lines as they
come, into an attempt file; the driver gives the files of the successful attempts their names in task order and removes the rest.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..session import qualified
from ..sources.legacy_reader import open_fs

FORMAT = "actlake_jsonl_zst"


@dataclass
class _File(WriterCommitMessage):
    attempt: str
    part: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options):
        self.root, self.mark, self.level = options["path"], options["mark"], int(options.get("level", 3))

    def write(self, iterator):
        import zstandard
        fs, base = open_fs(self.root)
        fs.create_dir(base, recursive=True)
        attempt = f"{base}/_{self.mark}-{uuid.uuid4().hex}"
        with fs.open_output_stream(attempt) as raw, zstandard.ZstdCompressor(level=self.level).stream_writer(raw, closefd=False) as out:
            for batch in iterator:
                lines = batch.column("value").to_pylist()
                if lines:
                    out.write(("\n".join(lines) + "\n").encode("utf-8"))
        return _File(attempt, TaskContext.get().partitionId())

    def commit(self, messages):
        fs, base = open_fs(self.root)
        for m in messages:
            if m:
                fs.move(m.attempt, f"{base}/part-{m.part:05d}.jsonl.zst")
        self.abort(())

    def abort(self, messages):
        from pyarrow import fs as pafs
        fs, base = open_fs(self.root)
        for i in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
            if i.base_name.startswith(f"_{self.mark}-"):
                fs.delete_file(i.path)


class JsonLinesZstd(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return "value string"

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def write_jsonl_zstd(df: DataFrame, path: str, level: int = 3) -> None:
    """The rows as ``part-NNNNN.jsonl.zst`` under a new folder, one file per partition in its order; null fields are left out."""
    spark = df.sparkSession
    spark.dataSource.register(JsonLinesZstd)
    (df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.format(FORMAT).option("mark", uuid.uuid4().hex).option("level", level)
     .mode("append").save(qualified(spark, path)))
