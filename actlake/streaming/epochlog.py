"""A log of small tables, one per trigger, that stays short.

Each trigger puts its rows once, under its epoch. ``FAN`` tables of one length that follow each other are merged into one, these
again, and so on, so after n triggers at most (FAN - 1) x log_FAN(n) tables are left and a row is rewritten log_FAN(n) times.
A table is written beside the log and renamed into it, so it is there whole or not at all. An epoch that a table of the log covers is
not put again: a replayed trigger changes nothing. What a merged table covers goes with the next put; until then readers pass it over.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import child_dirs, exists

FAN = 6
_NAME = re.compile(r"epochs-([0-9]+)-([0-9]+)")


class EpochLog:
    """``merge`` makes the rows of several tables those of one (same columns), e.g. sums by key."""

    def __init__(self, spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame], fan: int = FAN):
        if fan < 2:
            raise ValueError("fan must be at least 2")
        self.spark, self.path, self.merge, self.fan = spark, path.rstrip("/"), merge, fan

    def _fs(self, path: str):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf), p

    def _all(self) -> list[tuple[int, int, str]]:
        if not exists(self.spark, self.path):
            return []
        names = ((m, d) for d in child_dirs(self.spark, self.path) if (m := _NAME.fullmatch(d.rsplit("/", 1)[-1])))
        return sorted((int(m[1]), int(m[2]), d) for m, d in names)

    def tables(self) -> list[tuple[int, int, str]]:
        """(first epoch, last epoch, folder) of the tables that count, in order."""
        found = self._all()
        return [(a, z, d) for a, z, d in found if not any((x, y) != (a, z) and x <= a and z <= y for x, y, _ in found)]

    def _add(self, rows: DataFrame, first: int, last: int) -> None:
        made = f"{self.path}/_making-{uuid.uuid4().hex}"
        rows.coalesce(1).write.parquet(made)  # what one trigger, or a merge of few, leaves is small
        fs, source = self._fs(made)
        _, target = self._fs(f"{self.path}/epochs-{first:010d}-{last:010d}")
        if not fs.rename(source, target):
            raise OSError(f"{target.toString()} could not be put")

    def put(self, epoch: int, rows: DataFrame) -> bool:
        """Put the rows of an epoch, once; returns whether they were new. Epochs come in order."""
        counted = self.tables()
        for a, z, d in set(self._all()) - set(counted):
            fs, p = self._fs(d)
            fs.delete(p, True)
        new = not any(a <= epoch <= z for a, z, _ in counted)
        if new:
            self._add(self.merge(rows), epoch, epoch)
        length = self.fan
        while (epoch + 1) % length == 0:
            first = epoch + 1 - length
            parts = [d for a, z, d in self.tables() if first <= a and z <= epoch]
            if len(parts) > 1:
                self._add(self.merge(self.spark.read.parquet(*parts)), first, epoch)
            length *= self.fan
        return new

    def read(self) -> DataFrame:
        """The merged rows of all epochs. Read it again if a put removes a table meanwhile."""
        parts = [d for _, _, d in self.tables()]
        if not parts:
            raise FileNotFoundError(f"{self.path} holds no epoch")
        return self.merge(self.spark.read.parquet(*parts))
