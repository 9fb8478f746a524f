"""Registry of named queries: a Spark job and, where SQL can say it, an oracle."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Entry:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    operators: str


QUERIES: dict[str, Entry] = {}


def query(name: str, operators: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Entry(name, fn, oracle, operators)
        return fn
    return deco
