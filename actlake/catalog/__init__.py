"""Named queries over the stand-in tables, each with a DuckDB oracle where SQL can express it."""

from . import q_compare, q_docs, q_io, q_jobs, q_plan, q_vectors, q_verify  # noqa: F401
from .registry import QUERIES, Entry, query  # noqa: F401
