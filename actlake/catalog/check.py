"""Compare a registered query's Spark result with its DuckDB oracle."""

from __future__ import annotations

import math

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


EXACT = False


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (v if EXACT else round(v, 6))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), norm(x)) for k, x in v.items()))
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def duckdb_con(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(r):
    return tuple((x is None, str(type(x)), str(x)) for x in r)


def compare(spark, con, name: str, build, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    sdf = build(spark, sf_dir)
    cols = sorted(sdf.columns)
    srows = sorted((tuple(norm(r[c]) for c in cols) for r in sdf.collect()), key=_key)
    if sql is None:
        return True, f"{len(srows)} rows (no oracle)"
    rel = con.sql(sql)
    idx = {c: i for i, c in enumerate(rel.columns)}
    if sorted(rel.columns) != cols:
        return False, f"columns spark={cols} oracle={sorted(rel.columns)}"
    orows = sorted((tuple(norm(r[idx[c]]) for c in cols) for r in rel.fetchall()), key=_key)
    if srows == orows:
        return True, f"{len(srows)} rows"
    diff = [(a, b) for a, b in zip(srows, orows) if a != b][:3]
    return False, f"spark {len(srows)} rows, oracle {len(orows)} rows; first diffs {diff}"
