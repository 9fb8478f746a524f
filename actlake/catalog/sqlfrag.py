"""DuckDB expression fragments shared by the oracle queries."""

from __future__ import annotations


def X(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def bf16(x: str) -> str:
    e = f"greatest(floor(log2(abs({X(x)}))), -126) - 7"
    return (f"CAST(CASE WHEN {x} = 0 OR isnan({x}) OR isinf({x}) THEN {X(x)} "
            f"ELSE round_even({X(x)} / pow(2, {e}), 0) * pow(2, {e}) END AS FLOAT)")


def fp8(x: str) -> str:
    e = f"greatest(floor(log2(abs({X(x)}))), -6) - 3"
    return (f"CAST(CASE WHEN isnan({x}) OR abs({X(x)}) > 464 THEN CAST('NaN' AS DOUBLE) "
            f"WHEN {x} = 0 THEN {X(x)} "
            f"ELSE round_even({X(x)} / pow(2, {e}), 0) * pow(2, {e}) END AS FLOAT)")


def bf16_vec(v: str) -> str:
    return vmap(v, bf16)


def fp8_vec(v: str) -> str:
    """float8 of the bf16 value."""
    return vmap(bf16_vec(v), fp8)


def int8_scale(v: str) -> str:
    return (f"CAST(CAST(greatest(list_max(list_transform({bf16_vec(v)}, lambda x: abs(x))), CAST(1e-8 AS FLOAT)) AS DOUBLE)"
            f" / 127.0 AS FLOAT)")


def int8_value(v: str, scale: str) -> str:
    code = (f"least(greatest(round_even(CAST(CAST(CAST(x AS DOUBLE) / CAST({scale} AS DOUBLE) AS FLOAT) AS DOUBLE), 0),"
            f" -128), 127)")
    return f"list_transform({bf16_vec(v)}, lambda x: CAST({code} * CAST({scale} AS DOUBLE) AS FLOAT))"


def vmap(v: str, fn) -> str:
    return f"list_transform({v}, lambda x: {fn('x')})"


def norm(v: str) -> str:
    return f"sqrt(list_sum(list_transform({v}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"


def vsum(v: str) -> str:
    return f"list_sum(list_transform({v}, lambda x: CAST(x AS DOUBLE)))"


def zipmap(a: str, b: str, fn) -> str:
    """Elementwise fn(x, y) over two lists of equal length."""
    return f"list_transform(list_zip({a}, {b}), lambda p: {fn('p[1]', 'p[2]')})"


def n_changed(a: str, b: str) -> str:
    return f"CAST(list_sum(list_transform(list_zip({a}, {b}), lambda p: CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END)) AS INT)"


def cosine(a: str, b: str) -> str:
    dot = f"list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
    return f"({dot} / (greatest({norm(a)}, 1e-8) * greatest({norm(b)}, 1e-8)))"


INT_RE = r"'^\s*[+-]?[0-9]+(_[0-9]+)*\s*$'"


def _part_int(part: str, to: str) -> str:
    cleaned = f"replace(regexp_replace({part}, '^\\s+|\\s+$', '', 'g'), '_', '')"
    return f"CASE WHEN regexp_matches({part}, {INT_RE}) THEN TRY_CAST({cleaned} AS {to}) END"


def rid_parts(rid: str, prefix: str) -> tuple[str, str]:
    """(prompt_id, completion_idx) of a rid with the fallback rule."""
    parts = f"string_split({rid}, '|')"
    pid = _part_int(f"{parts}[1]", "BIGINT")
    cidx = _part_int(f"{parts}[2]", "INTEGER")
    ok = f"({rid} IS NOT NULL AND len({parts}) = 2 AND ({pid}) IS NOT NULL AND ({cidx}) IS NOT NULL)"
    return (f"CASE WHEN {ok} THEN {pid} ELSE CAST(-1 AS BIGINT) END",
            f"CASE WHEN {ok} THEN {cidx} ELSE CAST({prefix} AS INTEGER) END")
