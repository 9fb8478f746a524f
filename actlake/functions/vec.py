"""Column -> Column vector maths on ``ARRAY<FLOAT>``.

All are Catalyst higher-order functions: they stay in the JVM, need no
Python worker and are optimised with the rest of the plan. Sums are done in
DOUBLE.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Guards used by the comparison metrics.
COS_EPS = 1e-8
REL_EPS = 1e-6


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sum_sq(v) -> Column:
    return F.aggregate(_c(v), F.lit(0.0).cast("double"),
                       lambda a, x: a + x.cast("double") * x.cast("double"))


def l2_norm(v) -> Column:
    """L2 norm of one token vector."""
    return F.sqrt(sum_sq(v))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, z: acc + z)


def cosine(a, b, eps: float = COS_EPS) -> Column:
    """Dot / (max(|a|, eps) * max(|b|, eps))."""
    return dot(a, b) / (F.greatest(l2_norm(a), F.lit(eps)) * F.greatest(l2_norm(b), F.lit(eps)))


def abs_err(a, b) -> Column:
    """Elementwise |a - b| (DOUBLE)."""
    return F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x.cast("double") - y.cast("double")))


def rel_err(a, b, eps: float = REL_EPS) -> Column:
    """Elementwise |a - b| / (|a| + eps) (DOUBLE)."""
    return F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x.cast("double") - y.cast("double"))
                      / (F.abs(x.cast("double")) + F.lit(eps)))


def array_sum(v) -> Column:
    return F.aggregate(_c(v), F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double"))


def array_max(v) -> Column:
    return F.aggregate(_c(v), F.lit(float("-inf")).cast("double"),
                       lambda a, x: F.greatest(a, x.cast("double")))


def vec_sub(b, a) -> Column:
    """Elementwise b - a (FLOAT)."""
    return F.zip_with(_c(b), _c(a), lambda y, x: y - x)


def vec_add(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def vec_scale(v, alpha: float) -> Column:
    return F.transform(_c(v), lambda x: (x * F.lit(alpha).cast("float")).cast("float"))
