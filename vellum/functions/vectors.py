"""Vector columns (V4-V9): norms, dots and cosine in double precision.

Spark 4.1 has no vector functions on `array<float>`, so these are
higher-order expressions (`aggregate`, `zip_with`).  They are the reference
definition used by single-query search and the checks; the batch search path
does the same arithmetic as an Arrow block product (see operators.search).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.text import _c


def _d(x: Column) -> Column:
    return x.cast("double")


def l2_norm(v) -> Column:
    """V4: sqrt of the sum of squares, accumulated in double."""
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0).cast("double"), lambda acc, x: acc + _d(x) * _d(x)))


def dot(a, b) -> Column:
    """V5: inner product in double."""
    prods = F.zip_with(_c(a), _c(b), lambda x, y: _d(x) * _d(y))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def cosine_similarity(a, b, on_mismatch: str = "error") -> Column:
    """V6: dot/(|a||b|); a zero norm gives 0; a length mismatch raises (or null)."""
    a, b = _c(a), _c(b)
    na, nb = l2_norm(a), l2_norm(b)
    bad = F.size(a) != F.size(b)
    mismatch = F.raise_error(F.lit("Vectors must have the same length")) if on_mismatch == "error" \
        else F.lit(None).cast("double")
    return (F.when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
            .when(bad, mismatch)
            .when((na == 0) | (nb == 0), F.lit(0.0))
            .otherwise(dot(a, b) / (na * nb)))


def cosine_distance(a, b) -> Column:
    """V7: 1 - cos; a zero norm (or a missing vector) gives distance 1."""
    a, b = _c(a), _c(b)
    na, nb = l2_norm(a), l2_norm(b)
    return (F.when(a.isNull() | b.isNull(), F.lit(1.0))
            .when((na == 0) | (nb == 0), F.lit(1.0))
            .otherwise(F.lit(1.0) - dot(a, b) / (na * nb)))


def to_float32(v) -> Column:
    """V8: the stored vector as 32-bit floats."""
    return _c(v).cast("array<float>")


def normalize(v) -> Column:
    """Unit-normalise; the zero vector stays zero."""
    v = _c(v)
    n = l2_norm(v)
    return F.when(n == 0, F.transform(v, lambda x: _d(x) * 0.0)).otherwise(F.transform(v, lambda x: _d(x) / n))


def dimension_ok(v, dim) -> Column:
    """Vector present, non-empty and of the index dimension."""
    v = _c(v)
    d = dim if isinstance(dim, Column) else F.lit(int(dim))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & (F.size(v) == d), F.lit(False))


def dimension_check(v, dim) -> Column:
    """V9 strict form: raise on a vector whose length differs from the index dimension."""
    if int(dim) <= 0:
        raise ValueError("index dimension must be a positive integer")
    return F.when(dimension_ok(v, dim), _c(v)).otherwise(
        F.raise_error(F.lit("Vector dimensions do not match index")))
