"""Vector expressions over ARRAY<FLOAT> columns; the matrix product for large scans is in operators.nearest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles; vectors of different lengths are an error."""
    sizes = F.assert_true(F.size(a) == F.size(b), "vectors differ in length")
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(sizes.cast("double"), product)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column, eps: float = 1e-12) -> Column:
    """Unit length; a zero vector stays zero."""
    n = F.greatest(norm(v), F.lit(eps))
    return F.transform(v, lambda x: x.cast("double") / n)


def truncate_and_normalize(v: Column, dim: int) -> Column:
    """The first dim values, then unit length. The cut comes first: a prefix of a unit vector isn't one."""
    if dim <= 0:
        raise ValueError(f"dim must be positive: {dim}")
    fits = F.assert_true(F.size(v) >= dim, f"vector shorter than {dim}").cast("array<double>")
    return F.coalesce(fits, l2_normalize(F.slice(v, 1, dim)))


def is_unit(v: Column, tol: float = 1e-2) -> Column:
    """Unit or zero length, within tol."""
    n = norm(v)
    return (F.abs(n - 1) <= tol) | (n < tol)
