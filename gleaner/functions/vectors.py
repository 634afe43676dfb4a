"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x
    )


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(vector), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; zero when either side has no length."""
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length)


def unit(vector: Column) -> Column:
    """Vector scaled to length one; a zero vector stays as it is."""
    length = norm(vector)
    return F.transform(
        _doubles(vector), lambda x: x / F.when(length == 0, F.lit(1.0)).otherwise(length)
    )


def all_close(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """Same width and no element further apart than ``tolerance``."""
    near = F.forall(
        F.zip_with(_doubles(a), _doubles(b), lambda x, y: F.coalesce(
            F.abs(x - y) <= tolerance, F.lit(False)
        )),
        lambda ok: ok,
    )
    return (F.size(a) == F.size(b)) & near
