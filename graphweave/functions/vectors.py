"""Vector arithmetic on arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null if either has no length or no direction."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def similarity(a: Column, b: Column, scale: str = "unit") -> Column:
    """Cosine, mapped to 0..1 on the scale "unit", as it is on "raw"."""
    if scale not in ("unit", "raw"):
        raise ValueError(scale)
    return (1 + cosine(a, b)) / 2 if scale == "unit" else cosine(a, b)
