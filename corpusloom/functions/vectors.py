"""Vector literals and cosine similarity as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import _col


def vector_literal(c: Column | str) -> Column:
    """``[v1,v2,...]`` text of a numeric array."""
    values = F.transform(_col(c), lambda x: x.cast("string"))
    return F.concat(F.lit("["), F.array_join(values, ","), F.lit("]"))


def parse_vector(c: Column | str) -> Column:
    """Inverse of :func:`vector_literal`."""
    return F.from_json(_col(c), "array<double>")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; null when the lengths differ or a vector has no length."""
    a, b = _col(a), _col(b)
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), _dot(a, b) / norms)
