"""Similarity of two vectors as native columns, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(vector: str | Column) -> Column:
    return F.col(vector) if isinstance(vector, str) else vector


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def dot(a: str | Column, b: str | Column) -> Column:
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: str | Column) -> Column:
    return F.sqrt(_sum(F.transform(_col(a), lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: str | Column, b: str | Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """NULL for a NULL or zero vector. Norms computed beforehand may be passed in."""
    length = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return dot(a, b) / F.nullif(length, F.lit(0.0))


def similarity(a: str | Column, b: str | Column, metric: str = "cosine") -> Column:
    return {"cosine": cosine, "dot": dot}[metric](a, b)
