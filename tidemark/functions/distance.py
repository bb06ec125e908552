"""Distances between array columns, as column expressions in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.errors import InvalidArgument


def as_vector(value: Column | Sequence[float]) -> Column:
    """An array column as doubles, or a literal vector."""
    if isinstance(value, Column):
        return value.cast("array<double>")
    return F.array(*[F.lit(float(x)) for x in value])


def _total(a: Column, b: Column, term) -> Column:
    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda total, x: total + x)


def dot(a: Column, b: Column) -> Column:
    return _total(a, b, lambda x, y: x * y)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_total(a, b, lambda x, y: (x - y) * (x - y)))


def cosine(a: Column, b: Column) -> Column:
    """1 minus the cosine; null for a vector without length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, 1 - dot(a, b) / norms)


def negative_dot(a: Column, b: Column) -> Column:
    """So that the closest comes first, as with the others."""
    return -dot(a, b)


METRICS = {"l2": l2, "cosine": cosine, "ip": negative_dot}


def metric(name: str):
    if name not in METRICS:
        raise InvalidArgument(f"unknown metric {name!r}")
    return METRICS[name]
