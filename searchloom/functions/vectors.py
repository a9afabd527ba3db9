"""Vector measures as columns of higher-order functions; all sums are in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def _col(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def literal(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product; null unless both have the same number of elements."""
    a, b = _col(a), _col(b)
    return F.when(F.size(a) == F.size(b), _sum(F.zip_with(a, b, lambda x, y: x * y)))


def norm(a: Column | str) -> Column:
    return F.sqrt(_sum(F.transform(_col(a), lambda x: x * x)))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 where a vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def l2_squared(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    return F.when(F.size(a) == F.size(b), _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def l1(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    return F.when(F.size(a) == F.size(b), _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y))))


#: By the names that scripts use.
FUNCTIONS = {"dotProduct": dot, "cosineSimilarity": cosine, "l1norm": l1, "l2norm": lambda a, b: F.sqrt(l2_squared(a, b))}


def similarity(kind: str, a: Column | str, b: Column | str) -> Column:
    """Score of a nearest-neighbour search: higher is closer."""
    if kind == "cosine":
        return (1 + cosine(a, b)) / 2
    if kind == "dot_product":
        return (1 + dot(a, b)) / 2
    if kind == "l2_norm":
        return 1 / (1 + l2_squared(a, b))
    raise ValueError(f"unknown similarity {kind}")


def quantize(a: Column | str, lowest: Column, highest: Column, bits: int = 8) -> Column:
    """Scalar quantization to ``bits`` bits between two bounds."""
    top = float((1 << bits) - 1)
    step = (highest - lowest) / top
    return F.transform(_col(a), lambda x: F.when(step == 0, F.lit(0.0)).otherwise(F.least(F.lit(top), F.greatest(F.lit(0.0), F.round((x - lowest) / step)))).cast("int"))


def dequantize(q: Column | str, lowest: Column, highest: Column, bits: int = 8) -> Column:
    step = (highest - lowest) / float((1 << bits) - 1)
    return F.transform(F.col(q) if isinstance(q, str) else q, lambda x: lowest + x * step)
