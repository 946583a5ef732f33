"""Vector and score functions as column expressions. Vectors are cast to doubles before arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a norm is zero."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(F.lit(0.0))


def quantize(v: Column, bits: int) -> Column:
    """Levels 0 .. 2^bits - 1 of components in [-1, 1]."""
    top = (1 << bits) - 1
    return F.transform(_d(v), lambda x: F.floor(F.least(F.greatest((x + 1) / 2, F.lit(0.0)), F.lit(1.0)) * top + 0.5).cast("int"))


def dequantize(levels: Column, bits: int) -> Column:
    top = (1 << bits) - 1
    return F.transform(levels, lambda q: q / F.lit(float(top)) * 2 - 1)


def quantized_size(dim: Column | int, bits: int, residual: bool = True) -> Column:
    """Bytes of a packed vector, with one more bit per component for the residual's sign."""
    d = F.lit(dim) if isinstance(dim, int) else dim
    out = F.ceil(d * bits / 8)
    return (out + F.ceil(d / 8) if residual else out).cast("long")


def saturate(value: Column, ceiling: float) -> Column:
    """0 to 1, linear up to ``ceiling``."""
    return F.least(F.greatest(value.cast("double") / ceiling, F.lit(0.0)), F.lit(1.0))


def ramp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest((value.cast("double") - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def noisy_or(total: Column, scale: float = 3.5) -> Column:
    """Weights that sum to ``total`` as a probability that any holds."""
    return F.lit(1.0) - F.exp(-total / scale)


def percentage(part: Column, whole: Column) -> Column:
    """With one decimal; 0 of nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part.cast("double") / whole * 1000) / 10)


def index_percentile(values: Column, p: float) -> Column:
    """Of an array: the element at index floor(n * p) of its ascending order; null if it is empty."""
    return F.get(F.array_sort(values), F.least(F.floor(F.size(values) * p), F.size(values) - 1).cast("int"))
