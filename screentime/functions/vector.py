"""Vector and histogram maths on double arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Histogram layout and block weights, softmax temperatures.
N_L, N_H = 8, 12
W_L, W_H = 0.65, 0.35
TEMP_COLOR, TEMP_EMBEDDING = 8.0, 15.0


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    return _scaled(a, norm(a))


def _scaled(a: Column, size: Column) -> Column:
    """``a / (size + 1e-8)``, with the divisor evaluated once and not per element."""
    return F.zip_with(a, F.array_repeat(size + 1e-8, F.size(a)), lambda x, y: x / y)


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def hist_intersection(a: Column, b: Column) -> Column:
    low = F.zip_with(a, b, lambda x, y: F.least(x, y))
    return total(F.slice(low, 1, N_L)) * W_L + total(F.slice(low, N_L + 1, N_H)) * W_H


def luminance(color: Column) -> Column:
    block = F.slice(color, 1, N_L)
    weighted = F.transform(block, lambda x, i: x * (i + 0.5) / float(N_L))
    return total(weighted) / (total(block) + 1e-8)


def softmax(scores: Column) -> Column:
    powers = F.zip_with(scores, F.array_repeat(F.array_max(scores), F.size(scores)), lambda s, top: F.exp(s - top))
    return _scaled(powers, total(powers))
