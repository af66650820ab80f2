"""Vector expressions: double arithmetic on array<float|double> columns, inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_FLOOR = 1e-8


def doubles(v) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a, b) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def plus(a, b, scale=1.0) -> Column:
    scale = scale if isinstance(scale, Column) else F.lit(scale)
    return F.zip_with(a, b, lambda x, y: x.cast("double") + scale * y.cast("double"))


def l2_normalised(v, floor: float = NORM_FLOOR) -> Column:
    """Unit length; vectors shorter than the floor are divided by the floor."""
    # the norm stands beside the lambda, not in it: there it would be computed again for every element
    size = F.greatest(F.sqrt(dot(v, v)), F.lit(floor))
    return F.zip_with(v, F.array_repeat(size, F.size(v)), lambda x, n: x.cast("double") / n)


def median(v) -> Column:
    """Median of an array's values; null for an empty array."""
    s, n = F.array_sort(v), F.size(v)
    low, high = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def project(h, x, y) -> tuple[Column, Column]:
    """A point through a 3x3 homography given as array<double>[9], row by row."""
    at = lambda k: F.element_at(h, k + 1)
    w = at(6) * x + at(7) * y + at(8)
    return (at(0) * x + at(1) * y + at(2)) / w, (at(3) * x + at(4) * y + at(5)) / w
