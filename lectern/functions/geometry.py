"""Rectangles as arrays ``[x0, y0, x1, y1]``, origin at the top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def union(a: Column, b: Column) -> Column:
    return F.array(F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3]))


def area(a: Column) -> Column:
    return F.greatest(F.lit(0.0), a[2] - a[0]) * F.greatest(F.lit(0.0), a[3] - a[1])


def overlap(a: Column, b: Column, pad: float = 0) -> Column:
    """Whether two rectangles touch within ``pad``."""
    return (a[2] >= b[0] - pad) & (b[2] >= a[0] - pad) & (a[3] >= b[1] - pad) & (b[3] >= a[1] - pad)


def height(a: Column) -> Column:
    return F.greatest(F.lit(1.0), a[3] - a[1])


def middle_x(a: Column) -> Column:
    return (a[0] + a[2]) / 2


def middle_y(a: Column) -> Column:
    return (a[1] + a[3]) / 2


def overlap_x(a: Column, b: Column) -> Column:
    """Shared width as a share of the narrower rectangle's."""
    shared = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    return shared / F.least(F.greatest(F.lit(1.0), a[2] - a[0]), F.greatest(F.lit(1.0), b[2] - b[0]))


def padded(a: Column, pad: float, width: Column, height: Column) -> Column:
    """Grown by ``pad`` and kept on the page: what a crop shows."""
    return F.array(F.greatest(F.lit(0.0), a[0] - pad), F.greatest(F.lit(0.0), a[1] - pad), F.least(width, a[2] + pad), F.least(height, a[3] + pad))


def primitive_box(xs: Column, ys: Column) -> Column:
    """The box of a drawing primitive from its points' coordinates."""
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
