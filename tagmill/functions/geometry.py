"""Rectangles as four columns x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Rect = tuple[Column, Column, Column, Column]


def rect(prefix: str = "") -> Rect:
    return tuple(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1"))


def area(a: Rect) -> Column:
    return F.greatest(a[2] - a[0], F.lit(0.0)) * F.greatest(a[3] - a[1], F.lit(0.0))


def overlap_area(a: Rect, b: Rect) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def overlap_ratio(a: Rect, b: Rect) -> Column:
    """Overlap over the smaller area, 0 where that is 0."""
    least = F.least(area(a), area(b))
    return F.when(least > 0, overlap_area(a, b) / least).otherwise(0.0)


def contained(inner: Rect, outer: Rect, share: float = 0.9) -> Column:
    return (area(inner) > 0) & (overlap_area(inner, outer) >= share * area(inner))


def touching(a: Rect, b: Rect) -> Column:
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def distance(a: Rect, b: Rect) -> Column:
    dx = F.greatest(a[0] - b[2], b[0] - a[2], F.lit(0.0))
    dy = F.greatest(a[1] - b[3], b[1] - a[3], F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def centre(a: Rect) -> tuple[Column, Column]:
    return (a[0] + a[2]) / 2, (a[1] + a[3]) / 2


def direction(a: Rect, b: Rect) -> Column:
    """Where b lies from a, along the longer way; as long both ways counts as vertical."""
    dx, dy = centre(b)[0] - centre(a)[0], centre(b)[1] - centre(a)[1]
    return F.when(F.abs(dx) > F.abs(dy), F.when(dx > 0, "LR").otherwise("RL")).otherwise(F.when(dy > 0, "TB").otherwise("BT"))


def intersection(a: Rect, b: Rect) -> Column:
    """Array of the four sides of what both cover; zeros if that is nothing."""
    sides = F.array(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))
    empty = (F.greatest(a[0], b[0]) >= F.least(a[2], b[2])) | (F.greatest(a[1], b[1]) >= F.least(a[3], b[3]))
    return F.when(empty, F.array(*[F.lit(0.0)] * 4)).otherwise(sides)


def aligned(a: Rect, b: Rect, axis: int, threshold: float = 3.0) -> Column:
    """Whether centres lie within threshold on an axis: 1 (height) for boxes beside each other, 0 for boxes below each other."""
    return F.abs((a[axis] + a[axis + 2]) / 2 - (b[axis] + b[axis + 2]) / 2) <= threshold


def normalised(a: Rect, width: Column, height: Column) -> list[Column]:
    """The sides as shares of the page."""
    return [a[0] / width, a[1] / height, a[2] / width, a[3] / height]


def is_background(a: Rect, width: Column, height: Column) -> Column:
    """Whether a picture covers over 0.8 of its page, or over 0.1 with its centre near the page's."""
    cover = area(a) / (width * height)
    near = (F.abs((a[0] + a[2]) / 2 - width / 2) < 0.2 * width) & (F.abs((a[1] + a[3]) / 2 - height / 2) < 0.2 * height)
    return (cover > 0.8) | (near & (cover > 0.1))


def denormalised(a: Rect, width: Column, height: Column) -> list[Column]:
    """A box in shares of a page as one in its units."""
    return [a[0] * width, a[1] * height, a[2] * width, a[3] * height]
