"""Boxes and zones as plain column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_half(total: Column) -> Column:
    """Half of an integer, rounded down also below zero."""
    return F.shiftright(total, 1)


def bottom_center(x1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    return floor_half(x1 + x2), y2


def in_polygon(x: Column, y: Column, corners: Sequence[tuple[int, int]]) -> Column:
    """Whether an integer point lies in a polygon or on its edge: crossing parity of a ray, or on a side."""
    crossings, on_edge = F.lit(0), F.lit(False)
    for (ax, ay), (bx, by) in zip(corners, [*corners[1:], corners[0]], strict=True):
        cross = (x - ax) * (by - ay) - (y - ay) * (bx - ax)
        within = x.between(min(ax, bx), max(ax, bx)) & y.between(min(ay, by), max(ay, by))
        on_edge = on_edge | ((cross == 0) & within)
        if ay != by:
            spans = (y >= min(ay, by)) & (y < max(ay, by))
            left = cross < 0 if by > ay else cross > 0
            crossings = crossings + F.when(spans & left, 1).otherwise(0)
    return on_edge | (crossings % 2 == 1)


def clip(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> tuple[Column, Column, Column, Column]:
    """A box cut to its frame; all parts null where nothing is left."""
    a, b = F.greatest(x1, F.lit(0)), F.greatest(y1, F.lit(0))
    c, d = F.least(x2, width), F.least(y2, height)
    ok = (c > a) & (d > b)
    return F.when(ok, a), F.when(ok, b), F.when(ok, c), F.when(ok, d)


def clipped_at_border(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, margin: int) -> Column:
    """Whether a box comes within ``margin`` of its frame's border, so that what it holds may be cut off there."""
    return (x1 <= margin) | (y1 <= margin) | (x2 >= width - margin) | (y2 >= height - margin)


def expand(x1: Column, y1: Column, x2: Column, y2: Column, left: float, top: float, right: float, bottom: float) -> tuple[Column, Column, Column, Column]:
    """A box grown at each side by a share of its own width or height, cut toward zero to whole pixels."""
    w, h = x2 - x1, y2 - y1
    whole = lambda c: c.cast("bigint")
    return whole(x1 - w * left), whole(y1 - h * top), whole(x2 + w * right), whole(y2 + h * bottom)


def crop_bounds(x: Column, y: Column, width: Column, height: Column, frame_width: Column, frame_height: Column) -> Column:
    """Whether a crop at (x, y) of this size lies whole within its frame."""
    return (x >= 0) & (y >= 0) & (width > 0) & (height > 0) & (x + width <= frame_width) & (y + height <= frame_height)


def overlap(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Intersection over union of two boxes; 0 where neither has an area."""
    w = F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def center_inside(inner: Sequence[Column], outer: Sequence[Column]) -> Column:
    """Whether one box's centre lies in another, edges included."""
    cx, cy = (inner[0] + inner[2]) / 2, (inner[1] + inner[3]) / 2
    return cx.between(outer[0], outer[2]) & cy.between(outer[1], outer[3])


def center_distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    dx, dy = (a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2
    return F.sqrt(dx * dx + dy * dy)


def upper_part(inner: Sequence[Column], outer: Sequence[Column], low: float, high: float) -> Column:
    """Whether a box's centre lies in another between two shares of its height; false without height."""
    height = outer[3] - outer[1]
    share = ((inner[1] + inner[3]) / 2 - outer[1]) / F.when(height > 0, height)
    return F.coalesce(center_inside(inner, outer) & share.between(low, high), F.lit(False))


def angle_score(angle: Column, limit: float) -> Column:
    """1 straight on, 0 at the limit and beyond; null without an angle."""
    return F.when(angle.isNotNull(), F.greatest(F.lit(0.0), 1 - F.abs(angle) / limit))


def weighted_score(parts: Sequence[tuple[float, Column]]) -> Column:
    """The weighted sum of parts, held within 0 and 1, to 6 decimals."""
    total = sum((w * c for w, c in parts), F.lit(0.0))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 6)


def pose(yaw: Column, frontal: float) -> Column:
    known = yaw.isNotNull() & ~F.isnan(yaw)
    return F.when(~known, "unknown").when(F.abs(yaw) <= frontal, "frontal").when(yaw < -frontal, "left").otherwise("right")
