"""Bounding-box expressions. A box is four columns, y grows downward.

Several overlap measures differ only in what they divide by; each has its name.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @property
    def w(self) -> Column:
        return self.x1 - self.x0

    @property
    def h(self) -> Column:
        return self.y1 - self.y0

    @property
    def cx(self) -> Column:
        return (self.x0 + self.x1) / 2

    @property
    def cy(self) -> Column:
        return (self.y0 + self.y1) / 2

    def struct(self) -> Column:
        return F.struct(*[c.alias(n) for n, c in zip(self._fields, self)])


def box(alias: str | None = None) -> Box:
    return Box(*[F.col(f"{alias}.{n}" if alias else n) for n in Box._fields])


def area(a: Box) -> Column:
    return F.greatest(F.lit(0.0), a.w) * F.greatest(F.lit(0.0), a.h)


def overlap_box(a: Box, b: Box) -> Box:
    return Box(F.greatest(a.x0, b.x0), F.greatest(a.y0, b.y0), F.least(a.x1, b.x1), F.least(a.y1, b.y1))


def intersection(a: Box, b: Box) -> Column:
    """The common rectangle as a struct; null if it is empty."""
    c = overlap_box(a, b)
    return F.when((c.w > 0) & (c.h > 0), c.struct())


def intersection_area(a: Box, b: Box) -> Column:
    return area(overlap_box(a, b))


def share_of_first(a: Box, b: Box) -> Column:
    """Overlap over the first box's area; 0 for an empty first box."""
    return F.when(area(a) > 0, intersection_area(a, b) / area(a)).otherwise(0.0)


def iou(a: Box, b: Box) -> Column:
    inter = intersection_area(a, b)
    return F.when(inter > 0, inter / (area(a) + area(b) - inter)).otherwise(0.0)


def overlap_coefficient(a: Box, b: Box) -> Column:
    """Overlap over the smaller area, areas counting 1 at least."""
    return intersection_area(a, b) / F.least(F.greatest(F.lit(1.0), area(a)), F.greatest(F.lit(1.0), area(b)))


def union_box(a: Box, b: Box) -> Box:
    return Box(F.least(a.x0, b.x0), F.least(a.y0, b.y0), F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1))


def scaled(a: Box, sx: Column | float, sy: Column | float) -> Box:
    return Box(a.x0 * sx, a.y0 * sy, a.x1 * sx, a.y1 * sy)


def vertical_overlap(a: Box, b: Box) -> Column:
    return F.greatest(F.lit(0.0), F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0))


def horizontal_overlap(a: Box, b: Box) -> Column:
    return (a.x1 > b.x0) & (b.x1 > a.x0)


def centre_inside(inner: Box, outer: Box, pad: float = 0.0) -> Column:
    return inner.cx.between(outer.x0 - pad, outer.x1 + pad) & inner.cy.between(outer.y0 - pad, outer.y1 + pad)


def gap(a: Box, b: Box) -> Column:
    dx = F.greatest(F.lit(0.0), F.greatest(a.x0, b.x0) - F.least(a.x1, b.x1))
    dy = F.greatest(F.lit(0.0), F.greatest(a.y0, b.y0) - F.least(a.y1, b.y1))
    return F.greatest(dx, dy)


def near(a: Box, b: Box, within: float) -> Column:
    """Boxes that touch once one of them is grown by `within`, edges included."""
    return (a.x0 - within <= b.x1) & (b.x0 <= a.x1 + within) & (a.y0 - within <= b.y1) & (b.y0 <= a.y1 + within)


def touching(a: Box, b: Box) -> Column:
    return near(a, b, 0.0)


def clamped(a: Box, w: float, h: float) -> Box:
    def into(c: Column, top: float) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(top), c))

    return Box(into(a.x0, w), into(a.y0, h), into(a.x1, w), into(a.y1, h))


def pixels(a: Box, sx: float, sy: float, pad: int, w: int, h: int) -> Box:
    """Whole pixels: floor at the near edges, ceiling at the far ones, padded and clamped."""

    def into(c: Column, top: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(top), c)).cast("int")

    return Box(into(F.floor(a.x0 * sx) - pad, w), into(F.floor(a.y0 * sy) - pad, h), into(F.ceil(a.x1 * sx) + pad, w), into(F.ceil(a.y1 * sy) + pad, h))


def emu(a: Box, sx: float = 1.0, sy: float = 1.0) -> list[Column]:
    """Left, top, width and height in English Metric Units, 12700 to a point."""
    return [F.floor(c * 12700 + 0.5).cast("long") for c in (a.x0 * sx, a.y0 * sy, F.greatest(F.lit(0.0), a.w) * sx, F.greatest(F.lit(0.0), a.h) * sy)]


def baseline(a: Box, font: Column) -> Column:
    return a.y0 + F.lit(0.85) * F.greatest(font, F.lit(1.0))


def font_from_height(a: Box) -> Column:
    return F.greatest(F.lit(6.0), F.lit(0.75) * a.h)


def polygon_box(points: Column) -> Box:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return Box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def closed_loop(points: Column, tol: float = 1.5) -> Column:
    a, b = F.element_at(points, 1), F.element_at(points, -1)
    return (F.size(points) >= 3) & (F.hypot(a["x"] - b["x"], a["y"] - b["y"]) <= tol)


def without_repeats(points: Column) -> Column:
    """Points that differ from the one before."""
    return F.filter(points, lambda p, i: (i == 0) | (p != F.element_at(points, F.greatest(i, F.lit(1)).cast("int"))))


def distinct_points(points: Column, tol: float) -> Column:
    """Points farther than tol, on an axis, from all points kept before them."""
    start = F.slice(points, 1, 0)

    def step(kept: Column, p: Column) -> Column:
        close = F.exists(kept, lambda k: (F.abs(k["x"] - p["x"]) <= tol) & (F.abs(k["y"] - p["y"]) <= tol))
        return F.when(close, kept).otherwise(F.array_append(kept, p))

    return F.aggregate(points, start, step)


def prefix_sums(sizes: Column) -> Column:
    """[0, s1, s1 + s2, ...]"""
    return F.transform(F.sequence(F.lit(0), F.size(sizes)), lambda n: F.aggregate(F.slice(sizes, 1, n), F.lit(0.0), lambda a, x: a + x))


def line_boxes(a: Box, n: Column) -> Column:
    """n equal slices of the height, top to bottom."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((a.y0 + a.h * i / n).alias("y0"), (a.y0 + a.h * (i + 1) / n).alias("y1")))


ASPECTS = [("1:1", 1.0), ("4:3", 4 / 3), ("3:4", 0.75), ("16:9", 16 / 9), ("9:16", 9 / 16), ("3:2", 1.5), ("2:3", 2 / 3), ("21:9", 21 / 9)]


def closest_aspect(w: Column, h: Column, ratios: list = ASPECTS) -> Column:
    """The label of the nearest ratio by logarithm; the first of equals; 1:1 without a size."""
    target = w / F.when(h > 0, h)
    off = F.array(*[F.struct(F.round(F.abs(F.ln(target / F.lit(r))), 9).alias("off"), F.lit(i).alias("i"), F.lit(n).alias("label")) for i, (n, r) in enumerate(ratios)])
    return F.when((w > 0) & (h > 0), F.array_min(off)["label"]).otherwise("1:1")


def aspect_pad(w: Column, h: Column, ratio: Column) -> list[Column]:
    """(left, top, padded width, padded height): the smaller padding that reaches the ratio."""
    tall = w / h > ratio
    new_w = F.when(tall, w).otherwise(F.ceil(h * ratio)).cast("long")
    new_h = F.when(tall, F.ceil(w / ratio)).otherwise(h).cast("long")
    return [F.floor((new_w - w) / 2).cast("long"), F.floor((new_h - h) / 2).cast("long"), new_w, new_h]
