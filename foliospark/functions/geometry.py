"""Box and quad expressions: plain Column arithmetic, no UDF."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, functions as F

SIDES = ("x1", "y1", "x2", "y2")


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column


def box(prefix: str = "") -> Box:
    return Box(*(F.col(prefix + side) for side in SIDES))


def truncated(b: Box) -> Box:
    return Box(*(v.cast("int") for v in b))


def area(b: Box) -> Column:
    return (b.x2 - b.x1) * (b.y2 - b.y1)


def center_x(b: Box) -> Column:
    return (b.x1 + b.x2) / 2.0


def center_y(b: Box) -> Column:
    return (b.y1 + b.y2) / 2.0


def _inter_sides(a: Box, b: Box) -> tuple[Column, Column]:
    width = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    height = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return width, height


def _clipped(b: Box) -> Column:
    zero = F.lit(0)
    return F.greatest(zero, b.x2 - b.x1) * F.greatest(zero, b.y2 - b.y1)


def box_iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0.0 without a positive overlap."""
    w, h = _inter_sides(a, b)
    union = _clipped(a) + _clipped(b) - w * h
    return F.when((w > 0) & (h > 0) & (union > 0), w * h / union).otherwise(F.lit(0.0))


def box_overlap_ratio(a: Box, b: Box) -> Column:
    """Intersection (on truncated coordinates) over the area of `b`."""
    w, h = _inter_sides(truncated(a), truncated(b))
    size = area(b)
    return F.when((w > 0) & (h > 0) & (size != 0), w * h / size).otherwise(F.lit(0.0))


def box_overlap_first(a: Box, b: Box) -> Column:
    """Intersection over the area of `a`."""
    w, h = _inter_sides(a, b)
    size = area(a)
    return F.when((w >= 0) & (h >= 0) & (size != 0), w * h / size).otherwise(F.lit(0.0))


def is_contained(outer: Box, inner: Box, thr: float = 0.8) -> Column:
    """Strictly more than `thr` of `inner` lies in `outer`."""
    return box_overlap_ratio(outer, inner) > F.lit(float(thr))


def intersects_h(a: Box, b: Box, thr: float = 0.5) -> Column:
    """Overlap in y is at least `thr` of the smaller height; a flat box never matches."""
    a, b = truncated(a), truncated(b)
    low = F.least(a.y2 - a.y1, b.y2 - b.y1)
    overlap = F.greatest(F.lit(0), F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))
    return F.when(low != 0, overlap / low >= F.lit(float(thr))).otherwise(F.lit(False))


def intersects_v(a: Box, b: Box) -> Column:
    a, b = truncated(a), truncated(b)
    return F.least(a.x2, b.x2) > F.greatest(a.x1, b.x1)


def quad_to_box(quad: Column) -> Box:
    xs = F.transform(quad, lambda p: p[0])
    ys = F.transform(quad, lambda p: p[1])
    return Box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def quad_of_box(b: Box) -> Column:
    point = F.array
    return F.array(point(b.x1, b.y1), point(b.x2, b.y1), point(b.x2, b.y2), point(b.x1, b.y2))


def _quad_sides(quad: Column) -> tuple[Column, Column]:
    def dist(i: int, j: int) -> Column:
        p, q = quad[i], quad[j]
        return F.sqrt(F.pow(p[0] - q[0], 2) + F.pow(p[1] - q[1], 2))

    return dist(0, 1), dist(1, 2)


def word_direction(quad: Column, aspect: float = 2.0) -> Column:
    width, height = _quad_sides(quad)
    return F.when(height > width * F.lit(aspect), F.lit("vertical")).otherwise(F.lit("horizontal"))


def is_noise_quad(quad: Column, px: float = 15.0) -> Column:
    width, height = _quad_sides(quad)
    return (width < px) | (height < px)


def box_convert(b: Box, src: str, dst: str, w: Column | None = None, h: Column | None = None) -> Box:
    """Between xyxy, xywh and cxcywh (the last one normalised by the page size, 6 decimals on output)."""
    if src == "xywh":
        xyxy = Box(b.x1, b.y1, b.x1 + b.x2, b.y1 + b.y2)
    elif src == "cxcywh":
        xyxy = Box(
            (b.x1 - b.x2 / 2) * w,
            (b.y1 - b.y2 / 2) * h,
            (b.x1 + b.x2 / 2) * w,
            (b.y1 + b.y2 / 2) * h,
        )
    elif src == "xyxy":
        xyxy = b
    else:
        raise ValueError(f"unknown box format {src}")
    if dst == "xyxy":
        return xyxy
    width, height = xyxy.x2 - xyxy.x1, xyxy.y2 - xyxy.y1
    if dst == "xywh":
        return Box(xyxy.x1, xyxy.y1, width, height)
    if dst == "cxcywh":
        return Box(
            F.round((xyxy.x1 + xyxy.x2) / 2.0 / w, 6),
            F.round((xyxy.y1 + xyxy.y2) / 2.0 / h, 6),
            F.round(width / w, 6),
            F.round(height / h, 6),
        )
    raise ValueError(f"unknown box format {dst}")


def clamp_box(b: Box, w: Column, h: Column) -> Box:
    """Inside the page, at least one pixel wide and high."""
    def clip(v: Column, lo: Column, hi: Column) -> Column:
        return F.greatest(lo, F.least(v, hi))

    x1 = clip(b.x1.cast("int"), F.lit(0), (w - 1).cast("int"))
    y1 = clip(b.y1.cast("int"), F.lit(0), (h - 1).cast("int"))
    x2 = clip(b.x2.cast("int"), F.lit(0), w.cast("int"))
    y2 = clip(b.y2.cast("int"), F.lit(0), h.cast("int"))
    return Box(x1, y1, F.greatest(x2, x1 + 1), F.greatest(y2, y1 + 1))


def flip_y(b: Box, h: Column) -> Box:
    """Between a bottom-left and a top-left origin."""
    return Box(b.x1, h - b.y2, b.x2, h - b.y1)
