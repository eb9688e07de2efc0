"""Crop, tile, box and rotation arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    if isinstance(c, str):
        return F.col(c)
    return c if isinstance(c, Column) else F.lit(c)


def clamp(c, low, high) -> Column:
    """Lower bound first, upper bound last, so the upper bound wins when they cross."""
    return F.least(F.greatest(_c(c), _c(low)), _c(high))


def primary_origin(rel, display, side, crop) -> Column:
    """Left (or top) edge of a crop centred on a display point, kept inside the image."""
    scale = _c(side).cast("double") / _c(display).cast("double")
    raw = F.floor((_c(rel) - _c(crop) / F.lit(2.0)) * scale).cast("int")
    return clamp(raw, F.lit(0), _c(side) - _c(crop)).cast("int")


def tile_side(side, per_side) -> Column:
    return F.greatest(F.lit(1), F.floor(_c(side) / _c(per_side)).cast("int"))


def inclusive_end(start, length) -> Column:
    return _c(start) + _c(length) - 1


def inside_image(x, y, w, h, image_w, image_h) -> Column:
    x, y, w, h = _c(x), _c(y), _c(w), _c(h)
    return (
        (w > 0) & (h > 0) & (x >= 0) & (y >= 0)
        & (x.cast("long") + w <= _c(image_w)) & (y.cast("long") + h <= _c(image_h))
    )


def coco_box(x1, y1, x2, y2, image_w, image_h, exact: bool = False) -> Column:
    """``ARRAY(x, y, w, h)``: corners put in order and clamped to the image.

    Width is x2 - x1 of inclusive corners; ``exact`` adds the missing pixel.
    """
    w = F.greatest(F.lit(1), _c(image_w)) - 1
    h = F.greatest(F.lit(1), _c(image_h)) - 1
    left, right = clamp(F.least(_c(x1), _c(x2)), 0, w), clamp(F.greatest(_c(x1), _c(x2)), 0, w)
    top, bottom = clamp(F.least(_c(y1), _c(y2)), 0, h), clamp(F.greatest(_c(y1), _c(y2)), 0, h)
    more = 1 if exact else 0
    return F.array(*[v.cast("int") for v in (left, top, right - left + more, bottom - top + more)])


def rotated_size(w, h, degrees) -> tuple[Column, Column]:
    """Bounding size of a rotated image, truncated to whole pixels."""
    s, c = F.abs(F.sin(F.radians(_c(degrees)))), F.abs(F.cos(F.radians(_c(degrees))))
    w, h = _c(w), _c(h)
    return (w * c + h * s).cast("int"), (w * s + h * c).cast("int")


def voxel_count(dim) -> Column:
    """Product of the used dimensions; element 0 holds how many are used."""
    d = _c(dim)
    used = F.slice(d, 2, d[0].cast("int"))
    return F.aggregate(used, F.lit(1).cast("long"), lambda acc, v: acc * v.cast("long"))


def to_world(row, i, j, k) -> Column:
    """One affine row ``[a, b, c, t]`` applied to a voxel index."""
    r = _c(row)
    return r[0] * _c(i) + r[1] * _c(j) + r[2] * _c(k) + r[3]


def voxel_to_world(i, j, k, rows: tuple | None = None) -> list[Column]:
    """World x, y, z; identity where the volume carries no affine rows."""
    index = [_c(i).cast("double"), _c(j).cast("double"), _c(k).cast("double")]
    if rows is None:
        return index
    return [F.when(_c(r).isNull(), plain).otherwise(to_world(r, i, j, k)) for r, plain in zip(rows, index)]


def intensity_curve(value, points: list[tuple[float, float]]) -> Column:
    """Piecewise-linear curve over [0, 1]; ``points`` are sorted control points."""
    v = clamp(_c(value), F.lit(0.0), F.lit(1.0))
    out = F.lit(float(points[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:]))):
        segment = F.lit(float(y0)) + (v - F.lit(float(x0))) / F.lit(float(x1 - x0)) * F.lit(float(y1 - y0))
        out = F.when(v <= F.lit(float(x1)), segment).otherwise(out)
    return out
