"""Planar geometry on columns and on arrays of points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .style import round_half_up


def in_box(x: Column, y: Column, bx: float, by: float, w: float, h: float) -> Column:
    """Half-open box [x, x+w) x [y, y+h)."""
    return (x >= bx) & (y >= by) & (x < bx + w) & (y < by + h)


def visible_rect(ox: Column, oy: Column, scale: Column, vw: float, vh: float, width: Column, height: Column) -> list[Column]:
    return [
        F.greatest(F.lit(0), F.floor(ox)).cast("bigint").alias("x0"),
        F.greatest(F.lit(0), F.floor(oy)).cast("bigint").alias("y0"),
        F.least(width, F.ceil(ox + F.lit(float(vw)) / scale)).cast("bigint").alias("x1"),
        F.least(height, F.ceil(oy + F.lit(float(vh)) / scale)).cast("bigint").alias("y1"),
    ]


def to_screen(x: Column, y: Column, ox: Column, oy: Column, scale: Column) -> tuple[Column, Column]:
    return (x - ox) * scale, (y - oy) * scale


def to_image(sx: Column, sy: Column, ox: Column, oy: Column, scale: Column) -> tuple[Column, Column]:
    return sx / scale + ox, sy / scale + oy


def polygon_area(points: Column) -> Column:
    z = F.zip_with(
        F.concat(F.slice(points, -1, 1), F.slice(points, 1, F.size(points) - 1)),
        points,
        lambda a, b: (a["x"] + b["x"]) * (a["y"] - b["y"]),
    )
    return F.abs(F.aggregate(z, F.lit(0.0), lambda s, v: s + v)) / 2


def bounds(points: Column) -> dict[str, Column]:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return {"min_x": F.array_min(xs), "min_y": F.array_min(ys), "max_x": F.array_max(xs), "max_y": F.array_max(ys)}


def crosses(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Does the ray from (x, y) to the right cross the edge a-b (even-odd rule)?"""
    return ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)


def in_polygon(x: Column, y: Column, points: Column) -> Column:
    """Even-odd test with the bounding-box prefilter; fewer than three points select nothing."""
    b = bounds(points)
    hits = F.zip_with(
        F.concat(F.slice(points, -1, 1), F.slice(points, 1, F.size(points) - 1)),
        points,
        lambda j, i: F.when(crosses(x, y, i["x"], i["y"], j["x"], j["y"]), 1).otherwise(0),
    )
    odd = F.aggregate(hits, F.lit(0), lambda s, v: s + v) % 2 == 1
    boxed = (x >= b["min_x"]) & (x <= b["max_x"]) & (y >= b["min_y"]) & (y <= b["max_y"])
    return (F.size(points) >= 3) & boxed & odd


def rect_points(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    x0, x1, y0, y1 = F.least(ax, bx), F.greatest(ax, bx), F.least(ay, by), F.greatest(ay, by)
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0, y1))


def clamp_point(p: Column, width: Column, height: Column) -> Column:
    """Inside the image, rounded to a tenth of a pixel."""
    r = lambda c, hi: round_half_up(F.least(F.greatest(c, F.lit(0.0)), hi) * 10) / 10
    return F.struct(r(p["x"], width).alias("x"), r(p["y"], height).alias("y"))


def too_small(points: Column, min_side: Column) -> Column:
    b = bounds(points)
    return (
        (F.size(points) < 3)
        | (b["max_x"] - b["min_x"] < min_side)
        | (b["max_y"] - b["min_y"] < min_side)
        | (polygon_area(points) < min_side * min_side * 0.25)
    )


def translate(points: Column, dx: Column, dy: Column) -> Column:
    return F.transform(points, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def box_to_original(min_x: Column, min_y: Column, max_x: Column, max_y: Column, scale: Column) -> list[Column]:
    """Original-px x, y, w, h of an inclusive analysis-px box."""
    return [min_x / scale, min_y / scale, (max_x - min_x + 1) / scale, (max_y - min_y + 1) / scale]


def analysis_scale(width: Column, height: Column, min_radius: Column, typical_radius: Column, max_pixels: Column) -> tuple[Column, Column]:
    """Scale and reason: radius target, else preliminary long side, capped (SCA15)."""
    cap = F.least(F.lit(1.0), F.sqrt(F.coalesce(max_pixels.cast("double"), F.lit(float("inf"))) / (width * height)))
    a = F.when(min_radius > 0, F.lit(4.0) / min_radius).otherwise(0.0)
    b = F.when(typical_radius > 0, F.lit(8.0) / typical_radius).otherwise(0.0)
    sized = F.coalesce(min_radius > 0, F.lit(False)) | F.coalesce(typical_radius > 0, F.lit(False))
    want = F.when(sized, F.greatest(a, b)).otherwise(F.lit(2048.0) / F.greatest(width, height))
    reason = (
        F.when(want >= cap, F.when(cap >= 1.0, "full-resolution").otherwise("pixel-cap"))
        .when(sized, "radius")
        .otherwise("preliminary")
    )
    return F.least(want, cap), reason
