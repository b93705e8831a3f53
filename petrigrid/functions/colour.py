"""Colour arithmetic on pixel columns (sRGB 0..255)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LUMA = (0.2126, 0.7152, 0.0722)
MIN_AXIS = 6.0
RIM_LEVEL = 0.3
GRID = 33


def linear(v: Column) -> Column:
    c = v.cast("double") / 255
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def _f(t: Column) -> Column:
    return F.when(t > 216 / 24389, F.cbrt(t)).otherwise((t * (24389 / 27) + 16) / 116)


def with_lab(df: DataFrame, r: Column, g: Column, b: Column, out: str = "lab") -> DataFrame:
    """Add CIE L*a*b* (D65) as a struct column.

    Built in stages, so that each power and cube root is computed once per row.
    """
    keep = df.columns
    lin = df.withColumns({"_r": linear(r), "_g": linear(g), "_b": linear(b)})
    R, G, B = F.col("_r"), F.col("_g"), F.col("_b")
    xyz = lin.withColumns(
        {
            "_x": (R * 0.4124564 + G * 0.3575761 + B * 0.1804375) / 0.95047,
            "_y": R * 0.2126729 + G * 0.7151522 + B * 0.072175,
            "_z": (R * 0.0193339 + G * 0.119192 + B * 0.9503041) / 1.08883,
        }
    )
    f = xyz.withColumns({"_x": _f(F.col("_x")), "_y": _f(F.col("_y")), "_z": _f(F.col("_z"))})
    x, y, z = F.col("_x"), F.col("_y"), F.col("_z")
    return f.select(*keep, F.struct((y * 116 - 16).alias("l"), ((x - y) * 500).alias("a"), ((y - z) * 200).alias("b")).alias(out))


def lab_distance(p: Column, q: Column) -> Column:
    return F.sqrt(sum((p[k] - q[k]) * (p[k] - q[k]) for k in ("l", "a", "b")))


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * LUMA[0] + g * LUMA[1] + b * LUMA[2]


def saturated(r: Column, g: Column, b: Column, level: int = 250) -> Column:
    return (r >= level) | (g >= level) | (b >= level)


def to_byte(v: Column) -> Column:
    return F.when(v <= 0, 0).when(v >= 255, 255).otherwise(F.floor(v + 0.5)).cast("int")


def channel_matrix(channel: str, saturation: float = 1.0) -> list[float]:
    wr, wg, wb = LUMA
    one = {"red": [1, 0, 0], "green": [0, 1, 0], "blue": [0, 0, 1]}
    if channel in one:
        return [float(v) for v in one[channel] * 3]
    if channel in ("luma", "centre"):
        return [wr, wg, wb] * 3
    s, k = saturation, 1 - saturation
    if s == 1:
        return [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    return [k * wr + s, k * wg, k * wb, k * wr, k * wg + s, k * wb, k * wr, k * wg, k * wb + s]


def apply_matrix(m: list[float], r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    row = lambda i: to_byte(r * m[i] + g * m[i + 1] + b * m[i + 2])
    return row(0), row(3), row(6)


def transfer(v: Column, lo: Column, hi: Column, brightness: Column, contrast: Column, gamma: Column, invert: Column) -> Column:
    """Stretch, brightness, contrast, clamp, gamma, invert: one byte in, one byte out."""
    span = F.when(hi > lo, hi - lo).otherwise(255.0)
    a = (v - F.when(hi > lo, lo).otherwise(F.coalesce(lo, F.lit(0.0)))) / span
    a = a + brightness / 2
    a = (a - 0.5) * F.pow(F.lit(2.0), contrast * 2) + 0.5
    a = F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))
    a = F.when(gamma == 1, a).otherwise(F.pow(a, F.lit(1.0) / gamma))
    a = F.when(invert, F.lit(1.0) - a).otherwise(a)
    return F.floor(a * 255 + 0.5).cast("int")


def centre_tone(t: Column, k: Column) -> Column:
    """Two logistic steps: background to rim level, rim to centre."""
    lo = F.lit(1.0) / (F.exp(-k * (t + 0.5)) + 1)
    hi = F.lit(1.0) / (F.exp(-k * (t - 0.5)) + 1)
    return lo * RIM_LEVEL + hi * (1 - RIM_LEVEL)


def with_axis(df: DataFrame, centre: str, rim: str, out: str = "axis") -> DataFrame:
    """Describe the axis from Lab struct ``rim`` to ``centre``: unit direction, midpoint, span >= 6."""
    k3 = ("l", "a", "b")
    d = df.withColumn("_d", F.struct(*[(F.col(centre)[k] - F.col(rim)[k]).alias(k) for k in k3]))
    d = d.withColumn("_n", F.sqrt(sum(F.col("_d")[k] * F.col("_d")[k] for k in k3)))
    same = F.col("_n") < 1e-6
    unit = [F.when(same, 1.0 if k == "l" else 0.0).otherwise(F.col("_d")[k] / F.col("_n")).alias("u" + k) for k in k3]
    mid = [((F.col(centre)[k] + F.col(rim)[k]) / 2).alias("m" + k) for k in k3]
    span = F.greatest(F.when(same, 1.0).otherwise(F.col("_n")), F.lit(MIN_AXIS)).alias("span")
    return d.withColumn(out, F.struct(*unit, *mid, span)).drop("_d", "_n")


def axis_position(p: Column, axis: Column) -> Column:
    """Position of Lab colour ``p`` on a described axis: rim = 0, centre = 1."""
    dot = sum((p[k] - axis["m" + k]) * axis["u" + k] for k in ("l", "a", "b"))
    return dot / axis["span"] + 0.5
