"""Background, contrast plane, noise and plate region."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petrigrid.functions.colour import luma, with_lab
from petrigrid.plans.quantiles import exact_median, exact_quantiles, scaled_mad

from petrigrid.session import cut

from . import components as CC
from . import pixels as P
from .shapes import convex_hull

c = F.col
LAB = ["l", "a", "b"]
WORK_SIDE = 480
REGION_CONTEXT = 0.04


def lab_planes(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Pixel table with Lab columns ``l a b``, luma and a saturation flag (PIX1)."""
    p = with_lab(pixels.withColumnsRenamed({"r": "red", "g": "green", "b": "blue"}), c("red"), c("green"), c("blue"))
    sat = (c("red") >= 250) | (c("green") >= 250) | (c("blue") >= 250)
    return p.select(*keys, "y", "x", c("lab.l").alias("l"), c("lab.a").alias("a"), c("lab.b").alias("b"), luma(c("red"), c("green"), c("blue")).alias("luma"), sat.alias("saturated"))


def lab_background(planes: DataFrame, keys: list[str], sigma: float, weight: str, within: str | None = None) -> DataFrame:
    """Masked Gaussian of each Lab channel: columns ``bg_l bg_a bg_b`` (PIX24)."""
    med = None
    for n in LAB:
        m = exact_median(planes.where(c(weight) > 0), keys, n, "med_" + n)
        med = m if med is None else med.join(m, keys)
    t = planes.withColumns({"bg_" + n: c(n) for n in LAB}).join(med, keys, "left")
    names = ["bg_" + n for n in LAB]
    fb = {"bg_" + n: F.coalesce("med_" + n, F.lit(0.0)) for n in LAB}
    return P.normalised_blur(t, keys, sigma, weight, names, fb, within).drop(*["med_" + n for n in LAB])


def lab_differences(planes: DataFrame, points: DataFrame, keys: list[str], item: str, r: int = 1) -> DataFrame:
    """Lab minus background around each point, mean over (2r+1)^2 (PIX24)."""
    d = planes.select(*keys, "y", "x", *[(c(n) - c("bg_" + n)).alias(n) for n in LAB])
    at = points.select(*keys, item, (F.floor("px")).alias("px"), F.floor("py").alias("py"))
    return P.patch_mean(d, at, keys, item, r, LAB)


def contrast_plane(planes: DataFrame, axes: DataFrame, keys: list[str]) -> DataFrame:
    """F = (Lab - background) . axis as column ``v`` (PIX24)."""
    j = planes.join(axes.select(*keys, "axis_l", "axis_a", "axis_b"), keys)
    f = sum((c(n) - c("bg_" + n)) * c("axis_" + n) for n in LAB)
    return j.withColumn("v", f).drop("axis_l", "axis_a", "axis_b")


def noise_sigma(plane: DataFrame, keys: list[str], select: Column) -> DataFrame:
    """Robust sigma of F over background pixels, at least 1e-3 (PIX24)."""
    m = scaled_mad(plane.where(select), keys, "v", "_med", "_mad")
    return m.select(*keys, F.when(c("_mad") > 1e-3, c("_mad")).otherwise(1e-3).alias("noise"))


def rim_width(plane: DataFrame, keys: list[str], diameters: DataFrame) -> DataFrame:
    """Width of the band along the wall that does not look like agar (PIX26).

    ``plane(keys, luma, dist)`` holds plate pixels with their distance to the outline.
    """
    # read several times below: materialise once
    p = cut(plane.select(*keys, "luma", "dist").join(diameters, keys))
    d, eq = c("dist"), c("diameter")
    inner = p.where(d > eq * 0.25)
    agar = exact_median(inner, keys, "luma", "agar").join(inner.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_in")).where("n_in >= 50"), keys)
    max_d = F.greatest(F.lit(4), F.floor(eq * 0.15))
    ring = p.where((d <= eq * 0.25) & (d <= max_d)).join(agar, keys).withColumns({"ring": F.floor("dist"), "dev": F.abs(c("luma") - c("agar")) / F.greatest(c("agar"), F.lit(1.0))})
    ring = cut(ring.select(*keys, "ring", "dev"))
    n = ring.groupBy(*keys, "ring").agg(F.count(F.lit(1)).alias("n_ring")).where("n_ring >= 20")
    p90 = cut(exact_quantiles(ring, [*keys, "ring"], "dev", {"p90": 0.9}).join(n, [*keys, "ring"]).join(diameters, keys))
    start = F.floor(eq * 0.08)
    ref = exact_median(p90.where(c("ring") >= start), keys, "p90", "ref")
    last = p90.join(ref, keys).where((c("ring") < start) & (c("p90") > c("ref") + 0.12)).groupBy(*keys).agg((F.max("ring") + 1).alias("rim"))
    return diameters.join(last, keys, "left").select(*keys, F.coalesce("rim", F.lit(0)).cast("bigint").alias("rim"))


def equivalent_diameter(mask: DataFrame, keys: list[str]) -> DataFrame:
    return mask.groupBy(*keys).agg((F.sqrt(F.count(F.lit(1)) / math.pi) * 2).alias("diameter"))


def region_mask(auto: DataFrame, core: DataFrame, keys: list[str], diameters: DataFrame) -> DataFrame:
    """Plate interior inside a polygon grown by the context band (PIX27).

    ``auto(keys, y, x, on)`` is the whole raster; ``core`` the pixels inside the polygon.
    """
    t = auto.join(core.select(*keys, "y", "x").withColumn("core", F.lit(True)), [*keys, "y", "x"], "left").withColumn("core", F.coalesce("core", F.lit(False)))
    d = P.distance_transform(t, keys, c("core"), border=False)
    j = t.join(d, [*keys, "y", "x"]).join(diameters, keys)
    band = F.greatest(F.lit(4.0), c("diameter") * REGION_CONTEXT)
    return j.withColumn("on", c("on") & (c("dist") <= band)).drop("dist", "diameter")


def _central(w: Column, h: Column) -> Column:
    return (c("y") >= F.floor(h * 0.35)) & (c("y") < F.ceil(h * 0.65)) & (c("x") >= F.floor(w * 0.35)) & (c("x") < F.ceil(w * 0.65))


def plate_region(pixels: DataFrame, keys: list[str], margin_frac: float = 0.025) -> tuple[DataFrame, DataFrame]:
    """Plate mask and analysed mask per image, plus a report row (PIX25).

    Agar band around the central median of a small luma image, opened by a disk, the
    component with most central votes, holes filled, convex hull, rim margin; the
    central 90 % when no outline is found.
    """
    full = cut(pixels.withColumn("v", luma(c("r"), c("g"), c("b"))).select(*keys, "y", "x", "v"))
    sizes = cut(P.size_of(full, keys))
    f = F.least(F.lit(1.0), F.lit(float(WORK_SIDE)) / F.greatest("w", "h"))
    work = lambda n: F.greatest(F.lit(8), F.floor(c(n) * f + 0.5)).cast("bigint")
    s = sizes.withColumns({"ow": work("w"), "oh": work("h")})
    small = cut(P.resize_area(full, keys, s).join(s.select(*keys, c("ow").alias("sw"), c("oh").alias("sh")), keys))
    central = _central(c("sw"), c("sh"))
    agar = scaled_mad(small.where(central), keys, "v", "agar", "spread")
    j = small.join(agar, keys)
    lo = F.least(c("agar") * 0.55, c("agar") - c("spread") * 4)
    hi = F.greatest(c("agar") * 1.5, c("agar") + c("spread") * 4)
    cand = cut(j.select(*keys, "y", "x", "sw", "sh", ((c("v") >= lo) & (c("v") <= hi)).alias("on")))
    d = P.distance_transform(cand, keys, ~c("on"), border=True)
    open_r = F.greatest(F.lit(1), F.floor(F.least("sw", "sh") * 0.006 + 0.5))
    eroded = cand.join(d, [*keys, "y", "x"]).withColumn("on", c("dist") > open_r)
    lab = cut(CC.labelled_pixels(eroded.where("on").select(*keys, "y", "x"), keys, 4))
    ss = s.select(*keys, c("ow").alias("sw"), c("oh").alias("sh"))
    votes = lab.join(ss, keys).where(central).groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy(*keys).agg(F.max(F.struct("n", (-c("label")).alias("neg"))).alias("m")).select(*keys, (-c("m.neg")).alias("label"))
    core = lab.join(best, [*keys, "label"], "left_semi").select(*keys, "y", "x").withColumn("core", F.lit(True))
    raster = cand.select(*keys, "y", "x").join(core, [*keys, "y", "x"], "left").withColumn("core", F.coalesce("core", F.lit(False)))
    grown = P.distance_transform(raster, keys, c("core"), border=False)
    plate = raster.join(grown, [*keys, "y", "x"]).join(ss, keys).withColumn("on", c("dist") <= open_r).select(*keys, "y", "x", "on")
    plate = cut(CC.fill_holes(cut(plate), keys, s.select(*keys, c("ow").alias("w"), c("oh").alias("h"))))
    area = plate.groupBy(*keys).agg((F.count_if("on") / F.count(F.lit(1))).alias("frac"))
    ok = area.where((c("frac") >= 0.08) & (c("frac") <= 0.97)).select(*keys)
    edge = P.boundary(plate, keys).where("edge").join(ok, keys, "left_semi").select(*keys, (c("x") + 0.5).alias("x"), (c("y") + 0.5).alias("y"))
    hull = cut(convex_hull(edge, keys))
    found = hull.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select(*keys, F.lit(True).alias("found"))
    src = s.join(found, keys, "left").withColumn("found", F.coalesce("found", F.lit(False)))
    sx, sy = c("w") / c("ow"), c("h") / c("oh")
    auto = hull.join(src.where("found"), keys).select(*keys, "ord", (c("x") * sx).alias("x"), (c("y") * sy).alias("y"))
    corner = lambda fx, fy: F.struct((c("w") * fx).alias("x"), (c("h") * fy).alias("y"))
    box = src.where(~c("found")).select(*keys, F.posexplode(F.array(corner(0.05, 0.05), corner(0.95, 0.05), corner(0.95, 0.95), corner(0.05, 0.95))).alias("ord", "p"))
    outline = auto.unionByName(box.select(*keys, c("ord").cast("bigint").alias("ord"), c("p.x").alias("x"), c("p.y").alias("y")))
    inside = P.raster_polygon(full.select(*keys, "y", "x"), outline, keys).withColumn("plate", F.lit(True))
    r = cut(full.join(inside, [*keys, "y", "x"], "left").withColumn("plate", F.coalesce("plate", F.lit(False))))
    dist = P.distance_transform(r.select(*keys, "y", "x", "plate"), keys, ~c("plate"), border=True)
    r = cut(r.join(dist, [*keys, "y", "x"]))
    diam = cut(equivalent_diameter(r.where("plate"), keys))
    rim = rim_width(r.where("plate").select(*keys, c("v").alias("luma"), "dist"), keys, diam)
    rep = src.select(*keys, "found").join(diam, keys).join(cut(rim), keys)
    margin = F.when(~c("found"), 0.0).otherwise(F.greatest(c("diameter") * margin_frac, F.when(c("rim") > 0, c("rim") + c("diameter") * 0.01).otherwise(0.0)))
    rep = rep.select(*keys, F.when(c("found"), "auto").otherwise("fallback").alias("source"), "diameter", "rim", margin.alias("margin"))
    masks = r.join(rep.select(*keys, "margin"), keys).select(*keys, "y", "x", "plate", (c("dist") > c("margin")).alias("on"))
    masks = cut(masks)
    n = masks.groupBy(*keys).agg(F.count_if("plate").alias("plate_area"), F.count_if("on").alias("area"))
    return masks, rep.join(n, keys)
