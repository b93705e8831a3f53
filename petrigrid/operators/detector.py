"""Detector stages on pixel tables: blobs, circles, rims, seed measurement, the LoG job.

Stage tables that later stages read more than once are cut to the shared checkpoint
folder, so each is computed once and survives lost executors.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window as W

from petrigrid.functions import scoring as SC
from petrigrid.functions.colour import with_lab
from petrigrid.plans import grid
from petrigrid.plans.quantiles import exact_median, exact_quantiles
from petrigrid.session import cut

from . import background as B
from . import blobs as BL
from . import components as CC
from . import matching as M
from . import measure as ME
from . import pixels as P
from . import rims as RI
from . import robust as R
from . import spatial as S
from . import tiles as TL

c = F.col
RAYS, STEP = 32, 0.5
TAU = 2 * math.pi
BLOB_PIXELS = RIM_PIXELS = 1 << 20  # pixels of an image that one task holds


# ---------------------------------------------------------------- blobs


def log_blobs(plane: DataFrame, keys: list[str], radii: list[float], min_response: float, within: DataFrame | None = None, overlap: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Multi-scale blobs and all responses (PIX17).

    One response plane per radius; a maximum must also beat the neighbouring scales at
    its pixel; overlapping circles are suppressed, strongest first. Images of up to
    ``BLOB_PIXELS`` settle in one task each; responses are made where they are read.
    """
    plane = cut(plane.select(*keys, "y", "x", "v"))
    fits = cut(BL.foldable(plane, keys, BLOB_PIXELS))
    own = plane.join(fits.where("_fold").select(*keys), keys, "left_semi")
    peaks, resp = BL.peaks(own, keys, radii, min_response), BL.responses(own, keys, radii)
    if fits.where("not _fold").limit(1).count():
        more, all_ = _window_blobs(plane.join(fits.where("not _fold").select(*keys), keys, "left_semi"), keys, radii, min_response)
        peaks, resp = peaks.unionByName(more), resp.unionByName(all_)
    if within is not None:
        peaks = peaks.join(within.select(*keys, "y", "x"), [*keys, "y", "x"], "left_semi")
    b = peaks.select(*keys, (c("x") + 0.5).alias("x"), (c("y") + 0.5).alias("y"), "r", c("v").alias("response"), ((c("y") * (1 << 24) + c("x")) * 16 + c("scale")).alias("blob_id"))
    kept = M.greedy_keep(cut(b), keys, "blob_id", [-c("response")], overlap)
    return kept.where("kept").drop("kept"), resp


def _window_blobs(plane: DataFrame, keys: list[str], radii: list[float], min_response: float) -> tuple[DataFrame, DataFrame]:
    """What ``blobs.peaks`` and ``blobs.responses`` give, in window passes by line: no task holds an image."""
    resp = peaks = None
    for k, r in enumerate(radii):
        sigma = r / math.sqrt(2)
        one = cut(P.log_response(plane, keys, sigma).withColumn("scale", F.lit(k)))
        top = P.local_maxima(one, keys, max(1, math.floor(sigma * 0.7 + 0.5)), F.lit(min_response)).withColumn("r", F.lit(float(r)))
        resp = one if resp is None else resp.unionByName(one)
        peaks = top if peaks is None else peaks.unionByName(top)
    near = resp.select(*keys, "y", "x", c("v").alias("nv"), F.explode(F.array(c("scale") - 1, c("scale") + 1)).alias("scale"))
    better = peaks.join(near, [*keys, "y", "x", "scale"]).where(c("nv") > c("v")).select(*keys, "y", "x", "scale").distinct()
    return peaks.join(better, [*keys, "y", "x", "scale"], "left_anti"), resp


def hough_circles(plane: DataFrame, keys: list[str], r_min: int, r_max: int, edge_quantile: float = 0.9) -> DataFrame:
    """Strongest circle per image from gradient votes (PIX18). Votes combine map-side per cell."""
    g = cut(P.gradient(plane, keys).withColumn("m", F.sqrt(c("gx") * c("gx") + c("gy") * c("gy"))))
    sizes = cut(P.size_of(plane, keys))
    thr = exact_quantiles(g, keys, "m", {"t": edge_quantile})
    e = g.join(thr, keys).join(sizes, keys).where((c("m") > c("t")) & (c("m") > 0) & (c("x") > 0) & (c("y") > 0) & (c("x") < c("w") - 1) & (c("y") < c("h") - 1))
    e = cut(e.select(*keys, "y", "x", "w", "h", (c("gx") / c("m")).alias("ux"), (c("gy") / c("m")).alias("uy")))
    v = e.withColumn("s", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumn("rr", F.explode(F.sequence(F.lit(r_min), F.lit(r_max))))
    v = v.select(*keys, "w", "h", F.floor(c("x") + c("s") * c("ux") * c("rr") + 0.5).alias("x"), F.floor(c("y") + c("s") * c("uy") * c("rr") + 0.5).alias("y")).where((c("x") >= 0) & (c("y") >= 0) & (c("x") < c("w")) & (c("y") < c("h")))
    acc = v.groupBy(*keys, "y", "x").agg(F.count(F.lit(1)).alias("n"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    s9 = acc.select(*keys, "y", "x", "n", around.alias("k")).groupBy(*keys, (c("y") + c("k.i")).alias("y"), (c("x") + c("k.j")).alias("x")).agg(F.sum("n").alias("n"))
    s9 = s9.join(sizes, keys).where((c("x") > 0) & (c("y") > 0) & (c("x") < c("w") - 1) & (c("y") < c("h") - 1))
    best = s9.groupBy(*keys).agg(F.max(F.struct("n", (-c("y")).alias("ny"), (-c("x")).alias("nx"))).alias("b")).select(*keys, (-c("b.nx") + 0.5).alias("cx"), (-c("b.ny") + 0.5).alias("cy"))
    d = cut(e.join(best, keys).select(*keys, "cx", "cy", grid.distance(c("x") + 0.5, c("y") + 0.5, c("cx"), c("cy")).alias("d"), F.atan2(c("y") + 0.5 - c("cy"), c("x") + 0.5 - c("cx")).alias("a")))
    hist = d.groupBy(*keys, F.floor(c("d") - r_min + 0.5).alias("b")).agg(F.sum(1 / F.greatest(c("d"), F.lit(1.0))).alias("n")).where((c("b") >= 0) & (c("b") <= r_max - r_min))
    pair = hist.select(*keys, "b", "n").unionByName(hist.select(*keys, (c("b") + 1).alias("b"), "n")).groupBy(*keys, "b").agg(F.sum("n").alias("n")).where(c("b") <= r_max - r_min)
    rad = pair.groupBy(*keys).agg(F.max(F.struct(F.round("n", 9), (-c("b")).alias("nb"))).alias("m")).select(*keys, (F.lit(float(r_min)) - c("m.nb")).alias("r"))
    sup = d.join(rad, keys).where(F.abs(c("d") - c("r")) <= 2).select(*keys, F.floor((c("a") + math.pi) / TAU * 179.999).alias("bin")).distinct().groupBy(*keys).agg((F.count(F.lit(1)) / 180).alias("support"))
    return best.join(rad, keys).join(sup, keys, "left").select(*keys, "cx", "cy", "r", F.coalesce("support", F.lit(0.0)).alias("support"))


@pandas_udf(T.DoubleType())
def _first_edge(profiles: pd.Series, windows: pd.Series) -> pd.Series:
    """Radius of the first strong local rise of one ray's smoothed profile, null without one."""
    edges = [RI.first_edges(np.asarray(d, dtype=float)[None], w)[0] for d, w in zip(profiles, windows)]
    return pd.Series([None if np.isnan(e) else e for e in edges], dtype="float64")


def rim_estimates(pixels: DataFrame, picks: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Rim colour and radius around picked centres (PIX22).

    Along 32 rays the colour distance from the centre is smoothed; the first strong local
    rise is the edge, the upper median over rays the radius, the mean of the ring at
    0.65-0.85 radius the rim. A ring too close to the centre colour moves towards the
    background ring; without enough edges the window mean is the rim.

    A centre picked twice is measured once. Images of up to ``RIM_PIXELS`` settle in one task each, larger ones join
    the points of their rays with the pixels.
    """
    spots = picks.select(*keys, "px", "py").distinct()
    size = cut(pixels.join(spots.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    px = pixels.join(size.where(c("_n") <= RIM_PIXELS).select(*keys), keys, "left_semi")
    px = with_lab(px, c("r"), c("g"), c("b")).select(*keys, "y", "x", "r", "g", "b", c("lab.l").alias("l"), c("lab.a").alias("a"), c("lab.b").alias("lb"))
    j = RI.folded(px, spots, keys).withColumn("clab", F.struct(c("c_l").alias("l"), c("c_a").alias("a"), c("c_b").alias("b"))).drop("c_l", "c_a", "c_b")
    big = size.where(c("_n") > RIM_PIXELS).select(*keys)
    if big.limit(1).count():
        j = j.unionByName(_joined_rims(pixels.join(big, keys, "left_semi"), spots.join(big, keys, "left_semi"), keys))
    j = cut(j)
    j = with_lab(with_lab(j, c("mr"), c("mg"), c("mb"), "mlab"), c("or"), c("og"), c("ob"), "olab")
    j = j.withColumns({"dm": _lab_distance(c("mlab"), c("clab")), "do": _lab_distance(c("olab"), c("clab"))})
    f = F.least(F.lit(1.0), F.lit(6.0) / c("do"))
    pick = lambda n: F.when(c("radius").isNull(), c("w" + n)).when((c("dm") < 6) & (c("do") > 1e-6), c("c" + n) + (c("o" + n) - c("c" + n)) * f).otherwise(c("m" + n))
    rims = j.select(*keys, "px", "py", *[F.round(pick(n), 6).alias("rim_" + n) for n in "rgb"], "radius")
    return picks.select(*keys, item, "px", "py").join(rims, [*keys, "px", "py"]).drop("px", "py")


def _lab_distance(a: Column, b: Column) -> Column:
    return F.sqrt(sum((a[n] - b[n]) * (a[n] - b[n]) for n in ("l", "a", "b")))


def _joined_rims(pixels: DataFrame, spots: DataFrame, keys: list[str]) -> DataFrame:
    """What ``rims.folded`` gives, by joins of ray and ring points with pixels: no task holds an image."""
    spot = [*keys, "px", "py"]
    sizes = P.size_of(pixels, keys)
    px = cut(with_lab(pixels, c("r"), c("g"), c("b")).select(*keys, "y", "x", "r", "g", "b", "lab"))
    at = px.select(*keys, c("x").alias("px"), c("y").alias("py"), c("lab").alias("clab"), *[c(n).cast("double").alias("c" + n) for n in "rgb"])
    p = spots.join(at, spot).join(sizes, keys)
    p = p.withColumn("max_r", F.least("px", "py", c("w") - 1 - c("px"), c("h") - 1 - c("py")))
    p = cut(p.withColumn("win", F.greatest(F.lit(1), F.floor(c("max_r") / 60 + 0.5)).cast("int")))
    ok = p.where("max_r >= 8")
    ray = ok.withColumn("ray", F.explode(F.sequence(F.lit(0), F.lit(RAYS - 1)))).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), c("max_r"))))
    ang = c("ray") / RAYS * TAU
    ray = ray.select(*spot, "clab", "win", "max_r", "ray", "k", F.floor(c("px") + c("k") * F.cos(ang) + 0.5).alias("x"), F.floor(c("py") + c("k") * F.sin(ang) + 0.5).alias("y"))
    d = ray.join(px.select(*keys, "y", "x", "lab"), [*keys, "y", "x"]).select(*spot, "ray", "k", "win", "max_r", _lab_distance(c("lab"), c("clab")).alias("d"))
    prof = cut(d.groupBy(*spot, "ray", "win", "max_r").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "d"))), lambda s: s["d"]).alias("d")))
    rays = prof.withColumn("edge", _first_edge(c("d"), c("win"))).where(c("edge").isNotNull())
    rad = rays.groupBy(*spot).agg(F.sort_array(F.collect_list("edge")).alias("e")).where(F.size("e") >= RAYS / 4)
    rad = cut(rad.select(*spot, F.element_at("e", F.floor(F.size("e") / 2).cast("int") + 1).alias("radius")))

    def ring(f0: int, f1: int, name: str) -> DataFrame:
        e = rad.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(2 * RAYS - 1)))).withColumn("f", F.explode(F.sequence(F.lit(f0), F.lit(f1), F.lit(5))))
        ang2 = c("a") / (2 * RAYS) * TAU
        q = e.select(*spot, F.floor(c("px") + c("f") / 100 * c("radius") * F.cos(ang2) + 0.5).alias("x"), F.floor(c("py") + c("f") / 100 * c("radius") * F.sin(ang2) + 0.5).alias("y"))
        return q.join(px, [*keys, "y", "x"]).groupBy(*spot).agg(*[F.avg(n).alias(name + n) for n in "rgb"])

    inner, outer = cut(ring(65, 85, "m")), cut(ring(130, 160, "o"))
    whole = px.groupBy(*keys).agg(*[F.avg(n).alias("w" + n) for n in "rgb"])
    j = p.join(rad, spot, "left").join(inner, spot, "left").join(outer, spot, "left").join(whole, keys)
    return cut(j.select(*spot, "radius", *[g + n for g in "wcmo" for n in "rgb"], "clab"))


# ---------------------------------------------------------------- seed measurement


def measure_seeds(plane: DataFrame, seeds: DataFrame, keys: list[str], item: str, saturated: DataFrame | None = None, region_distance: DataFrame | None = None) -> DataFrame:
    """Radius and quality features of every seed, re-centred at most three times (PIX28).

    ``seeds(keys, item, px, py, noise, r_max)`` in plane pixels; ``plane(keys, y, x, v)``.
    """
    px = plane.select(*keys, "y", "x", "v")
    if saturated is not None:
        px = px.join(saturated.select(*keys, "y", "x", "saturated"), [*keys, "y", "x"])
    if region_distance is not None:
        px = px.join(region_distance.select(*keys, "y", "x", "dist"), [*keys, "y", "x"])
    tiles = TL.to_tiles(px, keys, [n for n in px.columns if n not in (*keys, "y", "x")])
    return ME.measured(tiles, seeds, keys, [item])


def local_colonies(plane: DataFrame, within: DataFrame, keys: list[str], limits: DataFrame, r_min: float, threshold: str = "threshold") -> DataFrame:
    """Colonies measured at brightness maxima, merged: rounder first, then larger (PIX30).

    ``limits(keys, noise, r_max, threshold)``. A maximum inside half the radius of a brighter
    measured one is dropped; the suppression rounds run over all images at once.
    """
    smooth = cut(P.gaussian_blur(plane.select(*keys, "y", "x", "v"), keys, max(0.7, 0.35 * r_min)).join(limits.select(*keys, threshold), keys))
    peaks = P.local_maxima(smooth, keys, max(1, math.floor(0.6 * r_min + 0.5)), c(threshold)).join(within.select(*keys, "y", "x"), [*keys, "y", "x"], "left_semi")
    ids = peaks.select(*keys, (c("y") * (1 << 24) + c("x")).alias("peak_id"), (c("x") + 0.5).alias("px"), (c("y") + 0.5).alias("py"), c("v").alias("bright"))
    m = cut(measure_seeds(plane, cut(ids.join(limits.select(*keys, "noise", "r_max"), keys)), keys, "peak_id"))
    good = m.where((c("weight") > 0) & (c("r") >= 0.5 * r_min))
    # brighter measured colonies swallow the maxima inside half their radius
    bright = _swallow(good.select(*keys, "peak_id", "px", "py", c("cx").alias("x"), c("cy").alias("y"), "r", "bright"), keys)
    col = good.join(bright, [*keys, "peak_id"], "left_semi").select(*keys, "peak_id", c("cx").alias("x"), c("cy").alias("y"), "r", "weight", "cv")
    return M.greedy_keep(col, keys, "peak_id", [c("cv"), -c("r"), c("y"), c("x")], 0.8).where("kept").drop("kept")


def _swallow(items: DataFrame, keys: list[str]) -> DataFrame:
    """Brightness-order rule: keep a maximum unless a kept, brighter colony holds it within half its radius."""
    from petrigrid.plans.rounds import drain

    own = items.select(*keys, c("peak_id").alias("a"), c("bright").alias("ab"), "x", "y", "r")
    other = items.select(*keys, c("peak_id").alias("b"), c("bright").alias("bb"), c("px").alias("x"), c("py").alias("y"))
    e = grid.pairs_in_reach(own, other, keys, c("r") * 0.5, strict=True).where((c("a") != c("o_b")) & (F.struct(-c("ab"), c("a")) < F.struct(-c("o_bb"), c("o_b")))).select(*keys, "a", c("o_b").alias("b"))
    e = cut(e)

    def step(pending: DataFrame) -> tuple[DataFrame, DataFrame]:
        # an item without an undecided brighter holder is kept; what it holds is dropped
        held = e.join(pending.select(*keys, c("peak_id").alias("a")), [*keys, "a"], "left_semi")
        kept = cut(pending.join(held.select(*keys, c("b").alias("peak_id")).distinct(), [*keys, "peak_id"], "left_anti"))
        gone = e.join(kept.select(*keys, c("peak_id").alias("a")), [*keys, "a"], "left_semi").select(*keys, c("b").alias("peak_id")).distinct()
        rest = pending.join(kept, [*keys, "peak_id"], "left_anti").join(gone, [*keys, "peak_id"], "left_anti")
        return kept, rest

    out = drain(items.select(*keys, "peak_id"), step)
    return items.select(*keys, "peak_id") if out is None else out


# ---------------------------------------------------------------- clusters and the LoG job


def foreground(smooth: DataFrame, keys: list[str], limits: DataFrame) -> DataFrame:
    """Foreground mask: above threshold inside the region, small holes filled, specks dropped (PIX31).

    ``smooth(keys, y, x, v, on)`` with ``on`` = analysed region, ``limits(keys, threshold, r_med, r_lo)``.
    """
    sizes = P.size_of(smooth, keys).join(limits, keys)
    sizes = cut(sizes.withColumns({"hole": c("r_med") * c("r_med") * (0.15 * math.pi), "speck": F.greatest(F.lit(2.0), c("r_lo") * c("r_lo") * (0.3 * math.pi))}))
    m = cut(smooth.join(limits.select(*keys, "threshold"), keys).select(*keys, "y", "x", (c("on") & (c("v") > c("threshold"))).alias("on")))
    filled = cut(CC.fill_holes(m, keys, sizes, "hole"))
    return CC.drop_specks(filled, keys, sizes, "speck").where("on").select(*keys, "y", "x")


def marks_per_cluster(labels: DataFrame, stats: DataFrame, marks: DataFrame, keys: list[str], r_med: DataFrame, k_max: int = 400) -> DataFrame:
    """Cluster table with fixed marks and the too-large flag (PIX33)."""
    at = S.label_at(marks, labels, keys).where("label > 0").groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("fixed"))
    j = stats.join(at, [*keys, "label"], "left").join(r_med, keys)
    big = c("area") > c("r_med") * c("r_med") * (k_max * math.pi)
    return j.select(*keys, "label", "area", "min_x", "min_y", "max_x", "max_y", F.coalesce("fixed", F.lit(0)).alias("fixed"), big.alias("too_large"))


def fixed_discs(marks: DataFrame, measured: DataFrame, prior: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Existing marks as discs (PIX34): known radius, else measured and clamped, else typical.

    ``marks(keys, item, px, py, known_r)``, ``measured`` from ``measure_seeds``, ``prior(keys, r_med, r_hi)``.
    """
    m = measured.select(*keys, item, "cx", "cy", c("r").alias("mr"), "snr")
    j = marks.join(m, [*keys, item], "left").join(prior.select(*keys, "r_med", "r_hi"), keys)
    good = c("mr").isNotNull() & (c("snr") >= 3)
    r = F.when(c("known_r").isNotNull(), c("known_r")).when(good, F.least(F.greatest(c("mr"), c("r_med") * 0.6), c("r_hi") * 1.6)).otherwise(c("r_med"))
    j = j.withColumn("r", r)
    near = c("known_r").isNull() & good & (grid.distance(c("cx"), c("cy"), c("px"), c("py")) < c("r") * 0.5)
    return j.select(*keys, item, F.when(near, c("cx")).otherwise(c("px")).alias("x"), F.when(near, c("cy")).otherwise(c("py")).alias("y"), "r")


def log_job(plane: DataFrame, region: DataFrame, seeds: DataFrame, fixed: DataFrame, limits: DataFrame, keys: list[str], radii: list[float], log_frac: float) -> tuple[DataFrame, DataFrame]:
    """LoG detector end to end (PIX32): candidates, seed-relative threshold, clusters, suggestions.

    ``seeds(keys, item, x, y)`` and ``fixed(keys, x, y, r)`` in plane pixels,
    ``limits(keys, noise, contrast_ref, threshold, r_med, r_lo)``.
    """
    blobs, resp = log_blobs(plane, keys, radii, 0.0, region, 0.7)
    blobs = cut(blobs)
    # per image: the scale nearest its typical radius, the finer one on ties, and a window of 0.3 of that radius
    off = F.array(*[F.struct(F.abs(F.lit(float(r)) - c("r_med")).alias("d"), F.lit(i).alias("i")) for i, r in enumerate(radii)])
    own = limits.select(*keys, F.array_min(off)["i"].alias("scale"), F.greatest(F.lit(1), F.floor(c("r_med") * 0.3 + 0.5)).cast("bigint").alias("_rr"))
    side = lambda n: F.explode(F.sequence(F.floor(c(n)) - c("_rr"), F.floor(c(n)) + c("_rr")))
    near = seeds.select(*keys, "item", "x", "y").join(own, keys).withColumn("sx", side("x")).withColumn("sy", side("y")).select(*keys, "scale", "item", c("sx").alias("x"), c("sy").alias("y"))
    top = near.join(resp.select(*keys, "scale", "y", "x", "v"), [*keys, "scale", "y", "x"]).groupBy(*keys, "item").agg(F.max("v").alias("v"))
    from .metrics import upper_median

    ref = upper_median(top, keys, "v", "_ref")
    lim = cut(limits.join(ref, keys, "left").withColumn("log_thr", F.greatest(F.coalesce("_ref", c("contrast_ref") * 0.5) * log_frac, c("noise") * 1.5)))
    cand = blobs.join(lim.select(*keys, "log_thr"), keys).where(c("response") >= c("log_thr"))
    cand = S.not_near_fixed(cand, fixed, keys, "blob_id", 0.6)
    on = plane.select(*keys, "y", "x", "v").join(region.select(*keys, "y", "x").withColumn("on", F.lit(True)), [*keys, "y", "x"], "left").withColumn("on", F.coalesce("on", F.lit(False)))
    run_rows, stats = CC.label_components(foreground(on, keys, lim), keys, 8)
    labels = cut(CC.to_pixels(run_rows, keys, "label"))
    s = S.label_at(cand, labels, keys)
    cid = F.when(c("label") > 0, F.concat(F.lit("c"), c("label").cast("string"))).otherwise(F.concat(F.lit("s"), c("blob_id").cast("string")))
    s = cut(s.select(*keys, "blob_id", "x", "y", "r", (c("response") / c("log_thr")).alias("score"), cid.alias("cluster_id"), "label"))
    n = s.where("label > 0").groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("chosen_k"))
    return s.drop("label"), stats.join(n, [*keys, "label"], "left").withColumn("chosen_k", F.coalesce("chosen_k", F.lit(0)))


def post_filter(suggestions: DataFrame, fixed: DataFrame, regions: DataFrame, roi: DataFrame, images: DataFrame, scale: float) -> DataFrame:
    """Keep suggestions in the analysed mask, in the image's polygon if it has one, inside the image, off existing marks (FIL10)."""
    keys = ["image_id"]
    s = S.label_at(suggestions, roi, keys, scale).where("label = 1").drop("label")
    size = images.select("image_id", "width", "height")
    s = s.join(size, "image_id").where((c("x") < c("width")) & (c("y") < c("height")) & (c("x") >= 0) & (c("y") >= 0)).drop("width", "height")
    ins = S.in_region(s, regions, "suggestion_id", keys).select("image_id", "suggestion_id").distinct()
    drawn = regions.select("image_id").distinct()
    s = s.join(drawn, "image_id", "left_anti").unionByName(s.join(drawn, "image_id", "left_semi").join(ins, ["image_id", "suggestion_id"], "left_semi"))
    return S.not_near_fixed(s, fixed, keys, "suggestion_id", 0.5)
