"""Seed measurement on pixel rows: the form that the tiled one is held against."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from petrigrid.functions import scoring as SC
from petrigrid.operators import fits as FT
from petrigrid.operators import pixels as P
from petrigrid.plans import grid
from petrigrid.session import cut

c = F.col
RAYS, STEP = 32, 0.5
TAU = 2 * math.pi


def _med(arr: Column) -> Column:
    s, n = F.sort_array(arr), F.size(arr)
    at = lambda i: F.element_at(s, i.cast("int"))
    return F.when(n > 0, (at(F.floor((n - 1) / 2) + 1) + at(F.floor(n / 2) + 1)) / 2)


def _profiles(plane: DataFrame, sizes: DataFrame, seeds: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Smoothed radial profiles ``(item, ray, k, p)``: mean of three sub-rays (PIX28)."""
    nk = F.greatest(F.lit(4), F.ceil(c("r_max") / STEP) + 1).cast("int")
    e = seeds.select(*keys, item, "cx", "cy", nk.alias("nk")).withColumn("ray", F.explode(F.sequence(F.lit(0), F.lit(RAYS - 1)))).withColumn("sub", F.explode(F.sequence(F.lit(-1), F.lit(1)))).withColumn("k", F.explode(F.sequence(F.lit(0), c("nk") - 1)))
    th = (c("ray") + c("sub") / 3) / RAYS * TAU
    pts = e.select(*keys, item, "ray", "sub", "k", "nk", (c("cx") + F.cos(th) * c("k") * STEP).alias("px"), (c("cy") + F.sin(th) * c("k") * STEP).alias("py"))
    v = P.sample_bilinear(plane, pts, keys, sizes, [item, "ray", "sub", "k", "nk"])
    raw = v.groupBy(*keys, item, "ray", "k", "nk").agg((F.sum("value") / 3).alias("t"))
    w = W.partitionBy(*keys, item, "ray").orderBy("k")  # one ray: at most nk rows
    return raw.withColumn("p", F.coalesce(F.lag("t").over(w), c("t")) * 0.25 + c("t") * 0.5 + F.coalesce(F.lead("t").over(w), c("t")) * 0.25).drop("t")


def _measure_once(plane: DataFrame, sizes: DataFrame, seeds: DataFrame, keys: list[str], item: str) -> DataFrame:
    """One pass: first boundary per ray and the robust radius. At most 32 hits per seed."""
    key = [*keys, item]
    prof = cut(_profiles(plane, sizes, seeds, keys, item))
    k_near = F.greatest(F.lit(3), F.least(c("nk"), F.ceil(F.greatest(F.lit(3.0), c("r_max") * 0.25) / STEP)))
    j = prof.join(seeds.select(*key, "cx", "cy", "noise", "r_max"), key)
    per_ray = j.groupBy(*key, "ray").agg(F.avg(F.when(c("k") <= 2, c("p"))).alias("m0"), F.min("p").alias("lo"), F.max(F.when(c("k") < k_near, c("p"))).alias("hi"))
    base = per_ray.groupBy(*key).agg(F.median("m0").alias("centre"), F.median("lo").alias("floor"), F.median("hi").alias("near_max"))
    base = base.withColumns({"dip": (c("centre") < c("near_max") * 0.6) & (c("near_max") > 0), "base": F.least(c("floor"), F.greatest("centre", "near_max") * 0.25)})
    w = W.partitionBy(*key, "ray").orderBy("k")
    before = F.max("p").over(w.rowsBetween(W.unboundedPreceding, -1))
    t = j.join(base, key).withColumns({"top": before.isNull() | (c("p") > before), "drop": F.lag("p").over(w) - c("p"), "prev": F.lag("p").over(w), "mx": F.max("p").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))})
    t = t.withColumn("seg", F.sum(F.when(c("top"), 1).otherwise(0)).over(w))
    ws = W.partitionBy(*key, "ray", "seg").orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow)
    t = t.withColumns({"low": F.min(F.struct("p", "k")).over(ws), "st": F.max(F.when(~c("top") & (c("drop") > 0), F.struct(c("drop").alias("d"), (-c("k")).alias("nk")))).over(ws), "k0": F.min("k").over(ws)})
    con, nz = c("mx") - c("base"), c("noise") / math.sqrt(3)
    level = c("base") + con * 0.5
    edge = c("p") < level
    seam = (c("mx") - c("low.p") >= F.greatest(con * 0.08, nz * 4)) & (c("p") - c("low.p") >= F.greatest(con * 0.03, nz * 2))
    tt = F.least(F.greatest((c("prev") - level) / F.greatest(c("prev") - c("p"), F.lit(1e-9)), F.lit(0.0)), F.lit(1.0))
    steep_k = F.coalesce(-c("st.nk"), c("k0"))
    hit = t.where(~c("top") & (con > 0) & (edge | seam)).select(
        *key, "ray", "k", F.when(edge, (c("k") - 1 + tt) * STEP).otherwise(c("low.k") * STEP).alias("r"), (~edge).alias("seam"), ((steep_k - 0.5) * STEP).alias("r_steep"), (F.coalesce("st.d", F.lit(0.0)) / STEP).alias("slope"), c("mx").alias("max")
    )
    first = hit.groupBy(*key, "ray").agg(F.min(F.struct("k", "r", "seam", "r_steep", "slope", "max")).alias("h"))
    hits = first.groupBy(*key).agg(F.collect_list(F.struct("ray", "h.r", "h.seam", "h.r_steep", "h.slope", "h.max")).alias("hits"))
    m = seeds.join(base, key).join(hits, key, "left").withColumn("hits", F.coalesce("hits", F.filter(F.array(F.struct(F.lit(0).alias("ray"), F.lit(0.0).alias("r"), F.lit(True).alias("seam"), F.lit(0.0).alias("r_steep"), F.lit(0.0).alias("slope"), F.lit(0.0).alias("max"))), lambda x: F.lit(False))))
    get = lambda arr, f: F.transform(arr, lambda x: x[f])
    m = m.withColumn("contrast", F.coalesce(_med(get(c("hits"), "max")), F.greatest("centre", "near_max")) - c("base")).withColumn("r0", _med(get(c("hits"), "r")))
    enough = (F.size("hits") >= RAYS / 4) & (c("contrast") > 0) & (c("r0") > 0)
    m = m.withColumn("_r", F.when(enough, c("r0"))).withColumn("inl", c("hits"))
    for _ in range(2):
        m = m.withColumn("inl", F.filter("hits", lambda x: (x["r"] >= c("_r") * 0.6) & (x["r"] <= c("_r") * 1.6)))
        m = m.withColumn("_n", F.size("inl")).withColumn("_r", F.when(c("_n") >= RAYS / 4, _med(get(c("inl"), "r"))))
    r = c("_r")
    m = m.withColumn("edge_inl", F.filter("hits", lambda x: (x["r"] >= c("_r") * 0.6) & (x["r"] <= c("_r") * 1.6)))
    steep = F.filter("inl", lambda x: x["slope"] > 0)
    dev = F.transform("inl", lambda x: F.abs(x["r"] - _med(F.transform("inl", lambda z: z["r"]))))
    blocked = F.when(enough, F.lit(1.0) - F.coalesce("_n", F.lit(0)) / RAYS).otherwise((F.lit(RAYS) - F.size("hits")) / RAYS)
    return m.select(
        *[x for x in seeds.columns], "dip", "contrast", (c("contrast") / c("noise")).alias("snr"), r.alias("r"),
        F.when(r.isNotNull(), _med(F.transform(steep, lambda x: x["r_steep"]))).alias("r_edge"), F.when(r.isNotNull(), _med(dev) * 1.4826 / r).otherwise(1.0).alias("cv"), blocked.alias("blocked_frac"),
        F.when(r.isNotNull(), F.size(F.filter("inl", lambda x: x["seam"])) / RAYS).otherwise(0.0).alias("seam_frac"), F.when(r.isNotNull(), F.size("edge_inl")).otherwise(0).alias("n_rays"),
        F.when(r.isNotNull(), F.coalesce(_med(F.transform(steep, lambda x: x["slope"])) * r / c("contrast"), F.lit(0.0))).otherwise(0.0).alias("sharpness"), "hits", "edge_inl",
    )


TILE = 64


def _around(plane: DataFrame, seeds: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels in the tiles that a measurement can reach: profiles end at ``r_max``, and a centre moves by 0.8 of a radius of at most twice that."""
    reach = c("r_max") * 2.6 + 4
    side = lambda a: F.explode(F.sequence(F.floor((c(a) - reach) / TILE), F.floor((c(a) + reach) / TILE)))
    tiles = seeds.select(*keys, "py", "r_max", side("px").alias("_tx")).select(*keys, "_tx", side("py").alias("_ty")).distinct()
    at = plane.withColumns({"_tx": F.floor(c("x") / TILE), "_ty": F.floor(c("y") / TILE)})
    return at.join(tiles, [*keys, "_tx", "_ty"], "left_semi").drop("_tx", "_ty")


def measure_seeds(plane: DataFrame, seeds: DataFrame, keys: list[str], item: str, saturated: DataFrame | None = None, region_distance: DataFrame | None = None) -> DataFrame:
    """Radius and quality features of every seed, re-centred at most three times (PIX28).

    ``seeds(keys, item, px, py, noise, r_max)`` in plane pixels; ``plane(keys, y, x, v)``.
    """
    key = [*keys, item]
    seeds = cut(seeds.select(*keys, item, "px", "py", "noise", "r_max"))
    sizes = cut(P.size_of(plane, keys))
    plane = cut(_around(plane.select(*keys, "y", "x", "v"), seeds, keys))
    cur = cut(_measure_once(plane, sizes, seeds.withColumns({"cx": c("px"), "cy": c("py")}), keys, item)).withColumn("live", F.lit(True))
    for _ in range(3):
        go = cur.where(c("live") & c("r").isNotNull() & (c("n_rays") >= 8))
        pts = lambda arr: go.select(*key, "cx", "cy", F.explode(arr).alias("h")).select(*key, (c("cx") + F.cos(c("h.ray") / RAYS * TAU) * c("h.r")).alias("x"), (c("cy") + F.sin(c("h.ray") / RAYS * TAU) * c("h.r")).alias("y"))
        circ = FT.recentre(cut(pts("edge_inl")), cut(pts("hits")), key).select(*key, c("cx").alias("nx"), c("cy").alias("ny"), c("cr").alias("nr"))
        j = go.drop("hits", "edge_inl").join(circ, key)
        fits = (grid.distance(c("nx"), c("ny"), c("px"), c("py")) <= c("nr") * 0.8) & (c("nr") <= c("r") * 2) & (grid.distance(c("nx"), c("ny"), c("cx"), c("cy")) >= 0.05) & (c("nr") > 0)
        moved = cut(j.where(fits).select(*keys, item, "px", "py", "noise", "r_max", c("nx").alias("cx"), c("ny").alias("cy")))
        if moved.limit(1).count() == 0:
            break
        # filter after the cut: pushed into the measurement, the filter would repeat its expressions
        nxt = cut(_measure_once(plane, sizes, moved, keys, item)).where(c("r").isNotNull()).withColumn("live", F.lit(True))
        rest = cur.join(nxt.select(*key), key, "left_anti").withColumn("live", F.lit(False))
        cur = cut(rest.unionByName(nxt))
    out = cur.drop("live", "hits", "edge_inl")
    if saturated is not None:
        side = lambda a: F.explode(F.sequence(F.floor(c(a) - c("r")), F.ceil(c(a) + c("r"))))
        box = out.where(c("r").isNotNull()).select(*key, "cx", "cy", "r").withColumn("x", side("cx")).withColumn("y", side("cy"))
        disc = box.where(grid.distance(c("x") + 0.5, c("y") + 0.5, c("cx"), c("cy")) <= c("r"))
        sf = disc.join(saturated.select(*keys, "y", "x", "saturated"), [*keys, "y", "x"]).groupBy(*key).agg(F.avg(F.when(c("saturated"), 1.0).otherwise(0.0)).alias("saturated_frac"))
        out = out.join(sf, key, "left")
    else:
        out = out.withColumn("saturated_frac", F.lit(0.0))
    if region_distance is not None:
        at = out.select(*key, c("cx").alias("px"), c("cy").alias("py"))
        cl = P.sample_bilinear(region_distance, at, keys, sizes, [item], "dist")
        out = out.join(cl.select(*key, c("value").alias("_d")), key, "left").withColumn("edge_clearance", c("_d") - F.coalesce("r", F.lit(0.0))).drop("_d")
    else:
        out = out.withColumn("edge_clearance", F.lit(1e9))
    out = out.withColumn("saturated_frac", F.coalesce("saturated_frac", F.lit(0.0)))
    return out.withColumns({"quality": SC.seed_quality(), "weight": SC.seed_weight()})
