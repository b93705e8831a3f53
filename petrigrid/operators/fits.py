"""Circle fits from grouped moments, refinement rounds, consensus."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from petrigrid.plans.grid import distance

c = F.col
TAU = 2 * math.pi
ORDERED = 100_000  # angles that one task orders, about


def fit_circles(points: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares circle per key (FIT1); collinear points and fewer than three give none.

    A circle is linear in the squared norm: x^2 + y^2 = 2 cx x + 2 cy y + const. So its centre is half
    the slopes of a regression on (x, y), read off the covariances of one map-side-combined pass, and its
    squared radius is the mean squared distance to that centre.
    """
    q = c("x") * c("x") + c("y") * c("y")
    cov = {"xx": F.var_pop("x"), "yy": F.var_pop("y"), "xy": F.covar_pop("x", "y"), "xq": F.covar_pop("x", q), "yq": F.covar_pop("y", q)}
    s = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), *[e.alias(k) for k, e in cov.items()])
    s = s.withColumn("spread", c("xx") * c("yy") - c("xy") * c("xy")).where((c("n") >= 3) & (c("n") * c("n") * c("spread") >= 1e-9))
    s = s.withColumns({"cx": (c("xq") * c("yy") - c("yq") * c("xy")) / (2 * c("spread")), "cy": (c("yq") * c("xx") - c("xq") * c("xy")) / (2 * c("spread"))})
    off = (c("mx") - c("cx")) * (c("mx") - c("cx")) + (c("my") - c("cy")) * (c("my") - c("cy"))
    return s.select(*keys, "cx", "cy", F.sqrt(off + c("xx") + c("yy")).alias("cr"))


def refine_circles(points: DataFrame, circles: DataFrame, keys: list[str], iterations: int = 10) -> DataFrame:
    """Circles moved to the least orthogonal distances: at most ten rounds of grouped sums for all keys at once (FIT2).

    For a given centre the best radius is the mean distance, so the radius is eliminated: the centre steps along
    the regression of the distances on the unit vectors to the points, whose covariances one pass delivers.
    """
    from petrigrid.session import cut

    state = circles.withColumn("live", F.lit(True))
    for _ in range(iterations):
        p = points.join(state.where("live"), keys)
        d = distance(c("x"), c("y"), c("cx"), c("cy"))
        p = p.withColumn("_d", F.when(d == 0, 1e-9).otherwise(d)).withColumns({"_u": (c("cx") - c("x")) / c("_d"), "_v": (c("cy") - c("y")) / c("_d")})
        g = p.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_n"), F.avg("_d").alias("_md"), F.avg("_u").alias("_mu"), F.avg("_v").alias("_mv"), F.var_pop("_u").alias("_uu"), F.var_pop("_v").alias("_vv"),
            F.covar_pop("_u", "_v").alias("_uv"), F.covar_pop("_u", "_d").alias("_ud"), F.covar_pop("_v", "_d").alias("_vd"),
        )
        g = g.withColumn("_w", c("_uu") * c("_vv") - c("_uv") * c("_uv")).where(c("_n") * c("_n") * c("_n") * c("_w") >= 1e-12)
        g = g.withColumns({"_su": (c("_ud") * c("_vv") - c("_vd") * c("_uv")) / c("_w"), "_sv": (c("_vd") * c("_uu") - c("_ud") * c("_uv")) / c("_w")})
        j = state.join(g.select(*keys, "_su", "_sv", (c("_md") - c("_mu") * c("_su") - c("_mv") * c("_sv")).alias("_r")), keys, "left")
        go = c("live") & c("_r").isNotNull()
        moved = F.abs("_su") + F.abs("_sv") + F.abs(c("_r") - c("cr"))
        state = cut(j.select(*keys, *[F.when(go, new).otherwise(c(old)).alias(old) for old, new in (("cx", c("cx") - c("_su")), ("cy", c("cy") - c("_sv")), ("cr", c("_r")))], (go & (moved >= 1e-4)).alias("live")))
        if state.where("live").limit(1).count() == 0:
            break
    return state.select(*keys, "cx", "cy", F.abs("cr").alias("cr"))


def circle_residual(points: DataFrame, circles: DataFrame, keys: list[str]) -> DataFrame:
    """RMS orthogonal distance to the circle (FIT3)."""
    d = distance(c("x"), c("y"), c("cx"), c("cy")) - c("cr")
    return points.join(circles, keys).groupBy(*keys).agg(F.sqrt(F.sum(d * d) / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("residual"))


def arc_span(points: DataFrame, centres: DataFrame, keys: list[str]) -> DataFrame:
    """Angle the points subtend around a centre: 2 pi minus the widest gap (FIT3).

    Angles fall into 64 sectors; gaps inside a sector come from a window over one
    sector, gaps between sectors from their first and last angles (64 rows per key).
    """
    a = points.join(centres, keys).select(*keys, F.atan2(c("y") - c("cy"), c("x") - c("cx")).alias("t"))
    a = a.withColumn("sec", F.floor((c("t") + math.pi) / (TAU / 64)))
    # a task orders a set number of angles, however many points there are
    a = a.repartition(1 + points.count() // ORDERED, *keys, "sec")
    prev = F.lag("t").over(W.partitionBy(*keys, "sec").orderBy("t"))
    inner = a.withColumn("gap", c("t") - prev).groupBy(*keys, "sec").agg(F.max("gap").alias("gap"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(*keys).orderBy("sec")
    joined = inner.withColumn("between", c("t0") - F.lag("t1").over(w))
    s = joined.groupBy(*keys).agg(F.greatest(F.max("gap"), F.max("between"), F.min("t0") + TAU - F.max("t1")).alias("widest"), F.sum("_n").alias("_n"))
    return s.select(*keys, F.when(c("_n") < 2, 0.0).otherwise(F.lit(TAU) - c("widest")).alias("span"))


def consensus_circles(points: DataFrame, keys: list[str], item: str, tol: float, triples: int = 200, seed: str = "0") -> DataFrame:
    """Robust circle: seeded minimal triples, most inliers wins, refit on the inliers (FIT4).

    Each triple is three hashed positions among all points of the key in the order of ``item`` (an integer); a
    triple that names one point twice, or is collinear, draws nothing. Every point is tested against the
    triples of its key only.
    """
    from petrigrid.plans.ranks import ordered_rank
    from petrigrid.session import cut

    n = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    draw = n.withColumn("triple", F.explode(F.sequence(F.lit(0), F.lit(triples - 1))))
    at = [F.pmod(F.xxhash64(F.lit(seed), *[c(k) for k in keys], "triple", F.lit(i)), c("_n")) + 1 for i in range(3)]
    draw = draw.select(*keys, "triple", F.explode(F.array_distinct(F.array(*at))).alias("_at"))
    tri = ordered_rank(points, keys, item, "_at").join(draw, [*keys, "_at"])
    cand = fit_circles(tri.select(*keys, "triple", "x", "y"), [*keys, "triple"])
    near = F.abs(distance(c("x"), c("y"), c("cx"), c("cy")) - c("cr")) <= tol
    votes = points.join(cand, keys).where(near).groupBy(*keys, "triple", "cx", "cy", "cr").agg(F.count(F.lit(1)).alias("inliers"))
    best = votes.groupBy(*keys).agg(F.max(F.struct("inliers", (-c("triple")).alias("t"), "cx", "cy", "cr")).alias("m")).select(*keys, c("m.inliers").alias("inliers"), "m.cx", "m.cy", "m.cr")
    best = cut(best)  # every round of the refit reads the inliers: drawn and voted once
    inl = cut(points.join(best, keys).where(near).select(*keys, "x", "y"))
    fit = refine_circles(inl, fit_circles(inl, keys), keys)
    fit = fit.select(*keys, c("cx").alias("fx"), c("cy").alias("fy"), c("cr").alias("fr"))
    return best.join(fit, keys, "left").select(*keys, F.coalesce("fx", "cx").alias("cx"), F.coalesce("fy", "cy").alias("cy"), F.coalesce("fr", "cr").alias("cr"), "inliers")


def recentre(inliers: DataFrame, points: DataFrame, keys: list[str], passes: int = 2) -> DataFrame:
    """Circle through the inliers, then refitted with all points close to it (FIT5)."""
    from petrigrid.session import cut

    circle = cut(fit_circles(inliers, keys))
    for _ in range(passes):
        tol = F.greatest(F.lit(1.0), c("cr") * 0.15)
        near = points.join(circle, keys).where(F.abs(distance(c("x"), c("y"), c("cx"), c("cy")) - c("cr")) <= tol).select(*keys, "x", "y")
        near = cut(near)
        enough = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 8").select(*keys)
        nxt = fit_circles(near.join(enough, keys, "left_semi"), keys).select(*keys, c("cx").alias("nx"), c("cy").alias("ny"), c("cr").alias("nr"))
        circle = cut(circle.join(nxt, keys, "left").select(*keys, F.coalesce("nx", "cx").alias("cx"), F.coalesce("ny", "cy").alias("cy"), F.coalesce("nr", "cr").alias("cr")))
    return circle
