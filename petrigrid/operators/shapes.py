"""Hulls, path simplification, contour points and region finishing."""

from __future__ import annotations

import math
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from petrigrid.session import cut

from .matching import _by_size, _schema

c = F.col
DEALS = 1024  # calls that share the hulls of all keys
MAX_REGION_POINTS = 400
MIN_REGION_SCREEN = 16.0
SIMPLIFY_SCREEN = 1.5


def _extremes(points: DataFrame, keys: list[str], directions: int) -> DataFrame:
    """Points that are extreme in one of evenly spaced directions: all on the hull."""
    import math

    best = None
    aggs = []
    for i in range(directions):
        a = 2 * math.pi * i / directions
        aggs.append(F.max(F.struct((c("x") * math.cos(a) + c("y") * math.sin(a)).alias("s"), "x", "y")).alias(f"e{i}"))
    best = points.groupBy(*keys).agg(*aggs)
    return best.select(*keys, F.array(*[F.struct(c(f"e{i}.x").alias("x"), c(f"e{i}.y").alias("y")) for i in range(directions)]).alias("poly"))


def convex_hull(points: DataFrame, keys: list[str]) -> DataFrame:
    """Convex hull per key, ordered as ``ord`` (GEO1).

    Points first reduce to column extremes (lowest and highest y per x, a grouped
    min/max). Pixel points have as many x as the image is wide, so a hull task sees at
    most two rows per image column; points with fractional x are first thinned to those
    outside the polygon of sixteen extreme directions.
    """
    cols = points.groupBy(*keys, "x").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    e = _extremes(points, keys, 16)
    ends = cols.select(*keys, "x", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("y")).join(e, keys)
    turn = F.zip_with(
        F.concat(F.slice("poly", -1, 1), F.slice("poly", 1, 15)),
        c("poly"),
        lambda a, b: (b["x"] - a["x"]) * (c("y") - a["y"]) - (b["y"] - a["y"]) * (c("x") - a["x"]),
    )
    # strictly left of every side means strictly inside the polygon: never on the hull
    inside = F.forall(turn, lambda t: t > 0)
    out_schema = ", ".join(f"{k} {dict(points.dtypes)[k]}" for k in keys) + ", ord bigint, x double, y double"

    def half(pts):
        h: list[tuple[float, float]] = []
        for p in pts:
            while len(h) >= 2 and (h[-1][0] - h[-2][0]) * (p[1] - h[-2][1]) - (h[-1][1] - h[-2][1]) * (p[0] - h[-2][0]) <= 0:
                h.pop()
            h.append(p)
        return h

    def hulls(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_key=pdf.groupby(keys, sort=False, dropna=False).ngroup())
        flat = sorted(set(zip(pdf["_key"].tolist(), pdf["x"].astype(float).tolist(), pdf["y"].astype(float).tolist(), strict=True)))
        rows = []
        for k, own in groupby(flat, key=lambda p: p[0]):
            pts = [p[1:] for p in own]
            ring = pts if len(pts) < 3 else half(pts)[:-1] + half(pts[::-1])[:-1]
            rows += [(k, i, x, y) for i, (x, y) in enumerate(ring)]
        out = pd.DataFrame(rows, columns=["_key", "ord", "x", "y"])
        names = pdf.drop_duplicates("_key").set_index("_key")[keys]
        return names.loc[out["_key"]].reset_index(drop=True).join(out.drop(columns="_key"))

    # a call in Python takes the hulls of many keys: there are as many calls as deals, not as keys
    dealt = F.pmod(F.xxhash64(*keys), F.lit(DEALS)).alias("_deal")
    return ends.where(~inside).select(dealt, *keys, "x", "y").groupBy("_deal").applyInPandas(lambda pdf: hulls(pdf.drop(columns="_deal")), out_schema)


def plate_shapes(points: DataFrame, keys: list[str], square: float = 0.9, round_: float = 0.9, loose: float = 0.82) -> DataFrame:
    """Shape class per key from how its hull fills its box and its fitted circle (SCA19): square, round or other."""
    from .fits import fit_circles

    ring = cut(convex_hull(points, keys))  # read four times
    n = ring.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    nxt = ring.select(*keys, c("ord").alias("_o"), c("x").alias("bx"), c("y").alias("by"))
    side = ring.join(n, keys).withColumn("_o", (c("ord") + 1) % c("n")).join(nxt, [*keys, "_o"])
    area = side.groupBy(*keys).agg(F.abs(F.sum(c("x") * c("by") - c("bx") * c("y")) / 2).alias("area"))
    j = n.join(area, keys).join(fit_circles(ring, keys), keys, "left")
    box = c("area") / ((c("x1") - c("x0")) * (c("y1") - c("y0")))
    disc = F.coalesce(c("area") / (math.pi * c("cr") * c("cr")), F.lit(0.0))
    shape = F.when(c("n") < 3, "other").when(box > square, "square").when((disc > round_) & (box < loose), "round").otherwise("other")
    return j.select(*keys, shape.alias("shape"), "area")


def _segment_distance(line: bool) -> Column:
    dx, dy = c("bx") - c("ax"), c("by") - c("ay")
    len2 = dx * dx + dy * dy
    ex, ey = c("x") - c("ax"), c("y") - c("ay")
    point = F.sqrt(ex * ex + ey * ey)
    if line:
        return F.when(len2 < 1e-18, point).otherwise(F.abs(dx * -ey + ex * dy) / F.sqrt(len2))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (ex * dx + ey * dy) / len2))
    fx, fy = c("x") - (c("ax") + t * dx), c("y") - (c("ay") + t * dy)
    return F.when(len2 < 1e-12, point).otherwise(F.sqrt(fx * fx + fy * fy))


def simplify_paths(points: DataFrame, keys: list[str], order: str, tolerance: Column, *, line: bool = False) -> DataFrame:
    """Ramer-Douglas-Peucker on open paths with dense positions ``order`` (GEO2).

    Paths that fit a task are split there; longer ones in rounds, with the same result. ``line`` measures to the
    infinite line, else to the segment. ``tolerance`` reads the point columns and is constant within the keys.
    """
    pts = points.select(*keys, c(order).alias("_i"), "x", "y", tolerance.cast("double").alias("_tol"))

    def distances(x: np.ndarray, y: np.ndarray, ax: float, ay: float, bx: float, by: float) -> np.ndarray:
        """The steps of ``_segment_distance`` for many points and one segment."""
        dx, dy = bx - ax, by - ay
        len2 = dx * dx + dy * dy
        ex, ey = x - ax, y - ay
        if len2 < (1e-18 if line else 1e-12):
            return np.sqrt(ex * ex + ey * ey)
        if line:
            return np.abs(dx * -ey + ex * dy) / np.sqrt(len2)
        t = np.maximum(0.0, np.minimum(1.0, (ex * dx + ey * dy) / len2))
        fx, fy = x - (ax + t * dx), y - (ay + t * dy)
        return np.sqrt(fx * fx + fy * fy)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_key", "_i"])
        key, x, y, tol = (pdf[n].to_numpy() for n in ("_key", "x", "y", "_tol"))
        x, y = x.astype(float), y.astype(float)
        keep = np.zeros(len(pdf), bool)
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        todo = list(zip(starts.tolist(), [*(starts[1:] - 1).tolist(), len(pdf) - 1], strict=True))
        for a, b in todo:
            keep[a] = keep[b] = True
        while todo:
            a, b = todo.pop()
            if b - a < 2:
                continue
            d = distances(x[a + 1 : b], y[a + 1 : b], x[a], y[a], x[b], y[b])
            at = int(d.argmax())  # the first on ties
            if d[at] > tol[a]:
                s = a + 1 + at
                keep[s] = True
                todo += [(a, s), (s, b)]
        return pdf.loc[keep, [*keys, "_i", "x", "y"]]

    done = _by_size(pts, keys, fold, _schema(pts, *keys, "_i", "x", "y"), lambda big: _simplify_in_rounds(big, keys, line))
    return done.withColumnRenamed("_i", order)


def _simplify_in_rounds(pts: DataFrame, keys: list[str], line: bool) -> DataFrame:
    """All open segments of all paths split in the same round: per segment the farthest point (first on ties) is a
    grouped maximum, so a long path is never held in one task.
    """
    e = pts.groupBy(*keys).agg(F.min(F.struct("_i", "x", "y")).alias("p"), F.max(F.struct("_i", "x", "y")).alias("q"))
    state = pts.join(e, keys).select(
        *keys, "_i", "x", "y", "_tol", c("p._i").alias("a"), c("p.x").alias("ax"), c("p.y").alias("ay"), c("q._i").alias("b"), c("q.x").alias("bx"), c("q.y").alias("by")
    )
    state = cut(state)
    done = state.where("_i = a or _i = b").select(*keys, "_i", "x", "y")
    state = state.where("_i > a and _i < b")
    while True:
        far = state.groupBy(*keys, "a", "b").agg(F.max(F.struct(_segment_distance(line).alias("d"), (-c("_i")).alias("n"), "x", "y")).alias("m"))
        # a segment without a point beyond the tolerance is settled: its inner points go
        j = state.join(far, [*keys, "a", "b"]).where(c("m.d") > c("_tol"))
        s = -c("m.n")
        lower, upper = c("_i") < s, c("_i") > s
        nxt = cut(j.select(
            *keys, "_i", "x", "y", "_tol", (c("_i") == s).alias("_keep"),
            *[F.when(upper, v).otherwise(c(n)).alias(n) for n, v in (("a", s), ("ax", c("m.x")), ("ay", c("m.y")))],
            *[F.when(lower, v).otherwise(c(n)).alias(n) for n, v in (("b", s), ("bx", c("m.x")), ("by", c("m.y")))],
        ))
        if nxt.limit(1).count() == 0:
            break
        done = done.unionByName(nxt.where("_keep").select(*keys, "_i", "x", "y"))
        state = nxt.where("not _keep").drop("_keep")
    return done


def simplify_closed(points: DataFrame, keys: list[str], order: str, tolerance: Column) -> DataFrame:
    """Simplify closed loops: split at the point farthest from the first, simplify both halves (GEO2).

    ``order`` is dense from 0. A closing point equal to the first is dropped.
    """
    p = points.withColumn("_tol", tolerance)
    n = p.groupBy(*keys).agg(F.max(order).alias("last"))
    first = p.where(c(order) == 0).select(*keys, c("x").alias("x0"), c("y").alias("y0"))
    j = p.join(n, keys).join(first, keys)
    closing = (c(order) == c("last")) & (c("last") > 0) & (c("x") == c("x0")) & (c("y") == c("y0"))
    ring = cut(j.where(~closing).drop("last"))
    size = ring.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    d = F.sqrt((c("x") - c("x0")) * (c("x") - c("x0")) + (c("y") - c("y0")) * (c("y") - c("y0")))
    far = ring.groupBy(*keys).agg(F.max(F.struct(d.alias("d"), (-c(order)).alias("n"))).alias("m")).select(*keys, (-c("m.n")).alias("far"))
    ring = ring.join(size, keys).join(far, keys)
    tiny = ring.where("n <= 3").select(*keys, order, "x", "y")
    big = ring.where("n > 3")
    one = big.where(c(order) <= c("far")).withColumn("half", F.lit(0))
    two = big.where(c(order) >= c("far")).withColumn("half", F.lit(1))
    close = big.where(c(order) == 0).withColumns({"half": F.lit(1), order: c("n")})
    halves = one.unionByName(two).unionByName(close).select(*keys, "half", order, "x", "y", "_tol")
    s = simplify_paths(halves, [*keys, "half"], order, c("_tol")).join(size, keys).join(far, keys)
    # the second half repeats the split point and the start
    s = s.where((c("half") == 0) | ((c(order) != c("far")) & (c(order) != c("n"))))
    return tiny.unionByName(s.select(*keys, order, "x", "y"))


def finish_lasso(points: DataFrame, keys: list[str], order: str, scale: float, width: float, height: float) -> DataFrame:
    """Stored region of each hand-drawn loop (SCA13): clamped, rounded, simplified, refused when too small.

    A loop with more than 400 points left is simplified again with a tolerance 1.6 times
    as large, until it fits.
    """
    from petrigrid.functions.geometry import clamp_point
    from petrigrid.plans.ranks import ordered_rank

    q = clamp_point(F.struct(c("x").cast("double").alias("x"), c("y").cast("double").alias("y")), F.lit(width), F.lit(height))
    p = ordered_rank(points, keys, order, "_r").withColumn("q", q).select(*keys, (c("_r") - 1).alias("ord"), c("q.x").alias("x"), c("q.y").alias("y"))
    p = cut(p)
    tol = SIMPLIFY_SCREEN / scale
    done, todo = None, p
    while True:
        s = cut(simplify_closed(todo, keys, "ord", F.lit(tol)))
        over = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(c("n") > MAX_REGION_POINTS).select(*keys)
        fits = s.join(over, keys, "left_anti")
        done = fits if done is None else done.unionByName(fits)
        if over.limit(1).count() == 0:
            break
        todo, tol = cut(todo.join(over, keys, "left_semi")), tol * 1.6
    w = W.partitionBy(*keys).orderBy("ord")  # at most 400 points are left per loop
    e = done.withColumns({"nx": F.coalesce(F.lead("x").over(w), F.first("x").over(w)), "ny": F.coalesce(F.lead("y").over(w), F.first("y").over(w))})
    b = e.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"), (F.max("x") - F.min("x")).alias("bw"), (F.max("y") - F.min("y")).alias("bh"), (F.abs(F.sum((c("x") + c("nx")) * (c("y") - c("ny")))) / 2).alias("area")
    )
    side = MIN_REGION_SCREEN / scale
    bad = (c("points") < 3) | (c("bw") < side) | (c("bh") < side) | (c("area") < 0.25 * side * side)
    return b.select(*keys, "points", "area", bad.alias("too_small"))


def concave_points(contours: DataFrame, mask: DataFrame, keys: list[str], contour: list[str], k: int) -> DataFrame:
    """Deepest points where a contour bends inwards (GEO3).

    ``contours(keys, contour.., i, x, y)`` with dense ``i``; the chord between i-k and i+k
    is an equi-join on position modulo the length, its midpoint an equi-join on the mask.
    """
    key = [*keys, *contour]
    n = contours.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(c("n") >= 2 * k + 1)
    p = contours.join(n, key)
    fwd = p.select(*key, F.pmod(c("i") + k, c("n")).alias("i"), c("x").alias("ax"), c("y").alias("ay"))
    bwd = p.select(*key, F.pmod(c("i") - k, c("n")).alias("i"), c("x").alias("bx"), c("y").alias("by"))
    j = p.join(fwd, [*key, "i"]).join(bwd, [*key, "i"]).withColumns({"mx": (c("ax") + c("bx")) / 2, "my": (c("ay") + c("by")) / 2})
    inside = mask.select(*keys, c("x").alias("_mx"), c("y").alias("_my"), F.lit(True).alias("_in"))
    j = j.withColumns({"_mx": F.floor("mx"), "_my": F.floor("my")}).join(inside, [*keys, "_mx", "_my"], "left")
    depth = F.when(c("_in").isNull(), F.sqrt((c("x") - c("mx")) * (c("x") - c("mx")) + (c("y") - c("my")) * (c("y") - c("my")))).otherwise(0.0)
    d = j.select(*key, "i", "n", "x", "y", depth.alias("depth"))
    # rivals within k steps: only deep points can win or beat, and each meets 2k positions
    deep = d.where("depth > 0.75")
    r = deep.select(*key, c("i").alias("ri"), c("depth").alias("rd"), "n").withColumn("s", F.explode(F.array(*[F.lit(s) for s in range(-k, k + 1) if s]))).withColumn("i", F.pmod(c("ri") - c("s"), c("n")))
    beaten = deep.join(r.drop("n"), [*key, "i"]).where((c("rd") > c("depth")) | ((c("rd") == c("depth")) & (c("s") < 0))).select(*key, "i").distinct()
    return deep.join(beaten, [*key, "i"], "left_anti")


def split_arcs(contours: DataFrame, cuts: DataFrame, key: list[str]) -> DataFrame:
    """Arc number of each contour point: arcs run from a cut to the next, both ends included (GEO3)."""
    n = contours.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(*key).orderBy("i")
    cc = cuts.select(*key, "i").withColumns({"arc": F.row_number().over(w) - 1, "nxt": F.lead("i").over(w), "c0": F.first("i").over(w)}).join(n, key)
    cc = cc.withColumn("stop", F.coalesce("nxt", c("c0") + c("n")))
    at = cc.withColumn("pos", F.explode(F.sequence("i", "stop"))).select(*key, "arc", "pos", F.pmod("pos", c("n")).alias("i"))
    arcs = at.join(contours, [*key, "i"])
    whole = contours.join(cuts.select(*key).distinct(), key, "left_anti").withColumns({"arc": F.lit(0), "pos": c("i")})
    return arcs.select(*key, "arc", "pos", "x", "y").unionByName(whole.select(*key, "arc", "pos", "x", "y"))
