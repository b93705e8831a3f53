"""Nearest points, cover joins, polygon joins, label lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petrigrid.functions.geometry import crosses
from petrigrid.plans import grid

c = F.col
COVER = 0.7


def candidate_pairs(pred: DataFrame, gt: DataFrame, keys: list[str], radius: float, pred_id: str, gt_id: str) -> DataFrame:
    """All pairs within an inclusive radius (JON1)."""
    p = grid.pairs_in_reach(pred.select(*keys, pred_id, "x", "y"), gt.select(*keys, gt_id, "x", "y"), keys, F.lit(float(radius)), strict=False)
    return p.select(*keys, pred_id, c("o_" + gt_id).alias(gt_id), "d")


def nearest(
    probes: DataFrame, points: DataFrame, keys: list[str], reach: Column, probe_id: str, point_id: str, order: str, *, extra: Column | None = None, size: float = grid.CELL
) -> DataFrame:
    """Nearest point per probe within an inclusive ``reach``; ties to the later row (JON3-6).

    The winner is a minimum over (distance, -order), which combines map-side. Of
    points at one position (and with equal filter columns) only the last can win, so
    copies collapse before the join. ``extra`` filters pairs: probe columns plain,
    point columns prefixed ``o_``.
    """
    others = [n for n in points.columns if n not in (*keys, "x", "y", point_id, order)]
    last = points.groupBy(*keys, "x", "y", *others).agg(F.max(F.struct(order, point_id)).alias("m")).select(*keys, "x", "y", *others, c(f"m.{order}").alias(order), c(f"m.{point_id}").alias(point_id))
    p = grid.pairs_in_reach(probes, last, keys, reach, strict=False, size=size, extra=extra)
    best = p.groupBy(*keys, probe_id).agg(F.min(F.struct("d", (-c("o_" + order)).alias("neg"), c("o_" + point_id).alias("id"))).alias("m"))
    return best.select(*keys, probe_id, c("m.id").alias("nearest_id"), c("m.d").alias("d"))


def double_marks(marks: DataFrame, visible: DataFrame, keys: list[str], reach: Column, item: str, order: str) -> DataFrame:
    """Nearest other visible mark within ``reach`` of each mark (JON5).

    At one position only the last two marks can be an answer (the last, or the one
    before it for the last itself), so a heap of copies contributes two rows. The rank
    is limited, so Spark applies it before the shuffle as well.
    """
    from pyspark.sql.window import Window as W

    w = W.partitionBy(*keys, "x", "y").orderBy(c(order).desc())
    top = visible.select(*keys, item, "x", "y", order).withColumn("_rk", F.row_number().over(w)).where(c("_rk") <= 2).drop("_rk")
    p = grid.pairs_in_reach(marks.select(*keys, item, "x", "y", reach.alias("_own")), top, keys, c("_own"), strict=False, extra=c("o_" + item) != c(item))
    best = p.groupBy(*keys, item).agg(F.min(F.struct("d", (-c("o_" + order)).alias("neg"), c("o_" + item).alias("id"))).alias("m"))
    return best.select(*keys, item, c("m.id").alias("nearest_id"), c("m.d").alias("d"))


def uncovered(suggestions: DataFrame, marks: DataFrame, keys: list[str], item: str, factor: float = COVER) -> DataFrame:
    """Suggestions without a mark closer than ``factor * r`` (strict) (JON7)."""
    hit = grid.hits(suggestions, marks, keys, item, c("r") * factor, strict=True)
    return suggestions.join(hit, [*keys, item], "left_anti")


def covered(suggestions: DataFrame, marks: DataFrame, keys: list[str], item: str, factor: float = COVER) -> DataFrame:
    hit = grid.hits(suggestions, marks, keys, item, c("r") * factor, strict=True)
    return suggestions.join(hit, [*keys, item], "left_semi")


def not_near_fixed(items: DataFrame, fixed: DataFrame, keys: list[str], item: str, factor: float = 0.6) -> DataFrame:
    """Items farther than ``factor * max(r, fixed r)`` from every fixed circle (JON8)."""
    return items.join(grid.hits_larger(items, fixed, keys, item, factor), [*keys, item], "left_anti")


def carried_rejections(new: DataFrame, rejected: DataFrame, keys: list[str], item: str) -> DataFrame:
    """New suggestions on a previously rejected one stay rejected (JON9)."""
    return grid.hits_larger(new, rejected, keys, item, COVER)


def in_region(points: DataFrame, vertices: DataFrame, item: str, keys: list[str], cell: float = 256.0) -> DataFrame:
    """(region, item) pairs with the point inside the polygon, even-odd, bounding box first (JON10).

    Regions with fewer than three vertices select nothing. Edges stay rows: a point
    meets the edges of the rows of cells it lies in, and inside means an odd number
    of crossings, a sum that combines map-side. Only edges whose y-range covers the
    point's cell row can be crossed, so a hot image splits over its rows.
    """
    n = vertices.groupBy(*keys, "region_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    ).where("n >= 3")
    nxt = vertices.join(n, [*keys, "region_id"])
    prev = nxt.select(*keys, "region_id", ((c("ord") + 1) % c("n")).alias("ord"), c("x").alias("bx"), c("y").alias("by"))
    edges = nxt.select(*keys, "region_id", "ord", c("x").alias("ax"), c("y").alias("ay"), "x0", "x1", "y0", "y1").join(prev, [*keys, "region_id", "ord"])
    lo, hi = F.least("ay", "by"), F.greatest("ay", "by")
    rows = edges.where(c("ay") != c("by")).withColumn("cy", F.explode(F.sequence(grid.cell(lo, cell), grid.cell(hi, cell)))).drop("ord")
    p = points.select(*keys, item, c("x").alias("px"), c("y").alias("py")).withColumn("cy", grid.cell(c("py"), cell))
    boxed = (c("px") >= c("x0")) & (c("px") <= c("x1")) & (c("py") >= c("y0")) & (c("py") <= c("y1"))
    hit = p.join(rows, [*keys, "cy"]).where(boxed & crosses(c("px"), c("py"), c("ax"), c("ay"), c("bx"), c("by")))
    odd = hit.groupBy(*keys, "region_id", item).agg(F.count(F.lit(1)).alias("k")).where("k % 2 = 1")
    return odd.select(*keys, "region_id", item)


def label_at(points: DataFrame, labels: DataFrame, keys: list[str], scale: float = 1.0, ox: float = 0.0, oy: float = 0.0) -> DataFrame:
    """Raster label under each point, 0 outside (JON11)."""
    at = points.withColumns({"_lx": F.floor((c("x") - ox) * scale), "_ly": F.floor((c("y") - oy) * scale)})
    l = labels.select(*keys, c("x").alias("_lx"), c("y").alias("_ly"), c("label").alias("_label"))
    return at.join(l, [*keys, "_lx", "_ly"], "left").withColumn("label", F.coalesce("_label", F.lit(0)).cast("bigint")).drop("_lx", "_ly", "_label")
