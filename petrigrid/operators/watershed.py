"""Marker-controlled watershed as a minimum spanning forest rooted at the markers.

Flooding from the markers in the order of rising cost reaches every pixel over the lowest pass, so the region of a
marker is its tree in the spanning forest whose edges are ordered by the higher cost of their ends, then by the lower.
The forest grows in Boruvka rounds for all images at once: every part without a marker joins the neighbour over its least
edge, chains of such joins contract to one part, and what is left are the least edges between different parts. Parts
at least halve in every round. Equal costs are told apart by raster order, so the result does not depend on the
order of the work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petrigrid.session import cut

from . import floods
from .components import FOLD, STRIDE, component_roots

c = F.col


def regions(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, y, x, label`` from ``pixels(keys, y, x, cost, marker)``.

    Only the pixels given may be flooded; ``marker`` is the label (above 0) of a seed pixel, else 0. Pixels that no
    marker reaches over their four neighbours have the label 0. Images of up to ``FOLD`` pixels settle in one task each.
    """
    px = cut(pixels.select(*keys, (c("y").cast("long") * STRIDE + c("x")).alias("id"), c("cost").cast("double").alias("cost"), F.coalesce(c("marker"), F.lit(0)).cast("long").alias("marker")))
    n = cut(px.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    out = floods.folded(px.join(n.where(c("_n") <= FOLD).select(*keys), keys, "left_semi"), keys)
    big = n.where(c("_n") > FOLD).select(*keys)
    if big.limit(1).count():
        out = out.unionByName(_grown(px.join(big, keys, "left_semi"), keys))
    return out.select(*keys, F.floor(c("id") / STRIDE).alias("y"), (c("id") % STRIDE).alias("x"), "label")


def _grown(px: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, id, label`` in Boruvka rounds: no task holds an image."""
    # a part is named by a pixel, or below 0 by its marker: the least name of what joins is the marker's
    part = F.when(c("marker") > 0, -c("marker")).otherwise(c("id") + 1)
    node = px.select(*keys, "id", part.alias("part"), F.struct("cost", "id").alias("at"))
    near = node.select(*keys, c("part").alias("a"), c("at").alias("at_a"), F.explode(F.array(c("id") + 1, c("id") + STRIDE)).alias("id"))
    pairs = near.join(node.select(*keys, "id", c("part").alias("b"), c("at").alias("at_b")), [*keys, "id"]).where("a > 0 or b > 0")
    # a marker's own cost bars nobody: its edges wait for the other end only
    high = F.when(c("a") < 0, c("at_b")).when(c("b") < 0, c("at_a")).otherwise(F.greatest("at_a", "at_b"))
    low = F.when(c("a") < 0, c("at_a")).when(c("b") < 0, c("at_b")).otherwise(F.least("at_a", "at_b"))
    edges = _least(pairs.select(*keys, "a", "b", F.struct(high.alias("high"), low.alias("low")).alias("over")), keys)
    state = node.select(*keys, "id", "part")
    while True:
        ways = edges.unionByName(edges.select(*keys, c("b").alias("a"), c("a").alias("b"), "over")).where("a > 0")
        joins = cut(ways.groupBy(*keys, "a").agg(F.min(F.struct("over", "b")).alias("m")).select(*keys, "a", c("m.b").alias("b")))
        if not joins.limit(1).count():
            break
        ends = joins.select(*keys, c("a").alias("node")).union(joins.select(*keys, c("b").alias("node"))).distinct()
        into = cut(component_roots(ends, joins, keys).where("node <> root"))
        state = cut(_renamed(state, into, keys, "part"))
        edges = _least(_renamed(_renamed(edges, into, keys, "a"), into, keys, "b").where("a <> b and (a > 0 or b > 0)"), keys)
    return state.select(*keys, "id", F.when(c("part") < 0, -c("part")).otherwise(F.lit(0)).cast("long").alias("label"))


def _renamed(df: DataFrame, into: DataFrame, keys: list[str], name: str) -> DataFrame:
    named = into.select(*keys, c("node").alias(name), c("root").alias("_to"))
    return df.join(named, [*keys, name], "left").withColumn(name, F.coalesce("_to", name)).select(df.columns)


def _least(edges: DataFrame, keys: list[str]) -> DataFrame:
    """The least edge between each two parts."""
    return cut(edges.groupBy(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("over").alias("over")))
