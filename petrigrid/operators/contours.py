"""Ordered contours of masks by list ranking.

The sides between a mask pixel and what is not in the mask are directed edges with the mask on their right. Each has one
successor, read off the pixels around its end, so the edges form cycles: the outer contour of every component (8
neighbours) and one around every hole. Ranks come from pointer jumping: an edge knows the least edge among the next
2^k and the moves up to it, and looks as far again in every round. Keys with few edges jump inside one task; for the
others a round is one join of all edges. The pixels of a cycle in the order of its edges are the contour as a
walk around the component visits them, clockwise from its first pixel in raster order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from petrigrid.session import cut

from .components import STRIDE

c = F.col
#: Edges of a key that one task ranks.
FOLD = 400_000
# Sides in the order north, east, south, west: the offsets of the pixel across, and for the end of the side the pixel
# ahead on the left, then straight ahead. An edge goes on along the first of them that is in the mask, or turns right.
_ACROSS = [(-1, 0), (0, 1), (1, 0), (0, -1)]
_LEFT = [(-1, 1), (1, 1), (1, -1), (-1, -1)]
_AHEAD = [(0, 1), (1, 0), (0, -1), (-1, 0)]
_AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]


def edges(mask: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, edge, next, moves``: directed sides of mask pixels; ``moves`` is 1 where the next side is of another pixel."""
    seen = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(1 << i).alias("bit")) for i, (dy, dx) in enumerate([*_AROUND, (0, 0)])]))
    told = mask.select(*keys, "y", "x").distinct().withColumn("_s", seen)
    told = told.groupBy(*keys, (c("y") - c("_s.dy")).alias("y"), (c("x") - c("_s.dx")).alias("x")).agg(F.sum("_s.bit").alias("near"))
    own = told.where(c("near").bitwiseAND(1 << len(_AROUND)) != 0)
    has = lambda p: c("near").bitwiseAND(1 << _AROUND.index(p)) != 0
    name = lambda p, side: ((c("y") + p[0]).cast("long") * STRIDE + (c("x") + p[1])) * 4 + side
    sides = []
    for s in range(4):
        left, ahead = _LEFT[s], _AHEAD[s]
        nxt = F.when(has(left), name(left, (s + 3) % 4)).when(has(ahead), name(ahead, s)).otherwise(name((0, 0), (s + 1) % 4))
        sides.append(F.when(~has(_ACROSS[s]), F.struct(name((0, 0), s).alias("edge"), nxt.alias("next"), (has(left) | has(ahead)).cast("long").alias("moves"))))
    return own.select(*keys, F.explode(F.array_compact(F.array(*sides))).alias("_e")).select(*keys, "_e.edge", "_e.next", "_e.moves")


def _folded(e: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, edge, lead, left``: the least edge of each cycle, and the moves from an edge up to it."""
    schema = T.StructType([*[e.schema[k] for k in keys], *[T.StructField(n, T.LongType()) for n in ("edge", "lead", "left")]])
    names = schema.names

    def rank(key: tuple, t: pa.Table) -> pa.Table:
        edge = t.column("edge").to_numpy()
        order = np.argsort(edge)
        edge = edge[order]
        to = np.searchsorted(edge, t.column("next").to_numpy()[order])
        total = t.column("moves").to_numpy()[order].astype(np.int64)  # moves over the whole stretch
        lead, left = np.arange(len(edge)), np.zeros(len(edge), np.int64)
        while True:
            low = lead[to] < lead
            if not low.any():
                break
            left = np.where(low, total + left[to], left)
            lead = np.where(low, lead[to], lead)
            total, to = total + total[to], to[to]
        cols = [*(pa.repeat(k, len(edge)) for k in key), pa.array(edge), pa.array(edge[lead]), pa.array(left)]
        return pa.Table.from_arrays([x.cast(f.type) for x, f in zip(cols, to_arrow_schema(schema), strict=True)], names)

    return e.groupBy(*keys).applyInArrow(rank, schema)


def _jumped(e: DataFrame, keys: list[str]) -> DataFrame:
    """The same in rounds, for all keys at once."""
    state = cut(e.select(*keys, "edge", c("next").alias("to"), c("moves").alias("total"), c("edge").alias("lead"), F.lit(0).cast("long").alias("left")))
    while True:
        far = state.select(*keys, c("edge").alias("to"), c("to").alias("to2"), c("total").alias("total2"), c("lead").alias("lead2"), c("left").alias("left2"))
        low = c("lead2") < c("lead")
        j = state.join(far, [*keys, "to"])
        nxt = cut(j.select(*keys, "edge", c("to2").alias("to"), (c("total") + c("total2")).alias("total"), F.least("lead", "lead2").alias("lead"), F.when(low, c("total") + c("left2")).otherwise(c("left")).alias("left"), low.alias("low")))
        state = nxt.drop("low")
        if not nxt.where("low").limit(1).count():
            return state.select(*keys, "edge", "lead", "left")


def contours(mask: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, contour, outer, i, x, y``: pixel centres of every contour in order, ``i`` from 0.

    ``contour`` is the number of its first edge, so contours ascend in raster order. A pixel that the walk passes
    several times is there as often, but the first one only once. ``outer`` is false around holes, which are walked with
    the mask on the right as well.
    """
    e = cut(edges(mask, keys))
    n = e.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if (n.agg(F.max("_n")).first()[0] or 0) <= FOLD:
        ranked = _folded(e, keys)
    else:
        big = cut(n.where(c("_n") > FOLD).select(*keys))
        ranked = _folded(e.join(big, keys, "left_anti"), keys).unionByName(_jumped(e.join(big, keys, "left_semi"), keys))
    ranked = cut(ranked.join(e, [*keys, "edge"]))
    whole = ranked.groupBy(*keys, "lead").agg(F.sum("moves").alias("points"))
    # a move arrives at the pixel of the next edge; a single pixel has no moves
    alone = ranked.join(whole.where("points = 0").select(*keys, "lead"), [*keys, "lead"], "left_semi").where("edge = lead")
    pixel = lambda n_: (F.floor(c(n_) / 4)).cast("long")
    came = ranked.where("moves = 1").join(whole, [*keys, "lead"]).select(*keys, "lead", pixel("next").alias("p"), ((c("points") - c("left") + 1) % c("points")).alias("i"))
    first = pixel("lead")
    again = came.where((c("p") == first) & (c("i") > 0)).groupBy(*keys, "lead").agg(F.collect_list("i").alias("again"))  # at most three
    came = came.where((c("p") != first) | (c("i") == 0)).join(again, [*keys, "lead"], "left")
    came = came.withColumn("i", c("i") - F.coalesce(F.size(F.filter("again", lambda o: o < c("i"))), F.lit(0)))
    out = came.select(*keys, "lead", "p", "i").unionByName(alone.select(*keys, "lead", first.alias("p"), F.lit(0).cast("long").alias("i")))
    # the least edge of an outer contour is the north side of its first pixel; that of a hole is a south side
    return out.select(*keys, c("lead").alias("contour"), (c("lead") % 4 == 0).alias("outer"), "i", (c("p") % STRIDE + 0.5).alias("x"), (F.floor(c("p") / STRIDE) + 0.5).alias("y"))
