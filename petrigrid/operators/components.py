"""Connected components of masks: runs, contraction to component minima, labels, holes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window as W

from petrigrid.plans.ranks import ordered_rank
from petrigrid.session import cut

c = F.col
BLOCK = 64
FOLD = 200_000  # links of a key that one task settles
STRIDE = 1 << 31  # node id = y * STRIDE + first x: raster order of first pixels


def runs(mask: DataFrame, keys: list[str]) -> DataFrame:
    """Horizontal runs of mask pixels ``(keys, y, x)``: one row per run, windows hold one raster row."""
    w = W.partitionBy(*keys, "y").orderBy("x")
    g = mask.select(*keys, "y", "x", (c("x") - F.row_number().over(w)).alias("_g"))
    r = g.groupBy(*keys, "y", "_g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_g")
    return r.withColumn("node", c("y").cast("bigint") * STRIDE + c("x0"))


def touching(r: DataFrame, keys: list[str], connectivity: int = 8) -> DataFrame:
    """Pairs of touching runs in neighbouring rows, ``a`` above ``b``.

    Runs join on blocks of 64 columns, so a busy row never pairs all its runs.
    """
    slack = 1 if connectivity == 8 else 0
    span = lambda lo, hi: F.explode(F.sequence(F.floor(lo / BLOCK), F.floor(hi / BLOCK)))
    up = r.select(*keys, (c("y") + 1).alias("y"), c("x0").alias("a0"), c("x1").alias("a1"), c("node").alias("a")).withColumn("blk", span(c("a0") - slack, c("a1") + slack))
    down = r.select(*keys, "y", c("x0").alias("b0"), c("x1").alias("b1"), c("node").alias("b")).withColumn("blk", span(c("b0"), c("b1")))
    j = up.join(down, [*keys, "y", "blk"]).where((c("a0") - slack <= c("b1")) & (c("b0") <= c("a1") + slack))
    # a pair is reported in the first block both cover
    first = F.greatest(F.floor((c("a0") - slack) / BLOCK), F.floor(c("b0") / BLOCK))
    return j.where(c("blk") == first).select(*keys, "a", "b")


def _folded(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, node, root`` of keys whose links fit a task: every pass takes minima over all links at once and halves the paths."""
    schema = T.StructType([*[edges.schema[k] for k in keys], T.StructField("node", T.LongType()), T.StructField("root", T.LongType())])
    names = schema.names

    def settle(key: tuple, t: pa.Table) -> pa.Table:
        node, at = np.unique(np.concatenate([t.column("u").to_numpy(), t.column("v").to_numpy()]), return_inverse=True)
        a, b = at[: t.num_rows], at[t.num_rows :]
        label = np.arange(len(node))
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            for x in (a, b, label[a], label[b]):
                np.minimum.at(new, x, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        cols = [pa.repeat(k, len(node)) for k in key] + [pa.array(node), pa.array(node[label])]
        return pa.Table.from_arrays([x.cast(f.type) for x, f in zip(cols, to_arrow_schema(schema), strict=True)], names)

    return edges.select(*keys, "u", "v").groupBy(*keys).applyInArrow(settle, schema)


def component_roots(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest node of each component: keys of up to ``FOLD`` links settle in one task each, larger ones in rounds."""
    pairs = cut(edges.select(*keys, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    n = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    most = n.agg(F.max("_n")).first()[0] or 0
    if most <= FOLD:
        roots = _folded(pairs, keys)
    else:
        big = cut(n.where(c("_n") > FOLD).select(*keys))
        roots = _folded(pairs.join(big, keys, "left_anti"), keys).unionByName(_contracted(pairs.join(big, keys, "left_semi"), keys))
    return nodes.select(*keys, "node").join(roots, [*keys, "node"], "left").withColumn("root", F.coalesce("root", "node"))


def _contracted(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, node, root`` by alternating large-star and small-star contraction.

    Each round is two grouped minima; the number of rounds grows with the logarithm of
    the component size, not with its diameter.
    """
    k = keys
    state = pairs

    def signature(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*k, "u", "v").cast("decimal(38,0)"))).first()

    before = signature(state)
    while before[0]:
        # large-star: every larger neighbour of u points to the smallest neighbour of u
        both = state.select(*k, "u", "v").unionByName(state.select(*k, c("v").alias("u"), c("u").alias("v")))
        low = both.groupBy(*k, "u").agg(F.least(F.min("v"), c("u")).alias("m"))
        large = both.join(low, [*k, "u"]).where("v > u").select(*k, c("v").alias("u"), c("m").alias("v")).where("u <> v").distinct()
        # small-star: u and its smaller neighbours point to the smallest of them
        small_low = large.groupBy(*k, "u").agg(F.min("v").alias("m"))
        s = large.join(small_low, [*k, "u"])
        small = s.select(*k, c("v").alias("u"), c("m").alias("v")).unionByName(s.select(*k, "u", c("m").alias("v"))).where("u <> v").distinct()
        state = cut(small)
        now = signature(state)
        if now == before:
            break
        before = now
    return state.groupBy(*k, c("u").alias("node")).agg(F.min("v").alias("root"))


def _labelled(px: DataFrame, keys: list[str], connectivity: int) -> DataFrame:
    """``keys, y, x0, x1, label`` of images that fit a task: runs, their links and their order in one fold."""
    names = ["y", "x0", "x1", "label"]
    schema = T.StructType([*[px.schema[k] for k in keys], *[T.StructField(n, T.LongType()) for n in names]])
    arrow, slack = to_arrow_schema(schema), 1 if connectivity == 8 else 0

    def settle(key: tuple, t: pa.Table) -> pa.Table:
        at = np.unique(t.column("y").to_numpy() * STRIDE + t.column("x").to_numpy())  # raster order; lines are far apart
        first = np.flatnonzero(np.append(True, np.diff(at) != 1))
        lo, hi = at[first], at[np.append(first[1:], len(at)) - 1]
        # runs of the next line that reach from the first to the last pixel of a run
        a0 = np.searchsorted(hi, lo + STRIDE - slack)
        n = np.maximum(np.searchsorted(lo, hi + STRIDE + slack, "right") - a0, 0)
        a = np.repeat(np.arange(len(lo)), n)
        b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a0, n)
        root = np.arange(len(lo))
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            for x in (a, b, root[a], root[b]):
                np.minimum.at(new, x, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        label = np.unique(root, return_inverse=True)[1] + 1
        cols = [pa.repeat(k, len(lo)) for k in key] + [pa.array(x) for x in (lo // STRIDE, lo % STRIDE, hi % STRIDE, label)]
        return pa.Table.from_arrays([x.cast(f.type) for x, f in zip(cols, arrow, strict=True)], schema=arrow)

    return px.groupBy(*keys).applyInArrow(settle, schema)


def label_components(mask: DataFrame, keys: list[str], connectivity: int = 8) -> tuple[DataFrame, DataFrame]:
    """Labels per run and statistics per component, numbered in raster order of first pixels (PIX10).

    Images of up to ``FOLD`` mask pixels settle in one task each.
    """
    px = cut(mask.select(*keys, c("y").cast("long").alias("y"), c("x").cast("long").alias("x")))
    n = cut(px.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    j = _labelled(px.join(n.where(c("_n") <= FOLD).select(*keys), keys, "left_semi"), keys, connectivity)
    big = n.where(c("_n") > FOLD).select(*keys)
    if big.limit(1).count():
        j = j.unionByName(_joined_labels(px.join(big, keys, "left_semi"), keys, connectivity))
    j = cut(j)
    n = c("x1") - c("x0") + 1
    stats = j.groupBy(*keys, "label").agg(
        F.sum(n).alias("area"), F.min("x0").alias("min_x"), F.min("y").alias("min_y"), F.max("x1").alias("max_x"), F.max("y").alias("max_y"),
        (F.sum(n * (c("x0") + c("x1") + 1) / 2) / F.sum(n)).alias("cx"), (F.sum(n * (c("y") + 0.5)) / F.sum(n)).alias("cy"),
    )
    return j, cut(stats.select(*keys, "area", "min_x", "min_y", "max_x", "max_y", "cx", "cy", "label"))


def _joined_labels(px: DataFrame, keys: list[str], connectivity: int) -> DataFrame:
    """What ``_labelled`` gives, by joins of runs: no task holds an image."""
    r = cut(runs(px, keys))
    roots = component_roots(r, touching(r, keys, connectivity), keys)
    j = r.join(roots, [*keys, "node"])
    found = ordered_rank(j.select(*keys, "root").distinct(), keys, "root", "label", chunk=F.floor(c("root") / (STRIDE * 64)))
    return j.join(found.select(*keys, "root", "label"), [*keys, "root"]).select(*keys, "y", "x0", "x1", c("label").cast("long").alias("label"))


def to_pixels(run_rows: DataFrame, keys: list[str], *extra: str) -> DataFrame:
    return run_rows.select(*keys, "y", F.explode(F.sequence("x0", "x1")).alias("x"), *extra)


def labelled_pixels(mask: DataFrame, keys: list[str], connectivity: int = 8) -> DataFrame:
    run_rows, _ = label_components(mask, keys, connectivity)
    return to_pixels(run_rows, keys, "label")


def holes(raster: DataFrame, keys: list[str], sizes: DataFrame, on: str = "on") -> tuple[DataFrame, DataFrame]:
    """Background regions not 4-connected to the raster border: runs and statistics."""
    run_rows, stats = label_components(raster.where(~c(on)), keys, 4)
    inner = stats.join(sizes, keys).where((c("min_x") > 0) & (c("min_y") > 0) & (c("max_x") < c("w") - 1) & (c("max_y") < c("h") - 1))
    return run_rows, inner.select(*keys, "label", "area")


def fill_holes(raster: DataFrame, keys: list[str], sizes: DataFrame, max_area=None, on: str = "on") -> DataFrame:
    """Fill holes (all, or those smaller than the column ``max_area`` of ``sizes``) (PIX11)."""
    run_rows, inner = holes(raster, keys, sizes, on)
    if max_area is not None:
        inner = inner.join(sizes.select(*keys, c(max_area).alias("_max")), keys).where(c("area") < c("_max"))
    filled = to_pixels(run_rows.join(inner.select(*keys, "label"), [*keys, "label"], "left_semi"), keys).withColumn("_f", F.lit(True))
    return raster.join(filled, [*keys, "y", "x"], "left").withColumn(on, c(on) | F.coalesce("_f", F.lit(False))).drop("_f")


def drop_specks(raster: DataFrame, keys: list[str], limits: DataFrame, min_area: str, on: str = "on") -> DataFrame:
    """Remove components smaller than the column ``min_area`` of ``limits(keys, ...)`` (PIX11)."""
    run_rows, stats = label_components(raster.where(c(on)), keys, 8)
    small = stats.join(limits.select(*keys, c(min_area).alias("_min")), keys).where(c("area") < c("_min")).select(*keys, "label")
    gone = to_pixels(run_rows.join(small, [*keys, "label"], "left_semi"), keys).withColumn("_s", F.lit(True))
    return raster.join(gone, [*keys, "y", "x"], "left").withColumn(on, c(on) & c("_s").isNull()).drop("_s")
