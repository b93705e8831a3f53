"""Rasters as tiles: one row per 64 x 64 pixels, its planes as arrays.

A filter of a small window runs on a tile and the strips that its neighbours send it (``stencil``): one exchange moves
borders instead of pixels, and any number of columns and steps share it. A separable filter of any width runs on bands
of tiles that span the raster along one axis (``bands``), so each pixel moves once an axis however wide the kernel is.
Widths may be a column, one per image. A raster must hold all pixels of its rectangle; its first pixel is (0, 0).

Tile rows: the keys, ``ty, tx`` (place in the grid), ``y0, x0, h, w`` (rectangle), and one array per plane, row by row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pixels import box_radii, gaussian_kernel, nearest_squared

c = F.col
SIDE = 64
PLACE = ["ty", "tx", "y0", "x0", "h", "w"]
Planes = dict[str, np.ndarray]


def to_tiles(pixels: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Tiles of a pixel table; truth values become 0 and 1."""
    px = pixels.select(*keys, c("y").cast("long").alias("y"), c("x").cast("long").alias("x"), *[c(n).cast("double").alias(n) for n in columns])
    at = [F.floor(c(a) / SIDE).cast("long").alias("t" + a) for a in ("y", "x")]
    g = px.groupBy(*keys, *at).agg(F.min("y").alias("y0"), F.min("x").alias("x0"), (F.max("y") - F.min("y") + 1).alias("h"), (F.max("x") - F.min("x") + 1).alias("w"), F.sort_array(F.collect_list(F.struct("y", "x", *columns))).alias("px"))
    return g.select(*keys, *PLACE, *[c(f"px.{n}").alias(n) for n in columns])


def from_tiles(tiles: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Pixel rows of tiles."""
    at = F.posexplode(F.arrays_zip(*columns)).alias("i", "z")
    rows = tiles.select(*keys, "y0", "x0", "w", at)
    return rows.select(*keys, (c("y0") + F.floor(c("i") / c("w"))).alias("y"), (c("x0") + c("i") % c("w")).alias("x"), *[c(f"z.{n}").alias(n) for n in columns])


def part(plane: Column, w: Column, r0: Column, r1: Column, c0: Column, c1: Column) -> Column:
    """Rows ``r0..r1-1`` and columns ``c0..c1-1`` of an array that holds rows of ``w``."""
    rows = F.transform(F.sequence(r0.cast("int"), (r1 - 1).cast("int")), lambda i: F.slice(plane, i * w.cast("int") + c0.cast("int") + 1, (c1 - c0).cast("int")))
    return F.when((c1 - c0) * (r1 - r0) == F.size(plane), plane).otherwise(F.flatten(rows))


def _lists(batch: pa.RecordBatch | pa.StructArray, names: list[str]) -> dict[str, list[np.ndarray]]:
    """The arrays of list columns, one per row."""
    out = {}
    for n in names:
        col = batch.column(batch.schema.get_field_index(n)) if isinstance(batch, pa.RecordBatch) else batch.field(n)
        flat, edge = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
        out[n] = [flat[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return out


def _ints(pieces: pa.StructArray, names: list[str]) -> dict[str, np.ndarray]:
    return {n: pieces.field(n).to_numpy(zero_copy_only=False) for n in names}


def _assembled(at: dict[str, np.ndarray], planes: dict[str, list[np.ndarray]], lo: int, hi: int) -> tuple[int, int, Planes]:
    """The rectangle that pieces ``lo..hi-1`` fill: its corner and its planes."""
    y0, x0 = int(at["y0"][lo:hi].min()), int(at["x0"][lo:hi].min())
    y1, x1 = int((at["y0"] + at["h"])[lo:hi].max()), int((at["x0"] + at["w"])[lo:hi].max())
    out = {n: np.zeros((y1 - y0, x1 - x0)) for n in planes}
    for i in range(lo, hi):
        a, b, h, w = (int(at[n][i]) for n in ("y0", "x0", "h", "w"))
        for n, rows in planes.items():
            out[n][a - y0 : a - y0 + h, b - x0 : b - x0 + w] = rows[i].reshape(h, w)
    return y0, x0, out


def _strips(tiles: DataFrame, keys: list[str], params: list[str], radius: Column, columns: list[str]) -> DataFrame:
    """``keys, params, ty, tx, pieces``: each tile with what lies within ``radius`` of it."""
    n = F.ceil(radius / SIDE).cast("int")
    step = lambda: F.explode(F.sequence(-n, n))
    sent = tiles.withColumn("_dy", step()).withColumn("_dx", step())
    for a, size in (("y", "h"), ("x", "w")):
        origin = (c("t" + a) + c("_d" + a)) * SIDE
        sent = sent.withColumns({f"_{a}a": F.greatest(c(a + "0"), origin - radius).cast("long"), f"_{a}b": F.least(c(a + "0") + c(size), origin + SIDE + radius).cast("long")})
    sent = sent.where("_ya < _yb and _xa < _xb")
    cut_ = [part(c(n_), c("w"), c("_ya") - c("y0"), c("_yb") - c("y0"), c("_xa") - c("x0"), c("_xb") - c("x0")).alias(n_) for n_ in columns]
    own = (c("_dy") == 0) & (c("_dx") == 0)
    piece = F.struct(own.alias("own"), c("_ya").alias("y0"), c("_xa").alias("x0"), (c("_yb") - c("_ya")).alias("h"), (c("_xb") - c("_xa")).alias("w"), *cut_)
    sent = sent.select(*keys, *params, (c("ty") + c("_dy")).alias("ty"), (c("tx") + c("_dx")).alias("tx"), piece.alias("piece"))
    return sent.groupBy(*keys, *params, "ty", "tx").agg(F.collect_list("piece").alias("pieces")).where(F.exists("pieces", lambda p: p["own"]))


def _schema(df: DataFrame, names: list[str], outs: list[str]) -> T.StructType:
    kept = [df.schema[n] for n in names]
    return T.StructType([*kept, *[T.StructField(n, T.LongType()) for n in PLACE], *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in outs]])


def _out(rows: list[tuple], kept: pa.RecordBatch, index: list[int], places: list[tuple], outs: list[str], names: list[str]) -> pa.RecordBatch:
    cols = [kept.column(i).take(pa.array([r[0] for r in rows], pa.int64())) for i in index]
    cols += [pa.array([p[k] for p in places], pa.int64()) for k in range(len(PLACE))]
    for k in range(len(outs)):
        flat = [np.asarray(r[1][k], np.float64).ravel() for r in rows]
        edge = np.concatenate([[0], np.cumsum([len(f) for f in flat])]).astype(np.int32)
        cols.append(pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate(flat) if flat else np.zeros(0))))
    return pa.RecordBatch.from_arrays(cols, names)


def stencil(tiles: DataFrame, keys: list[str], radius: int | str, fn: Callable[[Planes, dict], Planes], outs: list[str], columns: list[str], params: tuple[str, ...] = ()) -> DataFrame:
    """Tiles of ``fn``'s planes, one exchange of borders for all of them.

    ``fn(planes, params)`` gets the tile with all of the raster within ``radius`` (a number or one of ``params``) of it
    and returns planes of the same shape; they must be right at ``radius`` from any side that is not the raster's own.
    """
    params = list(params)
    r = F.lit(radius) if isinstance(radius, int) else c(radius)
    near = _strips(tiles, keys, params, r, columns)
    schema = _schema(tiles, [*keys, *params], outs)
    index, names = list(range(len(keys) + len(params))), schema.names
    at = near.columns.index("pieces")
    place, cols, count = ["own", "y0", "x0", "h", "w"], list(columns), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pieces = b.column(at).values
            where, planes, edge = _ints(pieces, place), _lists(pieces, cols), b.column(at).offsets.to_numpy()
            ty, tx = b.column(at - 2).to_numpy(), b.column(at - 1).to_numpy()
            rows, places = [], []
            for i in range(b.num_rows):
                lo, hi = edge[i], edge[i + 1]
                own = lo + int(np.argmax(where["own"][lo:hi]))
                y0, x0, region = _assembled(where, planes, lo, hi)
                got = fn(region, {n: b.column(count + k)[i].as_py() for k, n in enumerate(params)})
                y, x, h, w = (int(where[n][own]) for n in ("y0", "x0", "h", "w"))
                rows.append((i, [got[n][y - y0 : y - y0 + h, x - x0 : x - x0 + w] for n in outs]))
                places.append((ty[i], tx[i], y, x, h, w))
            if rows:
                yield _out(rows, b, index, places, outs, names)

    return near.mapInArrow(run, schema)


def bands(tiles: DataFrame, keys: list[str], axis: str, fn: Callable[[Planes, dict], Planes], outs: list[str], columns: list[str], params: tuple[str, ...] = ()) -> DataFrame:
    """Tiles of ``fn``'s planes on bands that span the raster along ``axis`` and are one tile wide."""
    params = list(params)
    across = "ty" if axis == "x" else "tx"
    whole = tiles.groupBy(*keys, *params, across).agg(F.collect_list(F.struct(*PLACE, *columns)).alias("pieces"))
    schema = _schema(tiles, [*keys, *params], outs)
    index, names, cols, count = list(range(len(keys) + len(params))), schema.names, list(columns), len(keys)
    at = whole.columns.index("pieces")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pieces = b.column(at).values
            where, planes, edge = _ints(pieces, PLACE), _lists(pieces, cols), b.column(at).offsets.to_numpy()
            for i in range(b.num_rows):
                y0, x0, region = _assembled(where, planes, edge[i], edge[i + 1])
                got = fn(region, {n: b.column(count + k)[i].as_py() for k, n in enumerate(params)})
                rows, places = [], []
                for j in range(edge[i], edge[i + 1]):
                    p = tuple(int(where[n][j]) for n in PLACE)
                    y, x, h, w = p[2] - y0, p[3] - x0, p[4], p[5]
                    rows.append((i, [got[n][y : y + h, x : x + w] for n in outs]))
                    places.append(p)
                yield _out(rows, b, index, places, outs, names)

    return whole.mapInArrow(run, schema)


# ---------------------------------------------------------------- filters of one array


def weighted(a: np.ndarray, axis: int, weights: dict[int, float]) -> np.ndarray:
    """Weighted sums along an axis; borders repeat the edge."""
    r = max(abs(k) for k in weights)
    pad = [(r, r) if k == axis else (0, 0) for k in range(2)]
    p = np.pad(a, pad, "edge")
    n = a.shape[axis]
    return sum(np.take(p, range(r + k, r + k + n), axis) * w for k, w in weights.items())


def mean(a: np.ndarray, axis: int, r: int) -> np.ndarray:
    """Means over 2r + 1 along an axis from running sums; borders repeat the edge."""
    if r <= 0:
        return a
    p = np.pad(a, [(r + 1, r) if k == axis else (0, 0) for k in range(2)], "edge")
    s = np.cumsum(p, axis)
    n = a.shape[axis]
    return (np.take(s, range(2 * r + 1, 2 * r + 1 + n), axis) - np.take(s, range(n), axis)) / (2 * r + 1)


def smooth(a: np.ndarray, axis: int, sigma: float) -> np.ndarray:
    """One axis of a Gaussian: the kernel up to sigma 8, three boxes above."""
    if sigma <= 0:
        return a
    if sigma <= 8:
        return weighted(a, axis, gaussian_kernel(sigma))
    for r in box_radii(sigma):
        a = mean(a, axis, r)
    return a


def extreme(a: np.ndarray, r: int, best) -> np.ndarray:
    """Least or greatest over (2r + 1)^2 by doubling; nothing beyond the border counts."""
    for axis in (0, 1):
        p = np.pad(a, [(r, r) if k == axis else (0, 0) for k in range(2)], "edge")
        size, want = 1, 2 * r + 1
        while size < want:
            step = min(size, want - size)
            n = p.shape[axis] - step
            p = best(np.take(p, range(n), axis), np.take(p, range(step, step + n), axis))
            size += step
        a = p
    return a


def middle(a: np.ndarray, r: int) -> np.ndarray:
    """Median over (2r + 1)^2; borders repeat the edge."""
    v = np.lib.stride_tricks.sliding_window_view(np.pad(a, r, "edge"), (2 * r + 1, 2 * r + 1))
    return np.partition(v.reshape(*a.shape, -1), (2 * r + 1) ** 2 // 2, axis=2)[:, :, (2 * r + 1) ** 2 // 2]


# ---------------------------------------------------------------- filters of tiles


def box_blur(tiles: DataFrame, keys: list[str], r: int, columns: list[str]) -> DataFrame:
    """Mean over (2r + 1)^2 (PIX2)."""
    if r <= SIDE:
        return stencil(tiles, keys, r, lambda p, _: {n: mean(mean(a, 1, r), 0, r) for n, a in p.items()}, columns, columns)
    across = bands(tiles, keys, "x", lambda p, _: {n: mean(a, 1, r) for n, a in p.items()}, columns, columns)
    return bands(across, keys, "y", lambda p, _: {n: mean(a, 0, r) for n, a in p.items()}, columns, columns)


def reach(sigma: float) -> int:
    return max(1, math.ceil(3 * sigma)) if sigma <= 8 else sum(box_radii(sigma))


def gaussian_blur(tiles: DataFrame, keys: list[str], sigma: float | str, columns: list[str]) -> DataFrame:
    """Gaussian of all ``columns`` (PIX3); ``sigma`` is a number or a column with one value per image."""
    if not isinstance(sigma, str) and reach(sigma) <= SIDE:
        return stencil(tiles, keys, reach(sigma), lambda p, _: {n: smooth(smooth(a, 1, sigma), 0, sigma) for n, a in p.items()}, columns, columns)
    params = (sigma,) if isinstance(sigma, str) else ()
    width = (lambda q: q[sigma]) if isinstance(sigma, str) else (lambda q: sigma)
    across = bands(tiles, keys, "x", lambda p, q: {n: smooth(a, 1, width(q)) for n, a in p.items()}, columns, columns, params)
    return bands(across, keys, "y", lambda p, q: {n: smooth(a, 0, width(q)) for n, a in p.items()}, columns, columns, params)


def normalised_blur(tiles: DataFrame, keys: list[str], sigma: str, weight: str, values: list[str], fallback: list[str]) -> DataFrame:
    """blur(v * weight) / blur(weight) of each of ``values``, the column of ``fallback`` where nothing weighs (PIX4)."""

    def across(p: Planes, q: dict) -> Planes:
        w = p[weight]
        return {n: smooth(p[n] * w, 1, q[sigma]) for n in values} | {weight: smooth(w, 1, q[sigma])}

    def down(p: Planes, q: dict) -> Planes:
        den = smooth(p[weight], 0, q[sigma])
        ok = den > 1e-4
        return {n: np.where(ok, smooth(p[n], 0, q[sigma]) / np.where(ok, den, 1.0), 0.0 if q[f] is None else q[f]) for n, f in zip(values, fallback, strict=True)}

    once = bands(tiles, keys, "x", across, [*values, weight], [*values, weight], (sigma, *fallback))
    return bands(once, keys, "y", down, values, [*values, weight], (sigma, *fallback))


def morphology(tiles: DataFrame, keys: list[str], r: int, op: str, columns: list[str]) -> DataFrame:
    """``erode``, ``dilate``, ``open``, ``close`` by (2r + 1)^2 (PIX7)."""
    steps = {"erode": [np.minimum], "dilate": [np.maximum], "open": [np.minimum, np.maximum], "close": [np.maximum, np.minimum]}[op]

    def fn(p: Planes, _: dict) -> Planes:
        for best in steps:
            p = {n: extreme(a, r, best) for n, a in p.items()}
        return p

    return stencil(tiles, keys, r * len(steps), fn, columns, columns)


def median_filter(tiles: DataFrame, keys: list[str], r: int, columns: list[str]) -> DataFrame:
    """Median over (2r + 1)^2 (PIX5)."""
    return stencil(tiles, keys, r, lambda p, _: {n: middle(a, r) for n, a in p.items()}, columns, columns)


def log_responses(tiles: DataFrame, keys: list[str], sigmas: list[float], column: str = "v") -> DataFrame:
    """-sigma^2 times the Laplacian of the Gaussian for each width, columns ``r0, r1, ...``, in one exchange (PIX16)."""

    def fn(p: Planes, _: dict) -> Planes:
        out = {}
        for k, s in enumerate(sigmas):
            a = smooth(smooth(p[column], 1, s), 0, s)
            out[f"r{k}"] = (weighted(a, 0, {-1: 1.0, 1: 1.0}) + weighted(a, 1, {-1: 1.0, 1: 1.0}) - 4 * a) * (-s * s)
        return out

    return stencil(tiles, keys, max(map(reach, sigmas)) + 1, fn, [f"r{k}" for k in range(len(sigmas))], [column])


def patches(tiles: DataFrame, items: DataFrame, keys: list[str], item: list[str], columns: list[str], radius: Column) -> DataFrame:
    """``items`` with ``pieces``: what the raster holds within ``radius`` of ``(px, py)``, cut from the tiles in reach."""
    side = lambda a: F.explode(F.sequence(F.floor((c("p" + a) - radius) / SIDE).cast("long"), F.floor((c("p" + a) + radius) / SIDE).cast("long")))
    asked = items.select(*keys, *item, *[F.floor(c("p" + a) - radius).cast("long").alias(f"_{a}l") for a in "yx"], *[F.ceil(c("p" + a) + radius).cast("long").alias(f"_{a}h") for a in "yx"], side("y").alias("ty"), "px", radius.alias("_reach"))
    asked = asked.withColumn("tx", F.explode(F.sequence(F.floor((c("px") - c("_reach")) / SIDE).cast("long"), F.floor((c("px") + c("_reach")) / SIDE).cast("long")))).drop("px", "_reach")
    j = asked.join(tiles.select(*keys, *PLACE, *columns), [*keys, "ty", "tx"])
    for a, size in (("y", "h"), ("x", "w")):
        j = j.withColumns({f"_{a}a": F.greatest(c(a + "0"), c(f"_{a}l")), f"_{a}b": F.least(c(a + "0") + c(size), c(f"_{a}h") + 1)})
    j = j.where("_ya < _yb and _xa < _xb")
    cut_ = [part(c(n), c("w"), c("_ya") - c("y0"), c("_yb") - c("y0"), c("_xa") - c("x0"), c("_xb") - c("x0")).alias(n) for n in columns]
    piece = F.struct(c("_ya").alias("y0"), c("_xa").alias("x0"), (c("_yb") - c("_ya")).alias("h"), (c("_xb") - c("_xa")).alias("w"), *cut_)
    got = j.groupBy(*keys, *item).agg(F.collect_list(piece).alias("pieces"))
    return items.join(got, [*keys, *item])



def pointwise(tiles: DataFrame, keys: list[str], fn: Callable[[Planes, dict], Planes], outs: list[str], columns: list[str], params: tuple[str, ...] = ()) -> DataFrame:
    """Tiles of ``fn``'s planes, pixel by pixel: no exchange."""
    params = list(params)
    df = tiles.select(*keys, *params, *PLACE, *columns)
    schema = _schema(tiles, [*keys, *params], outs)
    index, names, cols, count = list(range(len(keys) + len(params))), schema.names, list(columns), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            planes, where = _lists(b, cols), {n: b.column(len(index) + k).to_numpy() for k, n in enumerate(PLACE)}
            rows, places = [], []
            for i in range(b.num_rows):
                p = tuple(int(where[n][i]) for n in PLACE)
                got = fn({n: planes[n][i].reshape(p[4], p[5]) for n in cols}, {n: b.column(count + k)[i].as_py() for k, n in enumerate(params)})
                rows.append((i, [got[n] for n in outs]))
                places.append(p)
            if rows:
                yield _out(rows, b, index, places, outs, names)

    return df.mapInArrow(run, schema)


def distance(tiles: DataFrame, keys: list[str], target: str, columns: list[str], border: bool, out: str = "dist") -> DataFrame:
    """Exact distance to the nearest pixel where ``target`` is not 0, beside ``columns`` (PIX12); 1e10 where there is none.

    ``border``: pixels beyond the raster are targets.
    """
    far = 1e10

    def gaps(p: Planes, _: dict) -> Planes:
        on = p[target] != 0
        h = len(on)
        y = np.arange(h)[:, None]
        up = np.maximum.accumulate(np.where(on, y, -1 if border else -far), 0)
        down = np.minimum.accumulate(np.where(on, y, h if border else far)[::-1], 0)[::-1]
        return {n: p[n] for n in columns} | {out: np.minimum(np.minimum(y - up, down - y), far).astype(float)}

    def along(p: Planes, _: dict) -> Planes:
        return {n: p[n] for n in columns} | {out: np.stack([np.sqrt(nearest_squared(row, far, border)) for row in p[out]])}

    once = bands(tiles, keys, "y", gaps, [*columns, out], list(dict.fromkeys([*columns, target])))
    return bands(once, keys, "x", along, [*columns, out], [*columns, out])


__all__ = ["to_tiles", "from_tiles", "stencil", "bands", "pointwise", "patches", "distance", "box_blur", "gaussian_blur", "normalised_blur", "morphology", "median_filter", "log_responses"]
