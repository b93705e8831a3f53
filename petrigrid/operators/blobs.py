"""Blobs of images that fit a task: all responses, maxima and scales of an image in one fold (PIX17).

Its pixels move once, however many radii there are. Lines and columns that are lacking as a whole close up for the
filters and keep their distance for the maxima, as in the window passes that larger images take.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import tiles as TL

c = F.col


def foldable(plane: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``keys, _fold``: whether an image has up to ``most`` pixels, in lines that all hold the same columns."""
    n = plane.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.size(F.collect_set("y")).alias("_h"), F.size(F.collect_set("x")).alias("_w"))
    return n.select(*keys, ((c("_n") <= most) & (c("_n") == c("_h").cast("long") * c("_w"))).alias("_fold"))


def _raster(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y, x, v = (t.column(n).to_numpy() for n in ("y", "x", "v"))
    order = np.lexsort((x, y))
    ys, xs = np.unique(y), np.unique(x)
    return ys, xs, v[order].reshape(len(ys), len(xs))


def _responses(a: np.ndarray, radii: list[float]) -> list[np.ndarray]:
    out = []
    for r in radii:
        s = r / math.sqrt(2)
        b = TL.smooth(TL.smooth(a, 1, s), 0, s)
        out.append((TL.weighted(b, 1, {-1: 1.0, 1: 1.0}) + TL.weighted(b, 0, {-1: 1.0, 1: 1.0}) - b * 4) * (-s * s))
    return out


def maxima(a: np.ndarray, ys: np.ndarray, xs: np.ndarray, r: int) -> np.ndarray:
    """Pixels that are the greatest of (2r + 1)^2; of equal ones the first in raster order is."""
    y, x = np.indices(a.shape)
    rank = np.empty(a.size, np.int64)
    rank[np.lexsort((-x.ravel(), -y.ravel(), a.ravel()))] = np.arange(a.size)
    grid = np.full((int(ys[-1] - ys[0]) + 1, int(xs[-1] - xs[0]) + 1), -1, np.int64)
    at = np.ix_(ys - ys[0], xs - xs[0])
    grid[at] = rank.reshape(a.shape)
    return TL.extreme(grid, r, np.maximum)[at] == grid[at]


def _folded(plane: DataFrame, keys: list[str], fields: list[T.StructField], fn) -> DataFrame:
    schema = T.StructType([*[plane.schema[k] for k in keys], *fields])
    arrow = to_arrow_schema(schema)

    def settle(key: tuple, t: pa.Table) -> pa.Table:
        cols = fn(*_raster(t))
        n = len(cols[0])
        cols = [pa.repeat(k, n) for k in key] + [pa.array(x) for x in cols]
        return pa.Table.from_arrays([x.cast(f.type) for x, f in zip(cols, arrow, strict=True)], schema=arrow)

    return plane.select(*keys, c("y").cast("long").alias("y"), c("x").cast("long").alias("x"), c("v").cast("double").alias("v")).groupBy(*keys).applyInArrow(settle, schema)


_PIXEL = [T.StructField("y", T.LongType()), T.StructField("x", T.LongType()), T.StructField("v", T.DoubleType()), T.StructField("scale", T.IntegerType())]


def peaks(plane: DataFrame, keys: list[str], radii: list[float], least: float) -> DataFrame:
    """``keys, y, x, v, scale, r``: maxima of their scale that no neighbouring scale exceeds."""

    def fn(ys: np.ndarray, xs: np.ndarray, a: np.ndarray) -> list[np.ndarray]:
        resp = _responses(a, radii)
        found = []
        for k, one in enumerate(resp):
            top = maxima(one, ys, xs, max(1, math.floor(radii[k] / math.sqrt(2) * 0.7 + 0.5))) & (one >= least)
            for j in (k - 1, k + 1):
                if 0 <= j < len(resp):
                    top &= ~(resp[j] > one)
            i, j = np.nonzero(top)
            found.append((ys[i], xs[j], one[i, j], np.full(len(i), k), np.full(len(i), float(radii[k]))))
        return [np.concatenate(x) for x in zip(*found, strict=True)]

    return _folded(plane, keys, [*_PIXEL, T.StructField("r", T.DoubleType())], fn)


def responses(plane: DataFrame, keys: list[str], radii: list[float]) -> DataFrame:
    """``keys, y, x, v, scale``: every response."""

    def fn(ys: np.ndarray, xs: np.ndarray, a: np.ndarray) -> list[np.ndarray]:
        n = a.size
        y, x = np.repeat(ys, len(xs)), np.tile(xs, len(ys))
        return [np.tile(y, len(radii)), np.tile(x, len(radii)), np.concatenate([one.ravel() for one in _responses(a, radii)]), np.repeat(np.arange(len(radii)), n)]

    return _folded(plane, keys, _PIXEL, fn)
