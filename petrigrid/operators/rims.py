"""Rays and rings around picked centres, for all centres of an image at once (PIX22).

An image that fits a task meets its centres there: one exchange of pixels and centres, whatever the number of rays.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

RAYS = 32
TAU = 2 * math.pi
#: Ring points of one numpy pass.
PASS = 2_000_000
_FIGURES = ["radius", *[g + n for g in "wcmo" for n in "rgb"], *["c" + n for n in ("_l", "_a", "_b")]]


def first_edges(d: np.ndarray, w: int) -> np.ndarray:
    """Radius of the first strong local rise of each smoothed profile (a row of ``d``), NaN without one."""
    n = d.shape[1]
    run = np.concatenate([np.zeros((len(d), 1)), np.cumsum(d, 1)], 1)
    at = np.arange(n)
    lo, hi = np.maximum(at - w, 0), np.minimum(at + w, n - 1) + 1
    smooth = (run[:, hi] - run[:, lo]) / (hi - lo)
    gap = max(2, 2 * int(w))
    out = np.full(len(d), np.nan)
    if n <= gap or not len(d):
        return out
    rise = smooth[:, gap:] - smooth[:, :-gap]
    rise[:, :3] = 0.0
    ahead = np.concatenate([rise[:, 1:], np.full((len(d), 1), -np.inf)], 1)
    strong = np.maximum(2.0, 0.5 * np.maximum(rise.max(1, initial=0.0), 0.0))
    peak = (rise >= strong[:, None]) & (ahead < rise) & (np.arange(rise.shape[1]) >= 3)
    first = peak.argmax(1)
    ok = peak.any(1) & (rise[np.arange(len(d)), first] > 2)
    out[ok] = first[ok] + gap / 2
    return out


def _gathered(at: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row of each pixel, -1 outside the raster or where it lacks one."""
    h, w = at.shape
    inside = (y >= 0) & (x >= 0) & (y < h) & (x < w)
    return np.where(inside, at[np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)], -1)


def _edges(at: np.ndarray, lab: np.ndarray, px: np.ndarray, py: np.ndarray, own: np.ndarray, max_r: int) -> np.ndarray:
    """Edges along the rays (centres x rays) of centres with one ``max_r``."""
    k = np.arange(max_r + 1)
    ang = np.arange(RAYS) / RAYS * TAU
    x = np.floor(px[:, None, None] + k * np.cos(ang)[:, None] + 0.5).astype(np.int64)
    y = np.floor(py[:, None, None] + k * np.sin(ang)[:, None] + 0.5).astype(np.int64)
    row = _gathered(at, y, x).reshape(-1, max_r + 1)
    there = row >= 0
    diff = lab[row] - np.repeat(lab[own], RAYS, 0)[:, None]
    d = np.sqrt(diff[..., 0] * diff[..., 0] + diff[..., 1] * diff[..., 1] + diff[..., 2] * diff[..., 2])
    w = max(1, math.floor(max_r / 60 + 0.5))
    out = np.full(len(d), np.nan)
    whole = there.all(1)
    out[whole] = first_edges(d[whole], w)
    for i in np.flatnonzero(~whole):  # profiles close up over pixels that are lacking
        out[i] = first_edges(d[i : i + 1, there[i]], w)[0]
    return out.reshape(-1, RAYS)


def _ring(at: np.ndarray, rgb: np.ndarray, px: np.ndarray, py: np.ndarray, radius: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Mean colours between two shares of the radius, NaN without a pixel."""
    a = np.arange(2 * RAYS) / (2 * RAYS) * TAU
    r = (np.arange(lo, hi + 1, 5) / 100)[None, :] * radius[:, None]
    x = np.floor(px[:, None, None] + r[:, :, None] * np.cos(a) + 0.5).astype(np.int64)
    y = np.floor(py[:, None, None] + r[:, :, None] * np.sin(a) + 0.5).astype(np.int64)
    row = _gathered(at, y, x).reshape(len(px), -1)
    n = (row >= 0).sum(1)
    total = np.where((row >= 0)[..., None], rgb[row], 0).sum(1)
    return np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], np.nan)


def figures(px: pa.Table, spots: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``spots`` whose pixel is there, and their figures."""
    num = lambda t, *names: np.stack([t.column(n).to_numpy() for n in names], 1)
    x, y = (px.column(n).to_numpy().astype(np.int64) for n in ("x", "y"))
    rgb, lab = num(px, "r", "g", "b").astype(np.float64), num(px, "l", "a", "lb")
    at = np.full((int(y.max()) + 1, int(x.max()) + 1), -1, np.int64)
    at[y, x] = np.arange(len(x))
    cx, cy = (spots.column(n).to_numpy().astype(np.int64) for n in ("px", "py"))
    own = _gathered(at, cy, cx)
    rows = np.flatnonzero(own >= 0)
    cx, cy, own = cx[rows], cy[rows], own[rows]
    max_r = np.minimum(np.minimum(cx, cy), np.minimum(at.shape[1] - 1 - cx, at.shape[0] - 1 - cy))
    radius = np.full(len(rows), np.nan)
    inner, outer = np.full((len(rows), 3), np.nan), np.full((len(rows), 3), np.nan)
    for m in np.unique(max_r[max_r >= 8]):
        same = np.flatnonzero(max_r == m)
        step = max(1, PASS // (RAYS * max(int(m) + 1, 14)))
        for s in (same[i : i + step] for i in range(0, len(same), step)):
            e = np.sort(_edges(at, lab, cx[s], cy[s], own[s], int(m)), 1)  # NaN last
            n = (~np.isnan(e)).sum(1)
            some = n >= RAYS / 4
            radius[s[some]] = e[some, n[some] // 2]
            f = s[some]
            if len(f):
                inner[f] = _ring(at, rgb, cx[f], cy[f], radius[f], 65, 85)
                outer[f] = _ring(at, rgb, cx[f], cy[f], radius[f], 130, 160)
    mean = np.broadcast_to(rgb.sum(0) / len(rgb), (len(rows), 3))
    return rows, np.concatenate([radius[:, None], mean, rgb[own], inner, outer, lab[own]], 1)


def folded(px: DataFrame, spots: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, px, py`` with the radius, the means of the window ``w``, centre ``c``, rim ``m`` and background ``o``, and the centre's Lab.

    ``px(keys, y, x, r, g, b, l, a, lb)``; ``spots(keys, px, py)`` holds no centre twice.
    """
    schema = T.StructType([*[spots.schema[k] for k in [*keys, "px", "py"]], *[T.StructField(n, T.DoubleType()) for n in _FIGURES]])
    arrow = to_arrow_schema(schema)

    def settle(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        rows, got = figures(left, right)
        given = right.select([*keys, "px", "py"]).take(pa.array(rows))
        cols = [x.combine_chunks() for x in given.columns] + [pa.array(got[:, i], from_pandas=True) for i in range(got.shape[1])]
        return pa.Table.from_arrays([x.cast(f.type) for x, f in zip(cols, arrow, strict=True)], schema=arrow)

    return px.groupBy(*keys).cogroup(spots.groupBy(*keys)).applyInArrow(settle, schema)
