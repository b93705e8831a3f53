"""Seed measurement: radius and quality of the colony under a point, on the patch around it (PIX28).

Each seed is one row with the pieces of the tiles in its reach. Along 32 rays (the mean of three sub-rays each) the
profile is followed outwards to the first edge or seam; the radius is a robust median of those hits, and the centre
moves to the circle through them, at most three times.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from petrigrid.functions import scoring as SC
from petrigrid.session import cut

from . import tiles as TL

c = F.col
# Rays, step along a ray in pixels, share of rays that must hit, window of accepted radii, rounds.
RAYS, SUB, STEP = 32, 3, 0.5
ENOUGH = RAYS // 4
INNER, OUTER = 0.6, 1.6
ROUNDS = 3

_ANGLE = (np.arange(RAYS)[:, None] + np.arange(-1, 2)[None] / SUB) / RAYS * (2 * math.pi)
_FIGURES = ["cx", "cy", "contrast", "snr", "r", "r_edge", "cv", "blocked_frac", "seam_frac", "n_rays", "sharpness", "saturated_frac", "edge_clearance"]


def sample(a: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear values at points in pixel-centre coordinates, clamped to the array."""
    h, w = a.shape
    x, y = np.clip(x - 0.5, 0, w - 1), np.clip(y - 0.5, 0, h - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    tx, ty = x - x0, y - y0
    return (a[y0, x0] * (1 - tx) + a[y0, x1] * tx) * (1 - ty) + (a[y1, x0] * (1 - tx) + a[y1, x1] * tx) * ty


def profiles(a: np.ndarray, cx: float, cy: float, r_max: float) -> np.ndarray:
    """Smoothed values along each ray (rays x steps)."""
    k = np.arange(max(4, math.ceil(r_max / STEP) + 1)) * STEP
    t = sample(a, cx + np.cos(_ANGLE)[..., None] * k, cy + np.sin(_ANGLE)[..., None] * k).mean(1)
    p = np.pad(t, ((0, 0), (1, 1)), "edge")
    return 0.25 * p[:, :-2] + 0.5 * p[:, 1:-1] + 0.25 * p[:, 2:]


def first_hits(p: np.ndarray, base: float, noise: float) -> dict[str, np.ndarray]:
    """Per ray the first edge (half the contrast) or seam (a dip that rises again) behind its last new maximum; ``ray`` names the rays that hit."""
    n = len(p)
    top, low, low_k = p[:, 0].copy(), p[:, 0].copy(), np.zeros(n, int)
    start, steep, steep_k = np.zeros(n, int), np.zeros(n), np.full(n, -1)
    done = np.zeros(n, bool)
    out = {f: np.zeros(n) for f in ("r", "r_steep", "slope", "max")} | {"seam": np.zeros(n, bool)}
    nz = noise / math.sqrt(3)
    for k in range(1, p.shape[1]):
        v, prev = p[:, k], p[:, k - 1]
        new = v > top
        top, low = np.where(new, v, top), np.where(new, v, low)
        low_k, start, steep_k, steep = np.where(new, k, low_k), np.where(new, k, start), np.where(new, -1, steep_k), np.where(new, 0.0, steep)
        lower, drop = ~new & (v < low), prev - v
        low, low_k = np.where(lower, v, low), np.where(lower, k, low_k)
        faster = ~new & (drop > 0) & (drop > steep)
        steep, steep_k = np.where(faster, drop, steep), np.where(faster, k, steep_k)
        con = top - base
        level = base + con * 0.5
        edge = v < level
        seam = (top - low >= np.maximum(con * 0.08, nz * 4)) & (v - low >= np.maximum(con * 0.03, nz * 2))
        hit = ~done & ~new & (con > 0) & (edge | seam)
        if hit.any():
            t = np.clip((prev - level) / np.maximum(prev - v, 1e-9), 0, 1)
            out["r"][hit] = np.where(edge, (k - 1 + t) * STEP, low_k * STEP)[hit]
            out["seam"][hit] = ~edge[hit]
            out["r_steep"][hit] = ((np.where(steep_k >= 0, steep_k, start) - 0.5) * STEP)[hit]
            out["slope"][hit] = (steep / STEP)[hit]
            out["max"][hit] = top[hit]
            done |= hit
            if done.all():
                break
    ray = np.flatnonzero(done)
    return {f: v[ray] for f, v in out.items()} | {"ray": ray}


def _median(v: np.ndarray) -> float | None:
    return float(np.median(v)) if len(v) else None


def once(a: np.ndarray, cx: float, cy: float, noise: float, r_max: float) -> dict:
    """One pass around a fixed centre."""
    p = profiles(a, cx, cy, r_max)
    near = max(3, min(p.shape[1], math.ceil(max(3.0, r_max * 0.25) / STEP)))
    centre, floor, high = (float(np.median(x)) for x in (p[:, :3].mean(1), p.min(1), p[:, :near].max(1)))
    base = min(floor, max(centre, high) * 0.25)
    h = first_hits(p, base, noise)
    n = len(h["ray"])
    contrast = (_median(h["max"]) if n else max(centre, high)) - base
    r = _median(h["r"])
    sure = n >= ENOUGH and contrast > 0 and r is not None and r > 0
    r = r if sure else None
    inside = np.zeros(n, bool)
    for _ in range(2):
        inside = (h["r"] >= r * INNER) & (h["r"] <= r * OUTER) if r is not None else np.zeros(n, bool)
        r = _median(h["r"][inside]) if inside.sum() >= ENOUGH else None
    out = {"cx": cx, "cy": cy, "dip": bool(centre < high * 0.6 and high > 0), "contrast": contrast, "snr": contrast / noise, "r": r, "hits": h}
    out["blocked_frac"] = 1.0 - inside.sum() / RAYS if sure else (RAYS - n) / RAYS
    out |= {"r_edge": None, "cv": 1.0, "seam_frac": 0.0, "n_rays": 0, "sharpness": 0.0, "accepted": np.zeros(n, bool)}
    if r is not None:
        steep = inside & (h["slope"] > 0)
        rs = h["r"][inside]
        out["accepted"] = (h["r"] >= r * INNER) & (h["r"] <= r * OUTER)
        out |= {"r_edge": _median(h["r_steep"][steep]), "cv": _median(np.abs(rs - np.median(rs))) * 1.4826 / r, "seam_frac": h["seam"][inside].sum() / RAYS, "n_rays": int(out["accepted"].sum())}
        if steep.any():
            out["sharpness"] = _median(h["slope"][steep]) * r / contrast
    return out


def circle(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float] | None:
    """Least-squares circle: half the slopes of the squared norm on (x, y)."""
    n = len(x)
    if n < 3:
        return None
    q = x * x + y * y
    mx, my, mq = x.mean(), y.mean(), q.mean()
    xx, yy, xy = ((x - mx) ** 2).mean(), ((y - my) ** 2).mean(), ((x - mx) * (y - my)).mean()
    xq, yq = ((x - mx) * (q - mq)).mean(), ((y - my) * (q - mq)).mean()
    spread = xx * yy - xy * xy
    if n * n * spread < 1e-9:
        return None
    cx, cy = (xq * yy - yq * xy) / (2 * spread), (yq * xx - xq * xy) / (2 * spread)
    return cx, cy, math.sqrt((mx - cx) ** 2 + (my - cy) ** 2 + xx + yy)


def recentred(m: dict) -> tuple[float, float, float] | None:
    """Circle through the accepted hits, twice refitted with all hits close to it."""
    h = m["hits"]
    a = h["ray"] / RAYS * (2 * math.pi)
    x, y = m["cx"] + np.cos(a) * h["r"], m["cy"] + np.sin(a) * h["r"]
    fit = circle(x[m["accepted"]], y[m["accepted"]])
    for _ in range(2):
        if fit is None:
            return None
        near = np.abs(np.hypot(x - fit[0], y - fit[1]) - fit[2]) <= max(1.0, fit[2] * 0.15)
        fit = (circle(x[near], y[near]) if near.sum() >= 8 else None) or fit
    return fit


def measure(a: np.ndarray, px: float, py: float, noise: float, r_max: float) -> dict:
    """A seed at ``(px, py)`` of the array."""
    m = once(a, px, py, noise, r_max)
    for _ in range(ROUNDS):
        if m["r"] is None or m["n_rays"] < 8:
            break
        fit = recentred(m)
        if fit is None or not (math.hypot(fit[0] - px, fit[1] - py) <= fit[2] * 0.8 and 0 < fit[2] <= m["r"] * 2 and math.hypot(fit[0] - m["cx"], fit[1] - m["cy"]) >= 0.05):
            break
        moved = once(a, fit[0], fit[1], noise, r_max)
        if moved["r"] is None:
            break
        m = moved
    return m


def measured(tiles: DataFrame, seeds: DataFrame, keys: list[str], item: list[str]) -> DataFrame:
    """``seeds(keys, item, px, py, noise, r_max, ...)`` with their figures, quality and weight.

    ``tiles`` hold ``v`` and, if given, ``saturated`` and ``dist`` (distance to the edge of the region). Profiles end at
    ``r_max`` and a centre moves by 0.8 of a radius of at most twice that, so a patch is bounded by ``r_max``.
    """
    seeds = cut(seeds)  # asked twice: where to look, and what to carry
    planes = [n for n in ("v", "saturated", "dist") if n in tiles.columns]
    near = TL.patches(tiles, seeds, keys, item, planes, c("r_max") * 2.6 + 4)
    names = seeds.columns
    schema = T.StructType([*seeds.schema.fields, T.StructField("dip", T.BooleanType()), *[T.StructField(f, T.DoubleType()) for f in _FIGURES]])
    at = near.columns.index("pieces")
    where = {n: near.columns.index(n) for n in ("px", "py", "noise", "r_max")}
    kept = [near.columns.index(n) for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pieces = b.column(at).values
            rects, arrays, edge = TL._ints(pieces, ["y0", "x0", "h", "w"]), TL._lists(pieces, planes), b.column(at).offsets.to_numpy()
            px, py, noise, r_max = (b.column(where[n]).to_numpy(zero_copy_only=False) for n in ("px", "py", "noise", "r_max"))
            rows = []
            for i in range(b.num_rows):
                y0, x0, p = TL._assembled(rects, arrays, edge[i], edge[i + 1])
                m = measure(p["v"], px[i] - x0, py[i] - y0, noise[i], r_max[i])
                m["saturated_frac"], m["edge_clearance"] = 0.0, 1e9
                if "saturated" in p and m["r"] is not None:
                    y, x = np.ogrid[: p["v"].shape[0], : p["v"].shape[1]]
                    disc = (x + 0.5 - m["cx"]) ** 2 + (y + 0.5 - m["cy"]) ** 2 <= m["r"] ** 2
                    m["saturated_frac"] = float(p["saturated"][disc].mean()) if disc.any() else 0.0
                if "dist" in p:
                    m["edge_clearance"] = float(sample(p["dist"], np.array([m["cx"]]), np.array([m["cy"]]))[0]) - (m["r"] or 0.0)
                m["cx"], m["cy"] = m["cx"] + x0, m["cy"] + y0
                rows.append(m)
            figures = [pa.array([m["dip"] for m in rows], pa.bool_()), *[pa.array([None if m[f] is None else float(m[f]) for m in rows], pa.float64()) for f in _FIGURES]]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), *figures], schema.names)

    out = near.mapInArrow(run, schema).withColumn("n_rays", c("n_rays").cast("int"))
    return out.withColumns({"quality": SC.seed_quality(), "weight": SC.seed_weight()})
