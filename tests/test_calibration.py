"""The two-pass calibration against a sequential restatement on three small plates."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from petrigrid.operators import background as B
from petrigrid.operators import calibration as CA
from petrigrid.operators import measure as ME
from petrigrid.operators import pixels as P

K = ["image_id"]


def plates():
    rng = random.Random(12)
    size = {1: (96, 80), 2: (70, 90), 3: (64, 64)}
    discs = {1: [(30, 30, 6), (60, 50, 5), (72, 24, 4)], 2: [(30, 40, 5), (50, 60, 6)], 3: []}
    rows = []
    for k, (w, h) in size.items():
        for y in range(h):
            for x in range(w):
                t = max([1 / (1 + math.exp((math.hypot(x + 0.5 - cx, y + 0.5 - cy) - r) * 2)) for cx, cy, r in discs[k]], default=0.0)
                base = 90 + 0.3 * x + rng.gauss(0, 1.5)
                rows.append((k, y, x, *[int(min(255, max(0, base + t * g))) for g in (95, 60, 20)]))
    return size, rows


def axis_blur(a, axis, sigma):
    n = a.shape[axis]
    at = lambda i: np.take(a, np.clip(np.arange(n) + i, 0, n - 1), axis)
    if sigma <= 8:
        return sum(w * at(i) for i, w in P.gaussian_kernel(sigma).items())
    for r in P.box_radii(sigma):
        a = sum(at(i) for i in range(-r, r + 1)) / (2 * r + 1)
    return a


def blur(a, sigma):
    """Three boxes alternate between the axes or not: the passes commute."""
    return axis_blur(axis_blur(a, 1, sigma), 0, sigma)


def background(lab, weight, sigma):
    den = blur(weight, sigma)
    return [np.where(den > 1e-4, blur(p * weight, sigma) / np.where(den > 1e-4, den, 1), np.median(p[weight > 0])) for p in lab]


def nearest(target, border):
    h, w = target.shape
    pts = [(y, x) for y in range(h) for x in range(w) if target[y, x]]
    out = np.full((h, w), 1e10)
    yy, xx = np.mgrid[:h, :w]
    for y, x in pts:
        out = np.minimum(out, np.hypot(yy - y, xx - x))
    if border:
        out = np.minimum.reduce([out, yy + 1, xx + 1, h - yy, w - xx])
    return out


def sigma_of(v):
    return max(1.4826 * np.median(np.abs(v - np.median(v))), 1e-3)


def around(lab, bg, px, py):
    y, x = int(py), int(px)
    win = (slice(max(0, y - 1), y + 2), slice(max(0, x - 1), x + 2))
    return [float((p - b)[win].mean()) for p, b in zip(lab, bg, strict=True)]


def lower_median(v, w):
    order = np.argsort(v)
    total = np.cumsum(np.array(w)[order])
    return float(np.array(v)[order][np.searchsorted(total, total[-1] / 2)])


def prior_of(ms, diameter):
    use = [m for m in ms if m["weight"] > 0]
    if use:
        z, w = [math.log(m["r"]) for m in use], [m["weight"] for m in use]
        mu = lower_median(z, w)
        raw = 1.4826 * lower_median([abs(v - mu) for v in z], w) if len(z) > 1 else 0.0
        s = max(0.25, raw) * math.sqrt(1 + 1 / sum(w))
    elif any(m["r"] for m in ms):
        mu, s = float(np.median([math.log(m["r"]) for m in ms if m["r"]])), 0.4
    else:
        mu, s = math.log(max(3.0, diameter * 0.008)), 0.6
    return {"r_med": math.exp(mu), "r_hi": math.exp(mu + 2 * s), "s": s}


def quality(m):
    if m["edge_clearance"] < 1:
        return "edge", 0.0
    if m["saturated_frac"] > 0.25 or m["dip"]:
        return "glare", 0.0
    if m["r"] is None:
        return ("touching" if m["blocked_frac"] > 0.5 and m["snr"] >= 4 else "weak"), 0.0
    if m["blocked_frac"] + m["seam_frac"] >= 0.3:
        return "touching", None
    if m["snr"] < 4 or m["cv"] > 0.3 or (m["r_edge"] and abs(math.log(m["r_edge"] / m["r"])) > 0.5):
        return "weak", 0.0
    return "ok", 1.0


def measure(plane, px, py, noise, r_max, dist, saturated, ox=0, oy=0):
    m = ME.measure(plane, px, py, noise, r_max)
    yy, xx = np.mgrid[: plane.shape[0], : plane.shape[1]]
    disc = np.hypot(xx + 0.5 - m["cx"], yy + 0.5 - m["cy"]) <= (m["r"] or 0)
    m["saturated_frac"] = float(saturated[disc].mean()) if m["r"] and saturated is not None and disc.any() else 0.0
    m["edge_clearance"] = float(ME.sample(dist, np.array([m["cx"]]), np.array([m["cy"]]))[0]) - (m["r"] or 0)
    m["quality"], m["weight"] = quality(m)
    m["cx"], m["cy"] = m["cx"] + ox, m["cy"] + oy
    return m


def restated(images, seeds, remote):
    out = {}
    for k, im in images.items():
        lab, plate, on, sat = im["lab"], im["plate"], im["on"], im["saturated"]
        h, w = plate.shape
        diameter = 2 * math.sqrt(plate.sum() / math.pi)
        bg = background(lab, plate.astype(float), max(4.0, 0.05 * diameter))
        mine = [(i, x, y) for kk, i, x, y in seeds if kk == k and 0 <= x < w and 0 <= y < h]
        theirs = []
        for kk, i, s, x, y in remote:
            if kk == k and s in images:
                src = images[s]["lab"]
                hh, ww = src[0].shape
                half = 0.05 * max(ww, hh)
                x0, y0, x1, y1 = max(0, math.floor(x - half)), max(0, math.floor(y - half)), min(ww, math.ceil(x + half)), min(hh, math.ceil(y + half))
                pl = [p[y0:y1, x0:x1] for p in src]
                theirs.append((i, x - x0, y - y0, x0, y0, pl, background(pl, np.ones_like(pl[0]), max(4.0, min(x1 - x0, y1 - y0) / 6))))
        diffs = [around(lab, bg, x, y) for _, x, y in mine] + [around(pl, b, x, y) for _, x, y, _, _, pl, b in theirs]
        axis = np.median(diffs, axis=0) if diffs else np.array([1.0, 0, 0])
        axis = axis / np.linalg.norm(axis)
        r_max, dist = max(6.0, 0.06 * diameter), nearest(~on, True)

        def all_of(plane, noise):
            ms = {i: measure(plane, x, y, noise, r_max, dist, sat) for i, x, y in mine}
            for i, x, y, ox, oy, pl, b in theirs:
                f = sum((p - q) * a for p, q, a in zip(pl, b, axis, strict=True))
                ms[i] = measure(f, x, y, sigma_of(f), min(r_max, min(f.shape) / 2 - 1), nearest(np.zeros(f.shape, bool), True), None, ox, oy)
            return ms

        plane = sum((p - q) * a for p, q, a in zip(lab, bg, axis, strict=True))
        noise = sigma_of(plane[on])
        ms = all_of(plane, noise)
        prior = prior_of(ms.values(), diameter)
        strong = [m["contrast"] for m in ms.values() if m["snr"] >= 4]
        hot = plane > max(3 * noise, 0.25 * (np.median(strong) if strong else 8 * noise))
        fg = nearest(hot, False) <= max(1.0, 1.5 * prior["r_med"])
        bg = background(lab, (plate & ~fg).astype(float), max(4.0, 4 * prior["r_hi"], 0.04 * diameter))
        plane = sum((p - q) * a for p, q, a in zip(lab, bg, axis, strict=True))
        noise = sigma_of(plane[on & ~fg])
        ms = all_of(plane, noise)
        out[k] = {"axis": axis, "plane": plane, "fg": fg, "noise": noise, "seeds": ms, "prior": prior_of(ms.values(), diameter)}
    return out


@pytest.mark.parametrize("with_remote", [False, True])
def test_against_a_sequential_restatement(spark, with_remote):
    size, rows = plates()
    planes = B.lab_planes(spark.createDataFrame(rows, "image_id int, y long, x long, r int, g int, b int"), K).persist()
    inside = lambda k, x, y, m: math.hypot(x + 0.5 - size[k][0] / 2, y + 0.5 - size[k][1] / 2) < min(size[k]) / 2 - m
    mask = spark.createDataFrame([(k, y, x, inside(k, x, y, 1), inside(k, x, y, 4)) for k, (w, h) in size.items() for y in range(h) for x in range(w)], "image_id int, y long, x long, plate boolean, on boolean")
    seeds = [(1, 10, 30.5, 29.0), (1, 11, 59.0, 50.5), (1, 12, 72.0, 24.5), (1, 13, -5.0, 3.0), (2, 20, 29.0, 41.0)]
    remote = [(2, 21, 1, 60.0, 50.0), (3, 30, 1, 30.0, 30.0), (3, 31, 2, 50.0, 60.5), (3, 32, 9, 5.0, 5.0)]
    images = {k: {n: np.zeros((h, w)) for n in ("l", "a", "b", "saturated", "plate", "on")} for k, (w, h) in size.items()}
    for r in planes.collect():
        for n in ("l", "a", "b", "saturated"):
            images[r.image_id][n][r.y, r.x] = r[n]
    for k, (w, h) in size.items():
        im = images[k]
        im["plate"] = np.array([[inside(k, x, y, 1) for x in range(w)] for y in range(h)])
        im["on"] = np.array([[inside(k, x, y, 4) for x in range(w)] for y in range(h)])
        im["lab"] = [im["l"], im["a"], im["b"]]
    want = restated(images, seeds, remote if with_remote else [])
    far = spark.createDataFrame(remote, "image_id int, seed_id int, source_id int, px double, py double") if with_remote else None
    got = CA.calibrate(planes, mask, spark.createDataFrame(seeds, "image_id int, seed_id int, px double, py double"), K, "seed_id", far)
    for r in got["axes"].collect():
        assert np.allclose([r.axis_l, r.axis_a, r.axis_b], want[r.image_id]["axis"], atol=1e-9)
    for r in got["plane"].collect():
        for n, w in (("v", want[r.image_id]["plane"]), ("fg", want[r.image_id]["fg"])):
            assert np.allclose(np.reshape(r[n], (r.h, r.w)), w[r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w], atol=1e-7)
    assert all(math.isclose(r.noise, want[r.image_id]["noise"], rel_tol=1e-9) for r in got["noise"].collect())
    ms = {(r.image_id, r.seed_id): r for r in got["seeds"].collect()}
    assert ms.keys() == {(k, i) for k, o in want.items() for i in o["seeds"]}
    for (k, i), r in ms.items():
        w = want[k]["seeds"][i]
        assert r.quality == w["quality"] and all(r[f] == w[f] or math.isclose(r[f], w[f], rel_tol=1e-6, abs_tol=1e-6) for f in ("cx", "cy", "r", "snr", "contrast", "cv", "edge_clearance")), (k, i)
    assert any(m.quality == "ok" for m in ms.values())
    for r in got["prior"].collect():
        assert math.isclose(r.r_med, want[r.image_id]["prior"]["r_med"], rel_tol=1e-6) and math.isclose(r.s, want[r.image_id]["prior"]["s"], rel_tol=1e-6)
    notes = {(r.image_id, r.seed_id): r.note for r in got["report"].where(F.col("note").isNotNull()).collect()}
    assert notes == {(1, 13): "outside-image"} | ({(3, 32): "no-reference-image"} if with_remote else {})
    assert got["appearance"].count() == 3
