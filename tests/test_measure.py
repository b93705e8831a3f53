"""Seeds measured on patches equal the pixel-row form."""

import math
import random

from petrigrid.operators.detector import measure_seeds
from tests import row_measure


def close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-7))


def test_patches_against_pixel_rows(spark):
    rng = random.Random(8)
    edge = lambda d, r: 1 / (1 + math.exp((d - r) * 2))
    discs = {1: [(20.3, 18.8, 6.0), (31.0, 20.0, 5.0), (70.2, 66.0, 8.0), (95.0, 5.0, 4.0)], 2: [(12.0, 12.0, 3.0), (40.0, 30.0, 9.0)]}
    size = {1: (100, 80), 2: (60, 50)}
    rows, seeds = [], []
    for k, (w, h) in size.items():
        for y in range(h):
            for x in range(w):
                v = max(40 * edge(math.hypot(x + 0.5 - cx, y + 0.5 - cy), r) for cx, cy, r in discs[k])
                rows.append((k, y, x, v + rng.gauss(0, 0.4), v > 39, float(min(x + 1, y + 1, w - x, h - y))))
        for i, (cx, cy, _) in enumerate(discs[k]):
            seeds += [(k, 10 * i + j, min(w - 0.1, max(0.1, cx + rng.uniform(-2, 2))), min(h - 0.1, max(0.1, cy + rng.uniform(-2, 2))), 0.4, 14.0) for j in range(3)]
        seeds.append((k, 99, w * 0.9, h * 0.45, 0.4, 14.0))
    plane = spark.createDataFrame(rows, "image_id int, y long, x long, v double, saturated boolean, dist double").persist()
    s = spark.createDataFrame(seeds, "image_id int, s int, px double, py double, noise double, r_max double")
    want = {(r.image_id, r.s): r.asDict() for r in row_measure.measure_seeds(plane, s, ["image_id"], "s", plane, plane).collect()}
    got = {(r.image_id, r.s): r.asDict() for r in measure_seeds(plane, s, ["image_id"], "s", plane, plane).collect()}
    assert got.keys() == want.keys() and len(got) == len(seeds)
    for key, w in want.items():
        assert not {f: (got[key][f], v) for f, v in w.items() if not close(got[key][f], v)}, key
    assert {r["quality"] for r in got.values()} > {"ok"}
