"""Concave contour points and arcs on a dumbbell-like mask."""

import math

from petrigrid.operators import shapes as SH


def test_concave_points_and_arcs(spark):
    inside = lambda x, y: math.hypot(x - 10, y - 10) <= 7 or math.hypot(x - 21, y - 10) <= 7
    mask = {(x, y) for x in range(32) for y in range(20) if inside(x + 0.5, y + 0.5)}
    # outline by angle around the middle of the figure (it is star-shaped from there)
    ring = []
    for s in range(120):
        a = 2 * math.pi * s / 120
        r = max(q / 10 for q in range(0, 300) if inside(15.5 + q / 10 * math.cos(a), 10 + q / 10 * math.sin(a)))
        ring.append((15.5 + r * math.cos(a), 10 + r * math.sin(a)))
    cont = spark.createDataFrame([(1, 1, i, *p) for i, p in enumerate(ring)], "image_id int, contour int, i long, x double, y double")
    m = spark.createDataFrame([(1, y, x) for x, y in mask], "image_id int, y long, x long")
    k, n = 8, len(ring)
    depth = []
    for i in range(n):
        (ax, ay), (bx, by) = ring[(i - k) % n], ring[(i + k) % n]
        mx, my = (ax + bx) / 2, (ay + by) / 2
        depth.append(0.0 if (math.floor(mx), math.floor(my)) in mask else math.hypot(ring[i][0] - mx, ring[i][1] - my))
    want = [i for i in range(n) if depth[i] > 0.75 and all(not (depth[(i + j) % n] > depth[i] or (depth[(i + j) % n] == depth[i] and j < 0)) for j in range(-k, k + 1) if j)]
    cuts = SH.concave_points(cont, m, ["image_id"], ["contour"], k)
    got = sorted(r.i for r in cuts.collect())
    assert got == want and len(want) >= 2
    arcs = SH.split_arcs(cont, cuts, ["image_id", "contour"]).groupBy("arc").count().collect()
    assert sum(r["count"] for r in arcs) == n + len(want)
