"""Rims around picked centres: images that fit a task and larger ones give the same."""

import math

from petrigrid.operators import detector as D

K = ["image_id"]


def scene(spark):
    """Two discs on each of two images; the second lacks lines, the third has no centre."""
    rows = []
    for k in (1, 2, 3):
        for y in range(40):
            if k == 2 and y in (3, 22, 23):
                continue
            for x in range(44):
                t = max(1 / (1 + math.exp((math.hypot(x - cx, y - cy) - r) * 2)) for cx, cy, r in ((15, 14, 6), (30, 22, 5)))
                rows.append((k, y, x, int(60 + 150 * t), int(80 + 60 * t), int(90 + x % 7)))
    px = spark.createDataFrame(rows, "image_id int, y bigint, x bigint, r int, g int, b int")
    picks = [(k, i, x, y) for k in (1, 2, 4) for i, (x, y) in enumerate([(15, 14), (30, 21), (15, 14), (2, 2), (16, 23), (80, 5)])]
    return px, spark.createDataFrame(picks, "image_id int, id bigint, px bigint, py bigint")


def test_rims_fold_per_image(spark, monkeypatch):
    """rays and rings of an image that fits a task are not rows that join its pixels."""
    px, picks = scene(spark)
    real = D._joined_rims
    monkeypatch.setattr(D, "_joined_rims", lambda *a: 1 / 0)
    folded = {tuple(r) for r in D.rim_estimates(px, picks, K, "id").collect()}
    monkeypatch.setattr(D, "_joined_rims", real)
    monkeypatch.setattr(D, "RIM_PIXELS", 0)
    joined = {tuple(r) for r in D.rim_estimates(px, picks, K, "id").collect()}
    assert folded == joined
    # centres outside the raster, on a lacking line or on an absent image have no row; a centre near the border has no radius
    assert sorted((r[0], r[1]) for r in folded) == [(1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (2, 0), (2, 1), (2, 2), (2, 3)]
    radius = {(r[0], r[1]): r[-1] for r in folded}
    assert radius[1, 0] == radius[1, 2] and abs(radius[1, 0] - 6) <= 1.5 and radius[1, 3] is None
