"""Blobs of images that fit a task and of larger ones are the same."""

import random

from petrigrid.operators import detector as D

K = ["k"]


def scene(spark):
    """Noise with a plateau; image 2 lacks lines at the top and inside, image 3 is one line, image 4 lacks single pixels."""
    rng = random.Random(5)
    rows = [(k, y, x, 1.0 if k == 1 and y < 8 else round(rng.gauss(0, 0.3), 1)) for k in (1, 2, 3, 4) for y in range(30) for x in range(26)]
    rows = [r for r in rows if not (r[0] == 2 and r[1] in (0, 11, 12)) and not (r[0] == 3 and r[1] != 4) and not (r[0] == 4 and (r[1], r[2]) in {(3, 3), (9, 20)})]
    return spark.createDataFrame(rows, "k int, y bigint, x bigint, v double")


def test_blobs_fold_per_image(spark, monkeypatch):
    """an image that fits a task takes no window pass, and the answer is that of the passes."""
    px = scene(spark)
    seen, real = [], D._window_blobs
    monkeypatch.setattr(D, "_window_blobs", lambda p, *a: seen.append({r[0] for r in p.select("k").distinct().collect()}) or real(p, *a))
    both = []
    for most in (1 << 20, 0):
        monkeypatch.setattr(D, "BLOB_PIXELS", most)
        blobs, resp = D.log_blobs(px, K, [2.0, 2.8, 4.0], 0.05)
        both.append([{tuple(r[n] for n in sorted(df.columns)) for r in df.collect()} for df in (blobs, resp)])
    assert seen == [{4}, {1, 2, 3, 4}]
    assert both[0] == both[1] and len(both[0][0]) > 10
