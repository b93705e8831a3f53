"""Colonies at brightness maxima (PIX30)."""

import numpy as np
from pyspark.sql import functions as F

from petrigrid.operators.detector import local_colonies


def test_two_discs_are_two_colonies(spark):
    y, x = np.mgrid[:64, :64]
    v = sum(1 / (1 + np.exp(np.hypot(x + 0.5 - cx, y + 0.5 - cy) - 5)) for cx, cy in ((18, 20), (45, 40)))
    plane = spark.createDataFrame([(1, int(i), int(j), float(v[i, j])) for i in range(64) for j in range(64)], "plane_id long, y long, x long, v double")
    lim = plane.select("plane_id").distinct().select("plane_id", F.lit(0.005).alias("noise"), F.lit(12.0).alias("r_max"), F.lit(0.3).alias("threshold"))
    got = sorted((r["x"], r["y"], r["r"]) for r in local_colonies(plane, plane, ["plane_id"], lim, 2.0).collect())
    assert len(got) == 2
    assert all(abs(a - b) < 0.5 for (gx, gy, r), want in zip(got, ((18, 20, 5), (45, 40, 5)), strict=True) for a, b in zip((gx, gy, r), want, strict=True)), got
