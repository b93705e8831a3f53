"""Filters on tiles equal the pixel-row forms."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from petrigrid.operators import pixels as P
from petrigrid.operators import tiles as TL

c = F.col
K = ["k"]


@pytest.fixture(scope="module")
def raster(spark):
    rng = random.Random(5)
    rows = [(k, y, x, rng.random(), float((x * 7 + y * 3 + k) % 5)) for k, (w, h) in {1: (150, 70), 2: (64, 50), 3: (1, 130), 4: (65, 1)}.items() for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "k int, y long, x long, v double, u double").persist()


def held(tiles, rows, column="v", tolerance=1e-9):
    got = {(r.k, r.y, r.x): r[column] for r in TL.from_tiles(tiles, K, [column]).collect()}
    want = {(r.k, r.y, r.x): r[column] for r in rows.select("k", "y", "x", column).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[p] - want[p]) for p in want) <= tolerance


def test_round_trip(raster):
    t = TL.to_tiles(raster, K, ["v", "u"])
    assert t.count() == 6 + 1 + 3 + 2
    held(t, raster)
    held(t, raster, "u")


@pytest.mark.parametrize("r", [1, 5, 64, 70])
def test_box(raster, r):
    held(TL.box_blur(TL.to_tiles(raster, K, ["v", "u"]), K, r, ["v", "u"]), P.box_blur(raster, K, r))


@pytest.mark.parametrize("sigma", [0.7, 3.0, 12.0, 30.0])
def test_gaussian(raster, sigma):
    held(TL.gaussian_blur(TL.to_tiles(raster, K, ["v"]), K, sigma, ["v"]), P.gaussian_blur(raster, K, sigma))


def test_two_widths_in_one_job(raster):
    t = TL.to_tiles(raster, K, ["v"]).withColumn("s", F.when(c("k") % 2 == 0, 2.0).otherwise(11.0))
    both = P.gaussian_blur(raster.where("k % 2 = 0"), K, 2.0).unionByName(P.gaussian_blur(raster.where("k % 2 = 1"), K, 11.0))
    held(TL.gaussian_blur(t, K, "s", ["v"]), both)


def test_normalised(raster):
    px = raster.withColumn("m", F.when((c("x") + c("y")) % 3 == 0, 0.0).otherwise(1.0)).withColumn("m", F.when(c("k") == 4, 0.0).otherwise(c("m")))
    t = TL.to_tiles(px, K, ["v", "u", "m"]).withColumns({"s": F.lit(2.5), "fv": F.lit(0.25), "fu": F.lit(None).cast("double")})
    got = TL.normalised_blur(t, K, "s", "m", ["v", "u"], ["fv", "fu"])
    want = P.normalised_blur(px, K, 2.5, "m", ["v", "u"], {"v": F.lit(0.25)})
    held(got, want)
    held(got, want, "u")


@pytest.mark.parametrize(("op", "form"), [("erode", P.erode), ("dilate", P.dilate), ("open", P.opening), ("close", P.closing)])
@pytest.mark.parametrize("r", [1, 4, 40])
def test_morphology(raster, op, form, r):
    held(TL.morphology(TL.to_tiles(raster, K, ["v"]), K, r, op, ["v"]), form(raster, K, r), tolerance=0)


def test_median(raster):
    held(TL.median_filter(TL.to_tiles(raster, K, ["v"]), K, 2, ["v"]), P.median_filter(raster, K, 2), tolerance=0)


def test_log_responses(raster):
    t = TL.log_responses(TL.to_tiles(raster, K, ["v"]), K, [1.5, 2.5])
    for k, s in enumerate((1.5, 2.5)):
        held(t, P.log_response(raster, K, s).withColumnRenamed("v", f"r{k}"), f"r{k}")


def test_patches_hold_what_is_in_reach(spark, raster):
    items = spark.createDataFrame([(1, 1, 63.5, 20.0), (1, 2, 0.0, 0.0), (3, 1, 0.5, 64.0)], "k int, i int, px double, py double")
    size = {1: (150, 70), 3: (1, 130)}
    v = {(r.k, r.y, r.x): r.v for r in raster.collect()}
    for r in TL.patches(TL.to_tiles(raster, K, ["v"]), items, K, ["i"], ["v"], F.lit(9.0)).collect():
        got = {(r.k, p.y0 + i // p.w, p.x0 + i % p.w): x for p in r.pieces for i, x in enumerate(p.v)}
        ys = range(max(0, math.floor(r.py - 9)), min(size[r.k][1], math.ceil(r.py + 9) + 1))
        xs = range(max(0, math.floor(r.px - 9)), min(size[r.k][0], math.ceil(r.px + 9) + 1))
        assert got == {(r.k, y, x): v[(r.k, y, x)] for y in ys for x in xs}


def test_extreme_by_doubling():
    a = np.random.default_rng(1).random((9, 14))
    for r in range(1, 6):
        want = np.array([[a[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1].max() for x in range(14)] for y in range(9)])
        assert (TL.extreme(a, r, np.maximum) == want).all()
