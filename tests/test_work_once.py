"""What later steps read several times is made once, and spans need few shuffles."""

import math

from pyspark.sql import functions as F

from petrigrid.operators import fits as FT
from petrigrid.operators import shapes as SH


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def ring(spark, n=40):
    rows = [(k, i, 50.0 + 20 * math.cos(i * 0.3) + i % 3, 40.0 + 20 * math.sin(i * 0.3)) for k in (1, 2) for i in range(n)]
    return spark.createDataFrame(rows, "k int, i bigint, x double, y double")


def test_consensus_votes_once(spark, monkeypatch):
    """the rounds of the refit read stored inliers, not the draws and votes behind them."""
    seen, real = [], FT.refine_circles
    monkeypatch.setattr(FT, "refine_circles", lambda p, *a: seen.append(plan(p)) or real(p, *a))
    got = FT.consensus_circles(ring(spark), ["k"], "i", 3.0).collect()
    assert len(got) == 2 and "Join" not in seen[0] and "Window" not in seen[0]


def test_hulls_are_made_once(spark):
    """box, area and fitted circle read one stored hull."""
    out = SH.plate_shapes(ring(spark).select("k", "x", "y"), ["k"])
    assert "InPandas" not in plan(out) and out.count() == 2


def test_span_without_distinct(spark):
    """the span needs the sectors' shuffle and the keys', and copies of a point do not matter."""
    p = ring(spark, 9)
    circles = FT.fit_circles(p, ["k"]).select("k", "cx", "cy").collect()
    centres = spark.createDataFrame(circles, "k int, cx double, cy double")
    out = FT.arc_span(p, F.broadcast(centres), ["k"])
    assert plan(out).count("Exchange hashpartitioning") <= 2
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in FT.arc_span(p.unionByName(p), centres, ["k"]).collect()}


def test_span_tasks_follow_the_points(spark, monkeypatch):
    """more points are more tasks of the same size."""
    monkeypatch.setattr(FT, "ORDERED", 10)
    p = ring(spark)
    out = FT.arc_span(p, FT.fit_circles(p, ["k"]), ["k"])
    assert "REPARTITION_BY_NUM" in plan(out) and ", 9), REPARTITION_BY_NUM" in plan(out)
    assert out.count() == 2
