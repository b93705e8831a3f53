"""Contours by list ranking against a walk around each component."""

import random

import pytest
from pyspark.sql import functions as F

from petrigrid.operators import contours as CT
from petrigrid.operators import shapes as SH

RING = [(-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1)]  # west, then clockwise


def walk(mask, start):
    """Clockwise around the component of ``start``, whose west neighbour is not in the mask, until its first move comes again."""
    out, at, back, first = [start], start, 0, None
    while True:
        turn = next((k for k in range(1, 9) if (at[0] + RING[(back + k) % 8][0], at[1] + RING[(back + k) % 8][1]) in mask), None)
        if turn is None:
            return out
        d = (back + turn) % 8
        if at == start:
            if d == first:
                return out
            first = d if first is None else first
        clear = (at[0] + RING[(d - 1) % 8][0], at[1] + RING[(d - 1) % 8][1])
        at = (at[0] + RING[d][0], at[1] + RING[d][1])
        back = RING.index((clear[0] - at[0], clear[1] - at[1]))
        if at != start:
            out.append(at)


def components(mask):
    left = set(mask)
    for y, x in sorted((y, x) for x, y in mask):
        if (x, y) in left:
            todo = [(x, y)]
            left.discard((x, y))
            while todo:
                a, b = todo.pop()
                for dx, dy in RING:
                    if (a + dx, b + dy) in left:
                        left.discard((a + dx, b + dy))
                        todo.append((a + dx, b + dy))
            yield (x, y)


def masks():
    rng = random.Random(4)
    out = {k: {(x, y) for x in range(24) for y in range(18) if rng.random() < p} for k, p in ((1, 0.2), (2, 0.5), (3, 0.8), (4, 0.95))}
    out[5] = {(0, 0)}
    out[6] = {(3, 0), (2, 1), (4, 1), (1, 2), (5, 2)}  # the first pixel is passed again
    out[7] = {(x, 0) for x in range(500)} | {(x, 2) for x in range(7)}
    return out


@pytest.mark.parametrize("fold", [0, CT.FOLD])
def test_against_a_walk(spark, fold, monkeypatch):
    monkeypatch.setattr(CT, "FOLD", fold)
    pics = masks()
    df = spark.createDataFrame([(k, y, x) for k, m in pics.items() for x, y in m], "k int, y long, x long")
    got = {}
    for r in CT.contours(df, ["k"]).where("outer").orderBy("k", "contour", "i").collect():
        got.setdefault((r.k, r.contour), []).append((r.i, (int(r.x), int(r.y))))
    want = [[(i, p) for i, p in enumerate(walk(m, s))] for k, m in pics.items() for s in components(m)]
    assert list(got.values()) == want


def test_holes_have_contours_of_their_own(spark):
    ring = {(x, y) for x in range(7) for y in range(6)} - {(x, y) for x in range(2, 5) for y in range(2, 4)}
    rows = CT.contours(spark.createDataFrame([(1, y, x) for x, y in ring], "k int, y long, x long"), ["k"]).collect()
    inner = {(int(r.x), int(r.y)) for r in rows if not r.outer}
    assert inner == {(x, y) for x, y in ring if any((x + a, y + b) not in ring and 0 <= x + a < 7 and 0 <= y + b < 6 for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)))}
    assert len({r.contour for r in rows}) == 2


def test_concave_points_run_on_them(spark):
    two = {(x, y) for x in range(34) for y in range(20) if (x - 9.5) ** 2 + (y - 9.5) ** 2 < 64 or (x - 22.5) ** 2 + (y - 9.5) ** 2 < 64}
    mask = spark.createDataFrame([(1, y, x) for x, y in two], "image_id int, y long, x long")
    cont = CT.contours(mask, ["image_id"]).where("outer").drop("outer")
    cuts = SH.concave_points(cont, mask, ["image_id"], ["contour"], 5).collect()
    assert len(cuts) == 2
    assert CT.contours(mask.where(F.lit(False)), ["image_id"]).count() == 0
