"""Spanning-forest regions against a sequential flood."""

import heapq
import random

from petrigrid.operators import watershed as WS

SIDES = ((1, 0), (-1, 0), (0, 1), (0, -1))


def flood(cost, markers):
    """Pixels leave the queue by (cost, raster order) and take the label of their labelled neighbour of least cost."""
    label, queue, queued = dict(markers), [], set()

    def push(x, y):
        for dx, dy in SIDES:
            p = (x + dx, y + dy)
            if p in cost and p not in label and p not in queued:
                queued.add(p)
                heapq.heappush(queue, (cost[p], p[1], p[0]))

    for p in markers:
        push(*p)
    while queue:
        _, y, x = heapq.heappop(queue)
        near = [(cost[p], p[1], p[0], label[p]) for p in ((x + dx, y + dy) for dx, dy in SIDES) if p in label]
        label[(x, y)] = min(near)[3]
        push(x, y)
    return {p: label.get(p, 0) for p in cost}


def plane(seed, w, h, holes, values):
    rng = random.Random(seed)
    cost = {(x, y): values(rng) for x in range(w) for y in range(h) if rng.random() >= holes}
    spots = rng.sample(sorted(cost), 9)
    return cost, {p: 1 + i // 2 for i, p in enumerate(spots)}  # most labels have two seed pixels


def test_against_a_flood(spark):
    pics = {
        1: plane(1, 40, 30, 0.0, lambda r: r.random()),
        2: plane(2, 40, 30, 0.3, lambda r: r.random()),
        3: plane(3, 25, 25, 0.1, lambda r: float(r.randrange(4))),  # plateaus
        4: ({(x, 0): float(-x) for x in range(60)}, {(5, 0): 1, (50, 0): 2}),
        5: ({(0, 0): 1.0, (5, 5): 2.0}, {(0, 0): 3}),
    }
    rows = [(k, y, x, v, markers.get((x, y), 0)) for k, (cost, markers) in pics.items() for (x, y), v in cost.items()]
    got = {}
    for r in WS.regions(spark.createDataFrame(rows, "k int, y long, x long, cost double, marker int"), ["k"]).collect():
        got.setdefault(r.k, {})[(r.x, r.y)] = r.label
    assert got == {k: flood(*p) for k, p in pics.items()}


def test_no_markers_and_no_pixels(spark):
    df = spark.createDataFrame([(1, 0, x, 1.0, 0) for x in range(4)], "k int, y long, x long, cost double, marker int")
    assert {r.label for r in WS.regions(df, ["k"]).collect()} == {0}
    assert WS.regions(df.limit(0), ["k"]).count() == 0


def test_images_of_any_size_flood_alike(spark, monkeypatch):
    """an image that fits a task takes no rounds, and its regions are those of the rounds."""
    rng = random.Random(3)
    rows = [(k, y, x, float(rng.randrange(5)), 1 + y * 20 + x if rng.random() < 0.03 else 0) for k in (1, 2) for y in range(18) for x in range(20) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "k int, y long, x long, cost double, marker int")
    got, real = [], WS._grown
    for most in (1 << 20, 0):
        monkeypatch.setattr(WS, "FOLD", most)
        monkeypatch.setattr(WS, "_grown", real if most == 0 else lambda *a: 1 / 0)
        got.append(sorted(tuple(r) for r in WS.regions(df, ["k"]).collect()))
    assert got[0] == got[1] and len(got[0]) == len(rows)
