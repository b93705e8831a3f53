"""Round-based rules against plain sequential restatements, with heaps of copies and ties."""

import math
import random

import pytest
from pyspark.sql import functions as F

from petrigrid.operators import matching as M
from petrigrid.operators import shapes as SH

c = F.col


def circles(seed, n, copies):
    rnd = random.Random(seed)
    pts = [(float(rnd.randint(0, 60)), float(rnd.randint(0, 60)), float(rnd.choice([3, 4, 8, 30])), rnd.random()) for _ in range(n)]
    pts += [pts[0]] * copies
    return [(k, i, *pts[i]) for k in (1, 2) for i in range(len(pts)) if (i + k) % 5]


def greedy(rows, factor):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[5], r[1])):
        if all(math.hypot(r[2] - q[2], r[3] - q[3]) >= factor * max(r[4], q[4]) for q in kept):
            kept.append(r)
    return {(r[0], r[1]) for r in kept}


@pytest.fixture(params=["fold", "rounds"])
def way(request, monkeypatch):
    """Both ways through a key: folded in one task, and in rounds as beyond a task's size."""
    if request.param == "rounds":
        monkeypatch.setattr(M, "FOLD", 0)


@pytest.mark.parametrize("seed,factor", [(1, 0.5), (2, 1.5)])
def test_greedy_keep(spark, way, seed, factor):
    rows = circles(seed, 120, 40)
    df = spark.createDataFrame(rows, "image_id int, item int, x double, y double, r double, score double")
    got = {(r.image_id, r.item) for r in M.greedy_keep(df, ["image_id"], "item", [-c("score")], factor).where("kept").collect()}
    want = set().union(*[greedy([r for r in rows if r[0] == k], factor) for k in (1, 2)])
    assert got == want


def sequential_match(pred, gt, radius):
    cand = []
    for i, (pi, px, py) in enumerate(pred):
        for gi, gx, gy in gt:
            d = math.sqrt((px - gx) ** 2 + (py - gy) ** 2)
            if d <= radius:
                cand.append((d, pi, math.floor(gy / radius), math.floor(gx / radius), gi))
    used_p, used_g, out = set(), set(), set()
    for d, pi, _, _, gi in sorted(cand):
        if pi not in used_p and gi not in used_g:
            used_p.add(pi)
            used_g.add(gi)
            out.add((pi, gi))
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_match_points(spark, way, seed):
    rnd = random.Random(seed)
    p = [(i, float(rnd.randint(0, 25)), float(rnd.randint(0, 25))) for i in range(80)]
    g = [(i, float(rnd.randint(0, 25)), float(rnd.randint(0, 25))) for i in range(70)]
    p += [(100 + i, 5.0, 5.0) for i in range(25)]  # a heap of copies, tied with its neighbours
    g += [(100 + i, 6.0, 5.0) for i in range(15)]
    dp = spark.createDataFrame([(1, *r) for r in p], "image_id int, pid int, x double, y double")
    dg = spark.createDataFrame([(1, *r) for r in g], "image_id int, gid int, x double, y double")
    got = {(r.pid, r.gid) for r in M.match_points(dp, dg, ["image_id"], F.lit(3.0), "pid", "gid").collect()}
    assert got == sequential_match(p, g, 3.0)


def jobs(spark, run):
    """Jobs that ``run`` starts."""
    name = f"count-{random.random()}"
    spark.sparkContext.setJobGroup(name, name)
    out = run()
    ids = spark.sparkContext.statusTracker().getJobIdsForGroup(name)
    spark.sparkContext.setJobGroup("", "")
    return out, len(ids)


def test_jobs_do_not_follow_chains_or_heaps(spark):
    def line(n):
        df = spark.createDataFrame([(1, i, i * 1.0, 0.0, 1.0, 0.5) for i in range(n)], "image_id int, item int, x double, y double, r double, score double")
        return M.near_duplicates(df, ["image_id"], "item", 1.5).where("kept").count()

    def heap(n):
        a = spark.createDataFrame([(1, i, 5.0, 5.0) for i in range(n)], "image_id int, pid int, x double, y double")
        b = spark.createDataFrame([(1, i, 4.0 + 2 * (i % 2), 5.0) for i in range(n)], "image_id int, gid int, x double, y double")
        return M.match_points(a, b, ["image_id"], F.lit(3.0), "pid", "gid").count()

    (few, a), (many, b) = jobs(spark, lambda: line(10)), jobs(spark, lambda: line(1000))
    assert (few, many) == (5, 500) and b <= a + 4
    (few, a), (many, b) = jobs(spark, lambda: heap(10)), jobs(spark, lambda: heap(10_000))
    assert (few, many) == (10, 10_000) and b <= a + 4


def test_match_literals(spark):
    dp = spark.createDataFrame([(1, 0, 1.0, 0.0), (1, 1, 0.5, 0.0), (1, 2, 30.0, 0.0)], "image_id int, pid int, x double, y double")
    dg = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 10.0, 0.0)], "image_id int, gid int, x double, y double")
    pairs = M.match_points(dp, dg, ["image_id"], F.lit(3.0), "pid", "gid")
    assert [(r.pid, r.gid, r.d) for r in pairs.collect()] == [(1, 0, 0.5)]
    from petrigrid.operators.metrics import duplicate_rate, match_counts

    n = match_counts(dp, dg, pairs, ["image_id"]).first()
    assert (n.tp, n.fp, n.fn) == (1, 2, 1)
    assert abs(duplicate_rate(dp, dg, pairs, ["image_id"], F.lit(3.0), "pid", "gid").first().duplicate_rate - 1 / 3) < 1e-12


def test_farthest_points(spark):
    rnd = random.Random(5)
    pts = [(i, float(rnd.randint(0, 30)), float(rnd.randint(0, 30))) for i in range(50)]
    cx, cy = sum(p[1] for p in pts) / 50, sum(p[2] for p in pts) / 50
    pick = [min(range(50), key=lambda i: (math.hypot(pts[i][1] - cx, pts[i][2] - cy), i))]
    while len(pick) < 6:
        dist = lambda i: min(math.hypot(pts[i][1] - pts[j][1], pts[i][2] - pts[j][2]) for j in pick)
        pick.append(max((i for i in range(50) if i not in pick), key=lambda i: (round(dist(i), 12), -i)))
    df = spark.createDataFrame([(1, *p) for p in pts], "g int, i int, x double, y double")
    got = [r.i for r in M.farthest_points(df, ["g"], "i", 6).orderBy("pick").collect()]
    assert got == pick


def test_assign_in_order(spark, way):
    rnd = random.Random(6)
    edges = [(1, a, b, float(rnd.randint(1, 9))) for a in range(12) for b in range(10) if rnd.random() < 0.4]
    used, want = set(), set()
    for a in range(12):
        free = sorted((d, b) for _, aa, b, d in edges if aa == a and b not in used)
        if free:
            used.add(free[0][1])
            want.add((a, free[0][1]))
    df = spark.createDataFrame(edges, "k int, a int, b int, d double")
    assert {(r.a, r.b) for r in M.assign_in_order(df, ["k"], "a", "b").collect()} == want


def rdp(pts, tol):
    keep, stack = {0, len(pts) - 1}, [(0, len(pts) - 1)]
    while stack:
        a, b = stack.pop()
        best, best_d = -1, tol
        (ax, ay), (bx, by) = pts[a], pts[b]
        l2 = (bx - ax) ** 2 + (by - ay) ** 2
        for i in range(a + 1, b):
            x, y = pts[i]
            t = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / l2)) if l2 >= 1e-12 else 0.0
            d = math.sqrt((x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by - ay)) ** 2)
            if d > best_d:
                best, best_d = i, d
        if best >= 0:
            keep.add(best)
            stack += [(a, best), (best, b)]
    return keep


def test_simplify_paths(spark):
    rnd = random.Random(7)
    pts = [(i * 2.0, rnd.uniform(0, 6) + 10 * math.sin(i / 6)) for i in range(60)]
    df = spark.createDataFrame([(1, i, *p) for i, p in enumerate(pts)], "k int, i int, x double, y double")
    got = {r.i for r in SH.simplify_paths(df, ["k"], "i", F.lit(2.5)).collect()}
    assert got == rdp(pts, 2.5)


def test_convex_hull(spark):
    rnd = random.Random(8)
    pts = [(float(rnd.randint(0, 40)), float(rnd.randint(0, 40))) for _ in range(300)]
    df = spark.createDataFrame([(1, *p) for p in pts], "k int, x double, y double")
    got = {(r.x, r.y) for r in SH.convex_hull(df, ["k"]).collect()}

    def on_hull(p):
        rest = [q for q in set(pts) if q != p]
        ang = sorted(math.atan2(q[1] - p[1], q[0] - p[0]) for q in rest)
        gap = max([b - a for a, b in zip(ang, ang[1:])] + [ang[0] + 2 * math.pi - ang[-1]])
        return gap > math.pi + 1e-9

    assert got == {p for p in set(pts) if on_hull(p)}


def test_fold_takes_all_keys_of_a_task(spark):
    """A call in Python per task, not per key: 2,000 keys of three rows are a few dozen calls."""
    rows = spark.range(6000).selectExpr("id % 2000 as k", "id as v")
    calls = M._by_size(rows, ["k"], lambda pdf: pdf.assign(n=pdf["_key"].nunique())[["k", "n"]].head(1), "k bigint, n bigint", lambda big: big)
    got = calls.collect()
    assert len(got) <= 64 and sum(r.n for r in got) == 2000


@pytest.mark.parametrize("line", [False, True])
def test_short_paths_are_simplified_in_one_job(spark, line, monkeypatch):
    """Short paths do not go in rounds, and rounds give the same."""
    rnd = random.Random(5)
    rows = [(k, i, float(rnd.randint(0, 90)), float(rnd.randint(0, 90))) for k in range(12) for i in range(k * 3 + 1)]
    p = spark.createDataFrame(rows, "k int, i bigint, x double, y double")
    sim = lambda: {tuple(r) for r in SH.simplify_paths(p, ["k"], "i", F.lit(25.0), line=line).collect()}
    with monkeypatch.context() as m:
        m.setattr(M, "FOLD", 0)
        expected = sim()
    with monkeypatch.context() as m:
        m.setattr(SH, "_simplify_in_rounds", lambda *a: pytest.fail("in rounds"))
        assert sim() == expected
