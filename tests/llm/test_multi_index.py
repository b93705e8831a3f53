import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from petrigrid.llm import multi_index as M

from .fixtures import CLASH

SCHEMA = "vec_id long, embedding array<double>, label int"


def sound(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute(rows, k):
    """Per asking row (its place): its neighbours, best first."""
    out = {}
    ok = [(i, r) for i, r in enumerate(rows) if r[0] is not None and sound(r[1])]
    for i, r in ok:
        if r[0] % 20 == 0:
            near = sorted((-float(np.dot(r[1], s[1])), s[0]) for j, s in ok if j != i and len(s[1]) == len(r[1]))
            out.setdefault(r[0], []).append(near[:k])
    return out


def run(spark, rows, k=20, recall=0.96):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for c in (*CLASH, "v", "h1", "h2", "ids", "cell", "code", "found", "query_id"):
        df = df.withColumn(c, F.lit("clash"))
    out = {}
    for r in M.nearest(df, F.col("vec_id") % 20 == 0, k, recall).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def vectors(n, d, seed, scale=True):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(8, d))
    x = centre[rng.integers(0, 8, n)] + 0.6 * rng.normal(size=(n, d))
    if not scale:
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, v.tolist(), 1) for i, v in enumerate(x)]


@pytest.mark.parametrize(("d", "scale"), [(16, False), (16, True), (64, False)])
def test_recall_and_exact_scores(spark, d, scale):
    rows = vectors(3000, d, d, scale)
    got, want = run(spark, rows), brute(rows, 20)
    assert got.keys() == want.keys()
    by_id = {r[0]: r[1] for r in rows}
    hits = 0
    for q, near in got.items():
        assert [r for r, _, _ in near] == list(range(1, 21)) and len({v for _, v, _ in near}) == 20
        for _, v, s in near:
            assert v != q and abs(s - np.dot(by_id[q], by_id[v])) < 1e-12
        assert [(-s, v) for _, v, s in near] == sorted((-s, v) for _, v, s in near)
        hits += len({v for _, v, _ in near} & {v for _, v in want[q][0]})
    assert hits / (20 * len(want)) >= 0.93


def test_every_code_within_the_radius_is_found():
    rng = random.Random(1)
    coder = M.Coder(1.0, np.zeros(4), np.zeros((4, 37)), 9, 1)
    q = np.array([rng.getrandbits(37) for _ in range(30)], np.uint64)
    m = q[np.arange(3000) % 30] ^ np.array([sum(1 << b for b in rng.sample(range(37), rng.randrange(15))) for _ in range(3000)], np.uint64)
    for splits in (1, 2, 3, 4, 6, 8):
        coder.splits = splits
        first = []
        for at, r in zip(coder.parts(), coder.radii(9), strict=True):
            first.append(M.ones(M.part(q[:, None] ^ m[None], at)) <= r)
        inside = M.ones(q[:, None] ^ m[None]) <= 9
        assert inside.any() and np.any(first, axis=0)[inside].all()


def test_awkward_rows(spark, monkeypatch):
    """Few rows: all are found. Nulls, zeros, odd lengths, repeated ids and rows, ties, huge values."""
    monkeypatch.setattr(M, "BLOCK", 7)
    monkeypatch.setattr(M, "CELL", 8)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 5)], i % 3) for i in range(60)]
    rows += [(100, None, 1), (120, [], 1), (140, [0.0] * 5, 1), (160, [1.0, None, 0.0, 0.0, 1.0], None), (180, [float("nan")] * 5, 1), (200, [float("inf"), 1.0, 0.0, 0.0, 0.0], 1)]
    rows += [(None, [1.0] * 5, 1), (220, [1.0, 2.0], None), (221, [2.0, 1.0], 1), (240, [3.0], 1), (260, [1.0] * 5, 1), (260, [1.0] * 5, 1), (260, [-1.0, 1.0, 1.0, 1.0, 1.0], 1)]
    rows += [(300 + i, [2.0, 1.0, 2.0, 1.0, 0.0], 1) for i in range(45)]
    got, want = run(spark, rows, k=20), brute(rows, 20)
    assert got.keys() == {q for q, lists in want.items() if any(lists)}
    for q, lists in want.items():
        flat = sorted((i + 1, v, round(-s, 9)) for near in lists for i, (s, v) in enumerate(near))
        assert sorted((r, v, round(s, 9)) for r, v, s in got.get(q, [])) == flat


def test_queries_that_find_too_few_go_again(spark):
    rows = vectors(400, 12, 9) + [(1000 + 20 * i, (-5 * np.eye(12)[i % 12]).tolist(), 1) for i in range(5)]
    got = run(spark, rows, recall=0.05)
    assert all(len(near) == 20 for near in got.values())


def test_huge_lengths_and_no_rows(spark):
    rows = [(20 * i, [1e200 * (i + 1), -1e180, 1.0], 1) for i in range(5)]
    got = run(spark, rows)
    assert {len(x) for x in got.values()} == {4}
    assert run(spark, [], 20) == {}
