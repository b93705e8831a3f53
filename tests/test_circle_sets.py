"""Two circle sets of many small keys (JON24)."""

import random

from petrigrid.operators.review import compare_options


def test_matching_is_done_once_and_keeps_keys_apart(spark):
    rng = random.Random(5)
    sets = [[(k, i, rng.uniform(0, 40), rng.uniform(0, 40), rng.uniform(3, 9)) for k in range(40) for i in range(6)] for _ in range(2)]
    a, b = (spark.createDataFrame(s, f"k long, {n} long, x double, y double, r double") for s, n in zip(sets, ("a_id", "b_id"), strict=True))
    df = compare_options(a, b, ["k"], "a_id", "b_id")
    assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().toString()  # stored, not repeated for each part
    want = []
    for k in range(40):
        xs, ys = ([c for c in s if c[0] == k] for s in sets)
        near = sorted((((p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2) ** 0.5, p[1], q[1], max(p[4], q[4])) for p in xs for q in ys)
        left, right = set(range(6)), set(range(6))
        for d, i, j, r in near:
            if d < 0.5 * r and i in left and j in right:
                left.remove(i)
                right.remove(j)
                want.append((k, "shared", i, j))
        want += [(k, "only-a", i, None) for i in left] + [(k, "only-b", None, j) for j in right]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.select("k", "part", "a_id", "b_id").collect())
