"""Components of images that fit a task and of larger ones are the same."""

import random

from petrigrid.operators import components as CC


def test_labels_fold_per_image(spark, monkeypatch):
    """an image that fits a task is labelled in one fold, and the labels are those of the joins."""
    rng = random.Random(8)
    rows = [(k, y, x) for k in (1, 2, 3) for y in range(24) for x in range(70) if rng.random() < 0.2 + 0.2 * k and y != 9]
    df = spark.createDataFrame(rows, "k int, y bigint, x bigint")
    real, order = CC._joined_labels, lambda d: sorted(tuple(r[n] for n in sorted(d.columns)) for r in d.collect())
    for near in (4, 8):
        got = []
        for most in (200_000, 0):
            monkeypatch.setattr(CC, "FOLD", most)
            monkeypatch.setattr(CC, "_joined_labels", real if most == 0 else lambda *a: 1 / 0)
            got.append([order(d) for d in CC.label_components(df, ["k"], near)])
        assert got[0] == got[1] and len(got[0][1]) > 10
    assert CC.label_components(df.limit(0), ["k"])[1].count() == 0
