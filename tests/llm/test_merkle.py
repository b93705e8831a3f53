import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from petrigrid.llm import merkle_manifest as M
from petrigrid.llm.queries import _tampered

from .fixtures import CLASH

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    doc_id, text, lang, source, n = row
    n = None if n is None else n + more
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)))


def proofs(leaves):
    """Top and, per leaf, (is the sibling on the left, sibling) for each level."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, p in enumerate(at):
            paths[i].append((p % 2 == 1, level[p ^ 1] if p ^ 1 < len(level) else ""))
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
        at = [p // 2 for p in at]
    return level[0], paths


def brute(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    names = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    built = {}
    for k in names:
        trees[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        built[k] = proofs([leaf(r) for r in trees[k]])
    root, above = proofs([built[k][0] for k in names])
    out = []
    for k, up in zip(names, above, strict=True):
        for r, path in zip(trees[k], built[k][1], strict=True):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            acc = leaf(r, 1 if hit else 0)
            for left, s in path + up:
                acc = h(s, acc) if left else h(acc, s)
            out.append((r[0], leaf(r), built[k][0], root, h(*(s for _, s in path + up)), acc, acc == root))
    return out


def key(r):
    return tuple(map(str, r))


def held(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for c in (*CLASH, "k", "pos", "seg", "top", "leaf", "root"):
        df = df.withColumn(c, F.lit("clash"))
    got = M.manifest(df, _tampered()).drop("proof").collect()
    assert sorted(map(key, got)) == sorted(map(key, brute(rows)))
    return got


def rows_of(n, seed, langs):
    rng = random.Random(seed)
    return [(i if rng.random() < 0.98 else None, rng.choice(["", "é日本", "text " * rng.randrange(30), None]), rng.choice(langs), rng.choice(["a", None, ""]), rng.choice([None, i])) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3, 257, 700])
def test_proofs_of_one_tree(spark, n):
    held(spark, rows_of(n, n, ["en"]))


def test_proofs_of_many_trees(spark):
    rows = rows_of(900, 7, ["en", "en", "en", None, "", "de", "é", "z", "zz"])
    rows += [(5, "again", "en", "a", 1)] * 300 + [(5, "other", "en", "a", 1)] + [(9, "x" * 200_000, "fr", None, 3)]
    got = held(spark, rows)
    assert {r["verified"] for r in got} == {True, False}


def test_salted_rounds_agree(spark, monkeypatch):
    rows = rows_of(600, 3, ["en", "de"])
    monkeypatch.setattr(M, "SMALL", 0)
    held(spark, rows)


def test_three_levels_of_layers(spark):
    """A narrow step makes several layers and jumps of every distance."""
    rows = rows_of(300, 5, ["en"])
    old, M.STEP = M.STEP, 2
    try:
        held(spark, rows)
    finally:
        M.STEP = old


def test_no_rows(spark):
    assert M.manifest(spark.createDataFrame([], SCHEMA)).collect() == []
