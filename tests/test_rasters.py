"""Components, holes, distances, quantiles and seed sizes against brute force or analytic pictures."""

import math
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from petrigrid.operators import components as CC
from petrigrid.operators import pixels as P
from petrigrid.plans.quantiles import exact_quantiles
from petrigrid.plans.ranks import ordered_rank, running_total

c = F.col
K = ["k"]


def noise_mask(seed, w, h, p):
    rnd = random.Random(seed)
    return {(x, y) for x in range(w) for y in range(h) if rnd.random() < p}


def flood(mask, step):
    left, out = set(mask), []
    for y, x in sorted((y, x) for x, y in mask):
        if (x, y) not in left:
            continue
        comp, stack = set(), [(x, y)]
        left.discard((x, y))
        while stack:
            q = stack.pop()
            comp.add(q)
            for dx, dy in step:
                n = (q[0] + dx, q[1] + dy)
                if n in left:
                    left.discard(n)
                    stack.append(n)
        out.append(frozenset(comp))
    return out


S4 = [(1, 0), (-1, 0), (0, 1), (0, -1)]
S8 = S4 + [(1, 1), (1, -1), (-1, 1), (-1, -1)]


@pytest.mark.parametrize("fold", [0, CC.FOLD])
def test_components(spark, fold, monkeypatch):
    monkeypatch.setattr(CC, "FOLD", fold)
    for conn, step in ((8, S8), (4, S4)):
        mask = noise_mask(conn, 30, 25, 0.45)
        df = spark.createDataFrame([(1, y, x) for x, y in mask], "k int, y long, x long")
        runs, stats = CC.label_components(df, K, conn)
        got = {}
        for r in CC.to_pixels(runs, K, "label").collect():
            got.setdefault(r.label, set()).add((r.x, r.y))
        want = flood(mask, step)
        assert [frozenset(got[i + 1]) for i in range(len(want))] == want
        areas = {r.label: r.area for r in stats.collect()}
        assert [areas[i + 1] for i in range(len(want))] == [len(w) for w in want]


def test_fill_holes(spark):
    w, h = 24, 20
    mask = noise_mask(3, w, h, 0.6)
    raster = spark.createDataFrame([(1, y, x, (x, y) in mask) for x in range(w) for y in range(h)], "k int, y long, x long, on boolean")
    got = {(r.x, r.y) for r in CC.fill_holes(raster, K, P.size_of(raster, K)).where("on").collect()}
    bg = {(x, y) for x in range(w) for y in range(h)} - mask
    outside = set().union(*[q for q in flood(bg, S4) if any(x in (0, w - 1) or y in (0, h - 1) for x, y in q)])
    assert got == {(x, y) for x in range(w) for y in range(h)} - outside


def test_distance_without_target(spark):
    r = spark.createDataFrame([(1, y, x) for x in range(4) for y in range(3)], "k int, y long, x long")
    assert {q.dist for q in P.distance_transform(r, K, F.lit(False), border=False).collect()} == {1e10}


def test_quantiles_with_a_hot_value(spark):
    rnd = random.Random(1)
    vals = [rnd.gauss(0, 1) for _ in range(3000)] + [0.25] * 2000
    df = spark.createDataFrame([(1, v) for v in vals], "k int, v double")
    got = exact_quantiles(df, K, "v", {"a": 0.5, "b": 0.37, "c": 1.0, "d": 0.0}).first()
    s = sorted(vals)

    def q(p):
        pos = p * (len(s) - 1)
        lo = math.floor(pos)
        return s[lo] + (s[math.ceil(pos)] - s[lo]) * (pos - lo)

    assert all(abs(x - y) < 1e-12 for x, y in zip((got.a, got.b, got.c, got.d), (q(0.5), q(0.37), s[-1], s[0])))


def test_chunked_ranks(spark):
    rnd = random.Random(2)
    rows = [(i % 3, v, 1.0 + v % 5) for i, v in enumerate(rnd.sample(range(100000), 600))]
    df = spark.createDataFrame(rows, "k int, v long, w double")
    chunk = F.floor(c("v") / 700)
    got = {(r.k, r.v): r.rank for r in ordered_rank(df, K, "v", chunk=chunk).collect()}
    tot = {(r.k, r.v): r.total for r in running_total(df, K, "v", "w", chunk).collect()}
    for k in range(3):
        acc = 0.0
        for n, (_, v, w) in enumerate(sorted(r for r in rows if r[0] == k)):
            acc += w
            assert got[(k, v)] == n + 1 and abs(tot[(k, v)] - acc) < 1e-9


def png(path, w, h, rgb):
    raw = b"".join(b"\0" + b"".join(bytes(rgb(x, y)) for x in range(w)) for y in range(h))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_files(spark, tmp_path):
    from petrigrid.sources.images import decode_pixels, inspect_images, read_images

    png(tmp_path / "a.png", 5, 4, lambda x, y: (x * 10, y * 20, 7))
    (tmp_path / "b.png").write_bytes(b"nothing")
    rows = {r.path.rsplit("/", 1)[1]: r for r in read_images(spark, str(tmp_path / "*.png")).collect()}
    assert (rows["a.png"].mime, rows["a.png"].width, rows["a.png"].height, rows["a.png"].rejected) == ("image/png", 5, 4, None)
    assert rows["b.png"].rejected == "unknown-format"
    # file sources skip empty files, so an empty one only arrives as a row
    empty = inspect_images(spark.createDataFrame([("e", bytearray())], "path string, content binary")).first()
    assert empty.rejected == "empty"
    img = spark.read.format("image").load(str(tmp_path / "a.png")).select(c("image.origin").alias("k"), "image.width", "image.height", c("image.nChannels").alias("channels"), "image.data")
    px = {(r.x, r.y): (r.r, r.g, r.b) for r in decode_pixels(img, K).collect()}
    assert px == {(x, y): (x * 10, y * 20, 7) for x in range(5) for y in range(4)}


def test_seed_radius_of_a_disk(spark):
    from petrigrid.operators.detector import measure_seeds

    edge = lambda d: 1 / (1 + math.exp((d - 8) * 2))
    rows = [(1, y, x, 50 * edge(math.hypot(x + 0.5 - 25, y + 0.5 - 20))) for x in range(50) for y in range(40)]
    plane = spark.createDataFrame(rows, "image_id int, y long, x long, v double")
    seeds = spark.createDataFrame([(1, 7, 26.5, 21.0, 0.2, 18.0)], "image_id int, s int, px double, py double, noise double, r_max double")
    m = measure_seeds(plane, seeds, ["image_id"], "s").first()
    assert m.quality == "ok" and abs(m.r - 8) < 0.4 and math.hypot(m.cx - 25, m.cy - 20) < 0.3
