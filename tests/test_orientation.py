"""EXIF orientation: read from the file's head, applied before pixels become rows."""

import struct

import numpy as np
from pyspark.sql import functions as F

from petrigrid.operators import pixels as P
from petrigrid.operators import tiles as TL
from petrigrid.sources import images as I

# Where the stored first row and first column are shown.
SHOWN = {1: ("top", "left"), 2: ("top", "right"), 3: ("bottom", "right"), 4: ("bottom", "left"), 5: ("left", "top"), 6: ("right", "top"), 7: ("right", "bottom"), 8: ("left", "bottom")}


def jpeg(value, order="<", tag=0x0112, before=2):
    entries = [(0x010F + k, 2, 1, 0) for k in range(before)] + [(tag, 3, 1, value)]
    body = struct.pack(order + "H", len(entries)) + b"".join(struct.pack(order + "HHI", t, kind, n) + (struct.pack(order + "HH", v, 0) if kind == 3 else b"\0" * 4) for t, kind, n, v in entries)
    tiff = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + body
    app = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app) + 2) + app + b"\xff\xd9"


def test_tag_from_columns(spark):
    rows = [(f"{o}{v}", bytearray(jpeg(v, o)), v) for o in "<>" for v in range(1, 9)]
    rows += [("none", bytearray(jpeg(6, tag=0x0100)), 1), ("odd", bytearray(jpeg(77)), 1), ("plain", bytearray(b"\xff\xd8\xff\xdb\x00\x04ab\xff\xd9"), 1), ("png", bytearray(b"\x89PNG" + jpeg(6)), 1), ("empty", bytearray(), 1), ("cut", bytearray(jpeg(6)[:16]), 1)]
    got = spark.createDataFrame(rows, "k string, content binary, want int").withColumn("o", I.orientation(F.col("content")))
    assert {r.k: r.o for r in got.collect()} == {k: w for k, _, w in rows}


def test_turned_sizes_at_intake(spark):
    files = spark.createDataFrame([("a", bytearray(jpeg(6))), ("b", bytearray(jpeg(3)))], "path string, content binary")
    sizes = spark.createDataFrame([("a", 40, 30), ("b", 40, 30)], "path string, w long, h long")
    assert {r.path: (r.width, r.height) for r in I.inspect_images(files, sizes).collect()} == {"a": (30, 40), "b": (40, 30)}


def shown(a, how):
    """By the definition: where the first row and the first column go."""
    row, col = SHOWN[how]
    if row in ("left", "right"):  # stored rows are shown as columns
        a = np.transpose(a, (1, 0, 2))
    if "right" in (row, col):
        a = a[:, ::-1]
    if "bottom" in (row, col):
        a = a[::-1]
    return a


def test_eight_orientations_crop_and_scale(spark):
    rng = np.random.default_rng(2)
    stored = rng.integers(0, 256, (70, 90, 3), np.uint8)
    rows = [(how, 90, 70, 3, bytearray(stored[:, :, ::-1].tobytes()), how) for how in range(1, 9)]
    img = spark.createDataFrame(rows, "k int, width int, height int, channels int, data binary, orientation int")
    for crop, scale in ((None, 1.0), ((5, 3, 40, 66), 1.0), ((5, 3, 40, 60), 0.5)):
        tiles = I.decode_tiles(img, ["k"], crop, scale)
        got = {(r.k, r.y, r.x): (r.r, r.g, r.b) for r in TL.from_tiles(tiles, ["k"], ["r", "g", "b"]).collect()}
        for how in SHOWN:
            a = shown(stored, how).astype(float)
            if crop:
                a = a[crop[1] : crop[1] + crop[3], crop[0] : crop[0] + crop[2]]
            if scale != 1.0:
                a = a.reshape(a.shape[0] // 2, 2, a.shape[1] // 2, 2, 3).mean((1, 3))
            assert {p for p in got if p[0] == how} == {(how, y, x) for y in range(a.shape[0]) for x in range(a.shape[1])}
            assert all(np.allclose(got[how, y, x], a[y, x]) for y in range(a.shape[0]) for x in range(a.shape[1]))


def test_uneven_scale_equals_the_row_form(spark):
    a = np.random.default_rng(3).integers(0, 256, (17, 23, 3), np.uint8)
    img = spark.createDataFrame([(1, 23, 17, 3, bytearray(a[:, :, ::-1].tobytes()))], "k int, width int, height int, channels int, data binary")
    got = {(r.y, r.x): r.r for r in TL.from_tiles(I.decode_tiles(img, ["k"], None, 0.4), ["k"], ["r"]).collect()}
    px = spark.createDataFrame([(1, y, x, float(a[y, x, 0])) for y in range(17) for x in range(23)], "k int, y long, x long, v double")
    sizes = spark.createDataFrame([(1, 23, 17, 9, 7)], "k int, w long, h long, ow long, oh long")
    want = {(r.y, r.x): r.v for r in P.resize_area(px, ["k"], sizes).collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    assert I.decode_tiles(img, ["k"], (50, 50, 3, 3)).count() == 0
