"""Image intake and pixel tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from petrigrid.functions.text import sniff_mime
from petrigrid.operators import tiles as TL

c = F.col
MAX_PIXELS = 250_000_000


def _uint(content: Column, at: int, n: int, little: bool) -> Column:
    h = F.hex(F.substring(content, at + 1, n))
    if little:
        h = F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(n))])
    return F.conv(h, 16, 10).cast("bigint")


def header_size(content: Column, mime: Column) -> Column:
    """Pixel size from the file header where it stands at a fixed place, else null."""
    wh = lambda w, h: F.struct(w.alias("w"), h.alias("h"))
    return (
        F.when(mime == "image/png", wh(_uint(content, 16, 4, False), _uint(content, 20, 4, False)))
        .when(mime == "image/bmp", wh(_uint(content, 18, 4, True), _uint(content, 22, 4, True)))
        .when(mime == "image/gif", wh(_uint(content, 6, 2, True), _uint(content, 8, 2, True)))
    )


def orientation(content: Column) -> Column:
    """Orientation tag (1 to 8) of a JPEG's EXIF block, 1 where there is none.

    The block is found by its name in the head of the file; its directory is read entry by entry in the byte order it
    names.
    """
    head = F.hex(F.substring(content, 1, 1 << 17))
    name = F.instr(head, "457869660000")
    start = ((name - 1) / 2 + 6).cast("int")
    little = F.substring(head, start * 2 + 1, F.lit(4)) == "4949"

    def number(at: Column, n: int) -> Column:
        h = F.substring(head, at * 2 + 1, F.lit(2 * n))
        back = F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(n))])
        return F.conv(F.when(little, back).otherwise(h), 16, 10).cast("int")

    first = start + number(start + 4, 4)
    entries = F.transform(F.sequence(F.lit(0), F.least(number(first, 2), F.lit(512)) - 1), lambda i: F.struct(number(first + 2 + i * 12, 2).alias("tag"), number(first + 10 + i * 12, 2).alias("value")))
    value = F.get(F.filter(entries, lambda e: e["tag"] == 0x0112), F.lit(0))["value"]
    there = (F.substring(head, 1, 4) == "FFD8") & (name > 0) & (number(first, 2) > 0)
    return F.when(there & value.between(1, 8), value).otherwise(1)


def inspect_images(files: DataFrame, decoded: DataFrame | None = None) -> DataFrame:
    """Mime, size, bytes, fingerprint per file, or the reason it is refused (SRC3).

    ``files(path, content)``; ``decoded(path, w, h)`` are sizes from the image source, used
    where the header does not tell.
    """
    f = files.withColumn("mime", sniff_mime(c("content"))).withColumn("hdr", header_size(c("content"), c("mime")))
    if decoded is not None:
        f = f.join(decoded.select("path", c("w").alias("dw"), c("h").alias("dh")), "path", "left")
    else:
        f = f.withColumns({"dw": F.lit(None).cast("bigint"), "dh": F.lit(None).cast("bigint")})
    f = f.withColumn("turned", F.when(c("mime") == "image/jpeg", orientation(c("content")) >= 5).otherwise(False))  # width and height change places
    side = lambda a, b: F.when(c("turned"), F.coalesce("d" + b, "hdr." + b)).otherwise(F.coalesce("d" + a, "hdr." + a))
    w, h = side("w", "h"), side("h", "w")
    reason = (
        F.when(F.length("content") == 0, "empty")
        .when(c("mime").isNull(), "unknown-format")
        .when(c("mime") == "image/tiff", "tiff")
        .when(w.isNull(), "undecodable")
        .when((w <= 0) | (h <= 0), "no-pixels")
        .when(w * h > MAX_PIXELS, "too-large")
    )
    return f.select("path", "mime", w.alias("width"), h.alias("height"), F.length("content").cast("bigint").alias("byte_size"), F.sha2("content", 256).alias("fingerprint"), reason.alias("rejected"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Inspect image files; sizes are those of Spark's image source, turned as EXIF says."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    dec = spark.read.format("image").option("dropInvalid", True).load(path).select(c("image.origin").alias("path"), c("image.width").cast("bigint").alias("w"), c("image.height").cast("bigint").alias("h"))
    return inspect_images(files, dec)


def decode_pixels(images: DataFrame, keys: list[str], crop: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Pixel table from decoded images ``(keys, width, height, channels, data)``, BGR(A) bytes (SRC4).

    Rows are cut from the byte string before they are exploded, so an exploded row
    carries one raster line; a crop filters lines and columns before their explode.
    """
    x0, y0, w, h = crop if crop else (0, 0, None, None)
    y1 = c("height") - 1 if h is None else F.least(c("height") - 1, F.lit(y0 + h - 1))
    x1 = c("width") - 1 if w is None else F.least(c("width") - 1, F.lit(x0 + w - 1))
    met = images.where((y1 >= y0) & (x1 >= x0))  # a crop that misses the image would count backwards
    line = met.select(*keys, "width", "channels", "data", x1.alias("x1"), F.explode(F.sequence(F.lit(y0), y1)).alias("y"))
    cut = F.expr("substring(data, CAST(y * width * channels + 1 AS INT), CAST(width * channels AS INT))")
    row = line.select(*keys, "y", "channels", "x1", cut.alias("line"))
    px = row.select(*keys, "y", "channels", "line", F.explode(F.sequence(F.lit(x0), "x1")).alias("x"))
    # a slice of binary is found by its offset; of text, by scanning
    byte = lambda k: F.conv(F.hex(F.expr(f"substring(line, CAST(x * channels + LEAST({k}, channels - 1) + 1 AS INT), 1)")), 16, 10).cast("int")
    return px.select(*keys, c("y").cast("bigint").alias("y"), c("x").cast("bigint").alias("x"), byte(2).alias("r"), byte(1).alias("g"), byte(0).alias("b"))


def _turned(a: np.ndarray, how: int) -> np.ndarray:
    """An image as it is shown, from its stored rows (EXIF orientation 1 to 8)."""
    if how >= 5:
        a = a.swapaxes(0, 1)
    if how in (2, 3, 6, 7):
        a = a[:, ::-1]
    if how in (3, 4, 7, 8):
        a = a[::-1]
    return a


def _shares(n: int, out: int) -> np.ndarray:
    """Share of each of n pixels in each of ``out`` cells of one line."""
    edge = np.arange(out + 1) * (n / out)
    low, high = np.maximum(edge[:-1, None], np.arange(n)), np.minimum(edge[1:, None], np.arange(1, n + 1))
    return np.maximum(high - low, 0) * (out / n)


def decode_tiles(images: DataFrame, keys: list[str], crop: tuple[int, int, int, int] | None = None, scale: float = 1.0) -> DataFrame:
    """Tiles with planes ``r, g, b`` of decoded images ``(keys, width, height, channels, data, orientation)`` (SRC4).

    Rotation, then the crop (x, y, width, height, as shown), then an area resize by ``scale`` act on the byte rows, so only
    the pixels asked for ever become values. A null orientation is 1; a crop beyond the image is cut to it, and an image
    that it misses gives no tile.
    """
    planes = images.select(*keys, "width", "height", "channels", "data", (F.coalesce("orientation", F.lit(1)) if "orientation" in images.columns else F.lit(1)).cast("int").alias("orientation"))
    place = T.StructType([*[planes.schema[k] for k in keys], *[T.StructField(n, T.LongType()) for n in TL.PLACE], *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in "rgb"]])
    names, m, side = place.names, len(keys), TL.SIDE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                width, height, channels, data, how = (b.column(m + k)[i].as_py() for k in range(5))
                a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
                a = _turned(a[:, :, [2, 1, 0]] if channels >= 3 else np.repeat(a[:, :, :1], 3, 2), how)
                if crop:
                    a = a[crop[1] : crop[1] + crop[3], crop[0] : crop[0] + crop[2]]
                if not a.size:
                    continue
                a = a.astype(np.float64)
                if scale != 1.0:
                    h, w = (max(1, math.floor(n * scale + 0.5)) for n in a.shape[:2])
                    a = np.einsum("ij,jkc->ikc", _shares(a.shape[0], h), a)
                    a = np.einsum("kj,ijc->ikc", _shares(a.shape[1], w), a)
                cells = [(y, x) for y in range(0, a.shape[0], side) for x in range(0, a.shape[1], side)]
                parts = [a[y : y + side, x : x + side] for y, x in cells]
                cols = [pa.array([b.column(k)[i].as_py()] * len(cells), b.schema.field(k).type) for k in range(m)]
                spot = [(y // side, x // side, y, x, *p.shape[:2]) for (y, x), p in zip(cells, parts, strict=True)]
                cols += [pa.array([s[k] for s in spot], pa.int64()) for k in range(len(TL.PLACE))]
                cols += [pa.array([p[:, :, k].ravel() for p in parts], pa.list_(pa.float64())) for k in range(3)]
                yield pa.RecordBatch.from_arrays(cols, names)

    return planes.mapInArrow(run, place)


def encode_pixels(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """The inverse of ``decode_pixels``: BGR bytes per image, built line by line."""
    hx = lambda n: F.lpad(F.hex(c(n)), 2, "0")
    line = pixels.groupBy(*keys, "y").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", F.concat(hx("b"), hx("g"), hx("r")).alias("p")))), lambda s: s["p"]), "").alias("l"), F.count(F.lit(1)).alias("width"))
    img = line.groupBy(*keys).agg(F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", "l"))), lambda s: s["l"]), "")).alias("data"), F.max("width").alias("width"), F.count(F.lit(1)).alias("height"))
    return img.withColumn("channels", F.lit(3))
