"""Display rendering of pixel tables: colour tables, transfer curves, smoothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petrigrid.functions import colour as K

c = F.col
N = K.GRID


def centre_table(styles: DataFrame) -> DataFrame:
    """Grey value of every grid colour per style: N^3 rows each (SCA23).

    ``styles(style_id, centre_r.., rim_r.., separation)``.
    """
    step = 255 / (N - 1)
    st = K.with_lab(styles, c("centre_r"), c("centre_g"), c("centre_b"), "_c")
    st = K.with_axis(K.with_lab(st, c("rim_r"), c("rim_g"), c("rim_b"), "_m"), "_c", "_m").select("style_id", "separation", "axis")
    side = F.sequence(F.lit(0), F.lit(N - 1))
    grid = st.withColumn("gr", F.explode(side)).withColumn("gg", F.explode(side)).withColumn("gb", F.explode(side))
    grid = K.with_lab(grid, c("gr") * step, c("gg") * step, c("gb") * step, "_p").withColumn("_t", K.axis_position(c("_p"), c("axis")))
    grid = grid.withColumn("_tone", K.centre_tone(c("_t"), c("separation")))
    tone = c("_tone")
    grey = F.when(tone <= 0, 0).when(tone >= 1, 255).otherwise(F.floor(tone * 255 + 0.5)).cast("bigint")
    return grid.select("style_id", ((c("gr") * N + c("gg")) * N + c("gb")).alias("cell"), grey.alias("v"))


def centre_lookup(colours: DataFrame, table: DataFrame) -> DataFrame:
    """Trilinear fixed-point lookup of distinct colours ``(style_id, r, g, b)``.

    Eight weighted corners per colour, an equi-join on the table cell and a sum:
    the integer weights make the result independent of the order of the sum.
    """

    def axis(name: str):
        f = c(name) * (N - 1) / 255
        i = F.least(F.lit(N - 2), F.floor(f))
        return i.cast("bigint"), F.floor((f - i) * 256 + 0.5).cast("bigint")

    cells = {k: axis(k) for k in "rgb"}
    corners = []
    for n in range(8):
        bits = {"r": n >> 2 & 1, "g": n >> 1 & 1, "b": n & 1}
        w = F.lit(1).cast("bigint")
        for k in "rgb":
            w = w * (cells[k][1] if bits[k] else F.lit(256) - cells[k][1])
        at = ((cells["r"][0] + bits["r"]) * N + cells["g"][0] + bits["g"]) * N + cells["b"][0] + bits["b"]
        corners.append(F.struct(at.alias("cell"), w.alias("w")))
    e = colours.select("style_id", "r", "g", "b", F.explode(F.array(*corners)).alias("k")).select("style_id", "r", "g", "b", "k.cell", "k.w").where("w <> 0")
    s = e.join(table, ["style_id", "cell"]).groupBy("style_id", "r", "g", "b").agg(F.sum(c("w") * c("v")).alias("s"))
    return s.select("style_id", "r", "g", "b", F.floor((c("s") + 2**23) / 2**24).cast("int").alias("grey"))


def centre_view(pixels: DataFrame, styles: DataFrame) -> DataFrame:
    """Grey of each pixel in the centre-contrast view.

    Images with equal settings share one table, and each distinct colour is looked up
    once: at most 2^24 per style, however many pixels there are.
    """
    params = [s for s in styles.columns if s != "image_id"]
    sid = styles.withColumn("style_id", F.sha2(F.concat_ws(",", *[c(p).cast("string") for p in params]), 256))
    table = centre_table(sid.select("style_id", *params).distinct())
    px = pixels.join(sid.select("image_id", "style_id"), "image_id")
    grey = centre_lookup(px.select("style_id", "r", "g", "b").distinct(), table)
    return px.join(grey, ["style_id", "r", "g", "b"]).drop("style_id")


def pick_level(levels: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest pyramid level still at least as fine as needed, else the largest (WIN17)."""
    fits = F.min(F.when(c("scale") >= c("needed"), c("scale")))
    return levels.groupBy(*keys).agg(F.coalesce(fits, F.max("scale")).alias("scale"))
