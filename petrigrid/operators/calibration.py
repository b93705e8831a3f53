"""Two-pass calibration of a detection run: background, contrast plane, noise, measured seeds, size prior (PIX29).

Planes are tiles throughout. Seeds of other images come as patches: small rasters of their own, keyed by image
and seed, that pass through the same steps with the colour axis of the image that is calibrated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petrigrid.plans.quantiles import exact_median
from petrigrid.session import cut

from . import measure as ME
from . import robust as R
from . import tiles as TL

c = F.col
LAB = ["l", "a", "b"]
_BG = ["bg_l", "bg_a", "bg_b"]
# Blur widths as shares of the plate, seed reach, thresholds of bright foreground, half side of a patch.
SIGMA1, SIGMA2, REACH = 0.05, 0.04, 0.06
NOISES, SHARE, GROWTH = 3, 0.25, 1.5
PATCH = 0.05


def _axis(planes: TL.Planes, q: dict) -> TL.Planes:
    return {"v": sum((planes[n] - planes["bg_" + n]) * q["axis_" + n] for n in LAB)}


def background(tiles: DataFrame, keys: list[str], weight: str, sigma: Column, keep: list[str], everywhere: bool = False) -> DataFrame:
    """``tiles`` with ``bg_l, bg_a, bg_b``; where nothing weighs, the medians of what weighs at all.

    ``everywhere``: all pixels weigh, so no median is needed.
    """
    names = ["med_" + n for n in LAB]
    if everywhere:
        named = tiles.withColumns({m: F.lit(None).cast("double") for m in names})
    else:
        px = TL.from_tiles(tiles, keys, [*LAB, weight]).where(c(weight) > 0)
        px = px.select(*keys, F.posexplode(F.array(*LAB)).alias("_ch", "_lab"))  # the three medians share one pass
        med = exact_median(px, [*keys, "_ch"], "_lab", "_med").groupBy(*keys).agg(*[F.max(F.when(c("_ch") == i, c("_med"))).alias(m) for i, m in enumerate(names)])
        named = tiles.join(cut(med), keys, "left")
    named = named.withColumn("sigma", sigma).withColumns({"bg_" + n: c(n) for n in LAB})
    blurred = TL.normalised_blur(named, keys, "sigma", weight, _BG, names).select(*keys, "ty", "tx", *_BG)
    return tiles.select(*keys, *TL.PLACE, *LAB, *keep).join(blurred, [*keys, "ty", "tx"])


def differences(tiles: DataFrame, seeds: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Lab minus background over the 3 x 3 pixels around each seed."""
    at = seeds.select(*keys, item, F.floor("px").cast("double").alias("px"), F.floor("py").cast("double").alias("py"))
    got = TL.patches(tiles, at, keys, [item], [*LAB, *_BG], F.lit(1.0))
    mean = lambda n: F.aggregate(F.flatten(c(f"pieces.{n}")), F.lit(0.0), lambda s, v: s + v) / F.aggregate("pieces", F.lit(0), lambda s, p: s + F.size(p[n]))
    return got.select(*keys, item, *[(mean(n) - mean("bg_" + n)).alias(n) for n in LAB])


def contrast(tiles: DataFrame, keys: list[str], axes: DataFrame, on: list[str], keep: list[str]) -> DataFrame:
    """Tiles of the contrast plane ``v`` and the planes ``keep``."""
    named = tiles.join(axes, on)
    return TL.pointwise(named, keys, lambda p, q: _axis(p, q) | {n: p[n] for n in keep}, ["v", *keep], [*LAB, *_BG, *keep], ("axis_l", "axis_a", "axis_b")).drop("axis_l", "axis_a", "axis_b")


def noise(tiles: DataFrame, keys: list[str], select: str | None = None, but: str | None = None, small: bool = False) -> DataFrame:
    """Robust sigma of the plane over the pixels of ``select`` outside ``but``, at least 1e-3; ``small`` rasters are ordered whole."""
    px = TL.from_tiles(tiles, keys, ["v", *[n for n in (select, but) if n]])
    px = px.where(c(select) > 0) if select else px
    px = px.where(c(but) == 0) if but else px
    median = (lambda df, v: df.groupBy(*keys).agg(F.median(v).alias("_m"))) if small else (lambda df, v: exact_median(df, keys, v, "_m"))
    dev = px.join(cut(median(px, "v")), keys).select(*keys, F.abs(c("v") - c("_m")).alias("_d"))
    return median(dev, "_d").select(*keys, F.greatest(c("_m") * R.MAD, F.lit(1e-3)).alias("noise"))


def seed_patches(tiles: DataFrame, remote: DataFrame, sizes: DataFrame, keys: list[str], item: str, source: str) -> tuple[DataFrame, DataFrame]:
    """Rasters around the seeds of other images, re-based, as tiles keyed by (image, seed), and the seeds in them.

    ``remote(keys, item, source, px, py)`` names the image that holds the seed; ``sizes(keys, w, h)`` the images.
    A seed whose image is not there has no patch.
    """
    of = [c(k).alias("_s" + str(i)) for i, k in enumerate(keys)]
    src = [f"_s{i}" for i in range(len(keys))]
    reach = F.greatest("w", "h") * PATCH
    asked = remote.select(*[c(k).alias("_t" + str(i)) for i, k in enumerate(keys)], item, c(source).alias(src[0]), "px", "py")
    asked = asked.join(sizes.select(*of, "w", "h"), src)
    edge = {"x0": F.greatest(F.lit(0), F.floor(c("px") - reach)), "y0": F.greatest(F.lit(0), F.floor(c("py") - reach)), "x1": F.least("w", F.ceil(c("px") + reach)), "y1": F.least("h", F.ceil(c("py") + reach))}
    asked = asked.withColumns({"_" + k: e.cast("long") for k, e in edge.items()})
    targets = [f"_t{i}" for i in range(len(keys))]
    base = tiles.select(*of, *TL.PLACE, *LAB)
    got = TL.patches(base, asked, src, [*targets, item], LAB, reach)
    piece = got.select(*targets, item, "_x0", "_y0", "_x1", "_y1", F.explode("pieces").alias("p"))
    px = piece.select(*[c(t).alias(k) for t, k in zip(targets, keys, strict=True)], item, "_x0", "_y0", "_x1", "_y1", c("p.y0").alias("y0"), c("p.x0").alias("x0"), c("p.w").alias("w"), *[c(f"p.{n}").alias(n) for n in LAB])
    rows = px.select(*keys, item, "_x0", "_y0", "_x1", "_y1", "y0", "x0", "w", F.posexplode(F.arrays_zip(*LAB)).alias("i", "z"))
    y, x = c("y0") + F.floor(c("i") / c("w")), c("x0") + c("i") % c("w")
    rows = rows.withColumns({"y": y - c("_y0"), "x": x - c("_x0")}).where((c("y") >= 0) & (c("x") >= 0) & (c("y") < c("_y1") - c("_y0")) & (c("x") < c("_x1") - c("_x0")))
    small = TL.to_tiles(rows.select(*keys, item, "y", "x", *[c(f"z.{n}").alias(n) for n in LAB]), [*keys, item], LAB)
    at = asked.select(*[c(t).alias(k) for t, k in zip(targets, keys, strict=True)], item, (c("px") - c("_x0")).alias("px"), (c("py") - c("_y0")).alias("py"), (c("_x1") - c("_x0")).alias("w"), (c("_y1") - c("_y0")).alias("h"), c("_x0").alias("ox"), c("_y0").alias("oy"))
    return small, at


def calibrate(planes: DataFrame, masks: DataFrame, seeds: DataFrame, keys: list[str], item: str, remote: DataFrame | None = None, source: str = "source_id", s_min: float = 0.25) -> dict[str, DataFrame]:
    """Tables of a calibration: ``plane`` (tiles of v, on, fg, saturated), ``noise``, ``seeds``, ``report``, ``prior``, ``axes``, ``appearance``.

    ``planes`` from ``lab_planes``, ``masks(keys, y, x, plate, on)`` from ``plate_region``, ``seeds(keys, item, px, py)``
    and ``remote(keys, item, source, px, py)``, all at the scale of the planes. The second pass leaves bright foreground,
    grown by 1.5 typical radii, out of the background and the noise. Images without seeds get an axis of plain
    lightness and a guessed size. Seeds outside their image, or of an image that is not there, are weak and say so in ``report``.
    """
    px = planes.join(masks.select(*keys, "y", "x", "plate", "on"), [*keys, "y", "x"])
    base = cut(TL.distance(TL.to_tiles(px.withColumn("off", ~c("on")), keys, [*LAB, "saturated", "plate", "on", "off"]), keys, "off", [*LAB, "saturated", "plate", "on"], True))
    total = F.aggregate("plate", F.lit(0.0), lambda s, v: s + v)
    sizes = cut(base.groupBy(*keys).agg(F.max(c("x0") + c("w")).alias("w"), F.max(c("y0") + c("h")).alias("h"), (F.sqrt(F.sum(total) / F.pi()) * 2).alias("diameter")))
    r_max = F.greatest(F.lit(6.0), c("diameter") * REACH)
    seeds = cut(seeds.select(*keys, item, "px", "py"))
    local = seeds.join(sizes.select(*keys, "w", "h"), keys).where("px >= 0 and py >= 0 and px < w and py < h").drop("w", "h")
    held = ["saturated", "on", "dist"]
    bg = cut(background(base.join(sizes.select(*keys, "diameter"), keys), keys, "plate", F.greatest(F.lit(4.0), c("diameter") * SIGMA1), ["saturated", "plate", "on", "dist"]))
    diffs = differences(bg, local, keys, item)
    if remote is not None:
        pk = [*keys, item]
        remote = cut(remote.select(*keys, item, source, "px", "py"))
        small, at = seed_patches(base, remote, sizes, keys, item, source)
        at, small = cut(at), cut(small)
        small = small.join(at.select(*pk, F.greatest(F.lit(4.0), F.least("w", "h") / 6).alias("width")), pk)
        small = small.withColumns({"one": F.transform("l", lambda _: F.lit(1.0)), "zero": F.transform("l", lambda _: F.lit(0.0))})
        small = cut(TL.distance(background(small, pk, "one", c("width"), ["zero"], True), pk, "zero", [*LAB, *_BG], True))
        diffs = diffs.unionByName(differences(small, at, pk, item).select(*keys, item, *LAB))
    found = R.colour_axis(cut(diffs), keys)
    plain = {"axis_l": 1.0, "axis_a": 0.0, "axis_b": 0.0}
    axes = cut(sizes.select(*keys).join(found, keys, "left").select(*keys, *[F.coalesce(n, F.lit(v)).alias(n) for n, v in plain.items()]))
    far = None
    if remote is not None:
        f = cut(contrast(small, pk, axes, keys, ["dist"]))
        reach = F.least(r_max, F.least("w", "h") / 2 - 1)
        asked = at.join(sizes.select(*keys, "diameter"), keys).withColumn("r_max", reach).drop("diameter").join(noise(f, pk, small=True), pk)
        far = ME.measured(f, asked, pk, [])
        far = cut(far.withColumns({"cx": c("cx") + c("ox"), "cy": c("cy") + c("oy"), "px": c("px") + c("ox"), "py": c("py") + c("oy")}).drop("w", "h", "ox", "oy"))

    def measured(plane: DataFrame, level: DataFrame) -> DataFrame:
        asked = local.join(level, keys).join(sizes.select(*keys, r_max.alias("r_max")), keys)
        own = ME.measured(plane, asked, keys, [item])
        return cut((own if far is None else own.unionByName(far)).withColumn("w", c("weight")))

    def priors(ms: DataFrame) -> DataFrame:
        known = R.radius_prior(ms, keys, s_min, "r", "w")
        return cut(R.fallback_prior(sizes.select(*keys, F.lit(1.0).alias("scale"), c("diameter").alias("plate_diameter")), known, ms, keys))

    first = cut(contrast(bg, keys, axes, keys, [*held, "plate"]))
    level = cut(noise(first, keys, "on"))
    ms = measured(first, level)
    prior = priors(ms)
    ref = exact_median(ms.where("snr >= 4"), keys, "contrast", "ref")
    hot = level.join(ref, keys, "left").join(prior, keys).select(*keys, F.greatest(c("noise") * NOISES, F.coalesce("ref", c("noise") * 8) * SHARE).alias("hot"), F.greatest(F.lit(1.0), c("r_med") * GROWTH).alias("grow"))
    bright = TL.pointwise(first.join(cut(hot), keys), keys, lambda p, q: {"fg": p["v"] > q["hot"]}, ["fg"], ["v"], ("hot", "grow"))
    grow = bright.select(*keys, "ty", "tx", "grow")
    grown = TL.pointwise(TL.distance(bright, keys, "fg", [], False).join(grow, [*keys, "ty", "tx"]), keys, lambda p, q: {"fg": p["dist"] <= q["grow"]}, ["fg"], ["dist"], ("grow",))
    second = base.join(grown.select(*keys, "ty", "tx", "fg"), [*keys, "ty", "tx"])
    second = second.withColumn("rest", F.zip_with("plate", "fg", lambda p, f: F.when(f > 0, 0.0).otherwise(p)))
    second = cut(second.join(sizes.select(*keys, "diameter"), keys).join(prior.select(*keys, "r_hi"), keys))
    bg2 = background(second, keys, "rest", F.greatest(F.lit(4.0), c("r_hi") * 4, c("diameter") * SIGMA2), [*held, "fg"])
    plane = cut(contrast(bg2, keys, axes, keys, [*held, "fg"]))
    level = cut(noise(plane, keys, "on", "fg"))
    ms = measured(plane, level)
    asked = seeds.select(*keys, item, F.lit("outside-image").alias("missing"))
    if remote is not None:
        asked = asked.unionByName(remote.select(*keys, item, F.lit("no-reference-image").alias("missing")))
    report = asked.join(ms, [*keys, item], "left").select(*keys, item, "cx", "cy", "r", F.coalesce("snr", F.lit(0.0)).alias("snr"), F.coalesce("quality", F.lit("weak")).alias("quality"), F.when(c("quality").isNull(), c("missing")).alias("note"))
    return {"plane": plane, "noise": level, "seeds": ms, "report": report, "prior": priors(ms), "axes": axes, "appearance": R.appearance_ranges(ms, keys, level)}


__all__ = ["background", "calibrate", "contrast", "differences", "noise", "seed_patches"]
