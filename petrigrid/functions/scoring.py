"""Scalar parts of the detector: slider parameters, size cost, prior arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Objective weights of the tuned variant.
WEIGHTS = {"beta": 0.6, "huber": 2.0, "oversize": 2.0, "undersize": 0.5}
MARK_EVIDENCE = 3
ROUND_CV = 0.06
ROUND_SHARE = 0.3
ROUND_EVIDENCE = 3
TOUCHING_WEIGHT = 0.6
RAYS = 32


def sensitivity(s: Column) -> dict[str, Column]:
    t = F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0))
    return {
        "thr_frac": F.lit(0.5) - t * 0.3,
        "noise_k": F.lit(3.5) - t * 2,
        "lambda": F.lit(0.2) - t * 0.2,
        "log_frac": F.lit(0.45) - t * 0.35,
    }


def mask_threshold(s: Column, noise: Column, contrast: Column) -> Column:
    p = sensitivity(s)
    return F.greatest(p["noise_k"] * noise, p["thr_frac"] * contrast)


def size_cost(r: Column, log_r: Column, s: Column, huber: float = WEIGHTS["huber"], oversize: float = WEIGHTS["oversize"], undersize: float = WEIGHTS["undersize"]) -> Column:
    """Asymmetric Huber cost of a disk radius: too large counts more than too small."""
    zs = (F.log(r) - log_r) / s
    z = F.abs(zs)
    c = F.when(z <= huber, z * z * 0.5).otherwise((z - 0.5 * huber) * huber)
    return F.when(zs > 0, c * oversize).otherwise(c * undersize)


def prior_radii(log_r: Column, s: Column) -> Column:
    """Up to five radii over the prior, at least 1.5 and more than 0.4 apart."""
    steps = F.array(*[F.lit(k) for k in (-1.5, -0.75, 0.0, 0.75, 1.5)])
    radii = F.transform(steps, lambda k: F.greatest(F.lit(1.5), F.exp(log_r + k * s)))
    start = F.array().cast("array<double>")
    return F.aggregate(radii, start, lambda acc, r: F.when((F.size(acc) == 0) | (r - F.element_at(acc, -1) > 0.4), F.array_append(acc, r)).otherwise(acc))


def widen(log_r: Column, s: Column, width: Column) -> dict[str, Column]:
    w = s * width
    return {"s": w, "r_lo": F.greatest(F.lit(1.0), F.exp(log_r - w * 2)), "r_hi": F.exp(log_r + w * 2)}


def shift_prior(log_r: Column, s: Column, local: Column, n: Column, sign: int) -> Column:
    """Shifted (log_r, s) as a struct, null when the difference is small or of the wrong sign."""
    d = local - log_r
    dz = s * 0.5
    t = F.least(F.lit(1.0), (F.abs(d) - dz) / dz)
    k = F.least(F.lit(8.0), n.cast("double"))
    mu = log_r + d * t * t * (F.lit(3.0) - t * 2) * k / (k + 0.5)
    ok = F.abs(d) > dz
    if sign:
        ok = ok & (F.signum(d) == sign)
    return F.when(ok, F.struct(mu.alias("log_r"), F.greatest(s, F.abs(d) / 2).alias("s")))


def touching_usable(r: Column, blocked: Column, rays: Column, snr: Column, cv: Column) -> Column:
    return r.isNotNull() & (blocked <= 0.5) & (rays >= RAYS / 3) & (snr >= 4) & (cv <= 0.35)


def seed_quality() -> Column:
    """edge > glare > touching > weak > ok, from the measurement columns."""
    c = F.col
    return (
        F.when(c("edge_clearance") < 1, "edge")
        .when((c("saturated_frac") > 0.25) | c("dip"), "glare")
        .when(c("r").isNull(), F.when((c("blocked_frac") > 0.5) & (c("snr") >= 4), "touching").otherwise("weak"))
        .when(c("blocked_frac") + c("seam_frac") >= 0.3, "touching")
        .when((c("snr") < 4) | (c("cv") > 0.3), "weak")
        .when(c("r_edge").isNotNull() & (F.abs(F.log(c("r_edge") / c("r"))) > 0.5), "weak")
        .otherwise("ok")
    )


def seed_weight() -> Column:
    c = F.col
    usable = touching_usable(c("r"), c("blocked_frac"), c("n_rays"), c("snr"), c("cv"))
    q = seed_quality()
    return F.when(c("r").isNull(), 0.0).when(q == "ok", 1.0).when((q == "touching") & usable, TOUCHING_WEIGHT).otherwise(0.0)
