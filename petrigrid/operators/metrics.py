"""Detector evaluation: precision/recall, centre errors, duplicates, cluster errors, sampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petrigrid.plans import grid

from .matching import match_points

c = F.col
BINS = ["0", "1", "2", "3-5", "6-20", ">20"]
RADII = (0.6, 1.0, 2.0)  # multiples of the typical radius


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall, F1; empty sets give 1, F1 is 0 only when both are 0."""
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(1.0))
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(1.0))
    f = F.when(p + r > 0, p * r * 2 / (p + r)).otherwise(F.lit(0.0))
    return {"precision": p, "recall": r, "f1": f}


def match_counts(pred: DataFrame, gt: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """tp / fp / fn and the derived ratios per key; keys on either side appear."""
    one = F.count(F.lit(1))
    n = pred.groupBy(*keys).agg(one.alias("n_pred")).join(gt.groupBy(*keys).agg(one.alias("n_gt")), keys, "full_outer").join(pairs.groupBy(*keys).agg(one.alias("tp")), keys, "left")
    z = n.select(*keys, *[F.coalesce(x, F.lit(0)).cast("bigint").alias(x) for x in ("n_pred", "n_gt", "tp")])
    z = z.withColumns({"fp": c("n_pred") - c("tp"), "fn": c("n_gt") - c("tp")})
    return z.select(*keys, "n_pred", "n_gt", "tp", "fp", "fn", *[v.alias(k) for k, v in prf(c("tp"), c("fp"), c("fn")).items()])


def upper_median(df: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    """Element floor(n/2) of the sorted values, counted from 0.

    Equal values collapse first; the cumulative count runs over distinct values in
    chunks of the value range.
    """
    from petrigrid.plans.ranks import running_total

    per = df.where(c(value).isNotNull()).groupBy(*keys, c(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    n = per.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    cum = running_total(per, keys, "_v", "_c", F.floor(c("_v") * 4), "_cum").join(n, keys)
    return cum.where(c("_cum") > F.floor(c("_n") / 2)).groupBy(*keys).agg(F.min("_v").alias(out))


def centre_error(pairs: DataFrame, keys: list[str]) -> DataFrame:
    mean = pairs.groupBy(*keys).agg(F.avg("d").alias("mean"))
    return mean.join(upper_median(pairs, keys, "d"), keys)


def duplicate_rate(pred: DataFrame, gt: DataFrame, pairs: DataFrame, keys: list[str], radius: Column, pred_id: str, gt_id: str) -> DataFrame:
    """Unmatched predictions within the radius of a matched mark, as a share of all predictions (AGG13)."""
    free = pred.join(pairs.select(*keys, pred_id), [*keys, pred_id], "left_anti").select(*keys, pred_id, "x", "y")
    taken = gt.join(pairs.select(*keys, gt_id), [*keys, gt_id], "left_semi").withColumn("_radius", radius)
    taken = taken.groupBy(*keys, "x", "y").agg(F.max("_radius").alias("_radius"))
    near = grid.pairs_in_reach(taken, free, keys, c("_radius"), strict=False).select(*keys, c("o_" + pred_id).alias(pred_id)).distinct()
    dup = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("dup"))
    n = pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return n.join(dup, keys, "left").select(*keys, F.coalesce("dup", F.lit(0)).cast("bigint").alias("duplicates"), (F.coalesce("dup", F.lit(0)) / c("n")).alias("duplicate_rate"))


def size_bin(n: Column) -> Column:
    return F.when(n == 0, "0").when(n == 1, "1").when(n == 2, "2").when(n <= 5, "3-5").when(n <= 20, "6-20").otherwise(">20")


def cluster_errors(gt_labels: DataFrame, pred_labels: DataFrame, keys: list[str]) -> DataFrame:
    """Count error per cluster size bin; label 0 is outside any cluster (AGG14)."""
    g = gt_labels.where("label <> 0").groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))
    p = pred_labels.where("label <> 0").groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("k"))
    j = g.join(p, [*keys, "label"], "full_outer").select(*keys, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("k", F.lit(0)).alias("k"))
    return j.groupBy(*keys, size_bin(c("n")).alias("bin")).agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("n").alias("gt_colonies"), F.avg(F.abs(c("k") - c("n"))).alias("mean_abs_error"), F.count_if(c("k") == c("n")).alias("exact")
    )


def outside_counts(gt_labels: DataFrame, pred_labels: DataFrame, keys: list[str]) -> DataFrame:
    g = gt_labels.groupBy(*keys).agg(F.count_if(F.expr("label = 0")).alias("gt_outside"))
    p = pred_labels.groupBy(*keys).agg(F.count_if(F.expr("label = 0")).alias("pred_outside"))
    return g.join(p, keys, "full_outer").select(*keys, F.coalesce("gt_outside", F.lit(0)).alias("gt_outside"), F.coalesce("pred_outside", F.lit(0)).alias("pred_outside"))


def spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, sd with max(1, n-1), min, max (AGG15)."""
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.when(F.count(value) > 0, F.coalesce(F.stddev_samp(value), F.lit(0.0))).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max")
    )


def with_radii(points: DataFrame, factors=RADII) -> DataFrame:
    """Every point once per radius factor: all radii are matched in one set of rounds."""
    return points.withColumn("factor", F.explode(F.array(*[F.lit(f) for f in factors])))


def ground_truth_metrics(pred: DataFrame, gt: DataFrame, given: DataFrame, typical: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and ratios at 0.6 / 1 / 2 x the typical radius, given marks excluded (AGG16, JON26)."""
    scored = exclude_given(gt, given, typical, keys)
    p = with_radii(pred)
    g = with_radii(scored.join(typical, keys))
    pairs = match_points(p, g, [*keys, "factor"], c("factor") * c("r_typ"), "suggestion_id", "annotation_id")
    return match_counts(p, g, pairs, [*keys, "factor"])


def exclude_given(gt: DataFrame, given: DataFrame, typical: DataFrame, keys: list[str]) -> DataFrame:
    """Ground truth without the marks that coincide with given ones (within half the typical radius) (JON26)."""
    g = gt.join(typical, keys)
    m = match_points(given, g, keys, c("r_typ") * 0.5, "given_id", "annotation_id")
    return gt.join(m.select(*keys, "annotation_id"), [*keys, "annotation_id"], "left_anti")


def agreement(suggestions: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """F1 between every two methods' suggestions (AGG19); a method list is short."""
    m = suggestions.select("method").distinct()
    # broadcast: a shuffle on the method would give each method's suggestions of all images to one task
    pairs = F.broadcast(m.join(m.withColumnRenamed("method", "method_b"), c("method") < c("method_b")))
    a = suggestions.join(pairs, "method").withColumnRenamed("method", "method_a").select(*keys, "method_a", "method_b", c("suggestion_id").alias("a_id"), "x", "y")
    b = suggestions.withColumnRenamed("method", "method_b").join(F.broadcast(pairs.withColumnRenamed("method", "method_a")), "method_b").select(*keys, "method_a", "method_b", c("suggestion_id").alias("b_id"), "x", "y")
    k = [*keys, "method_a", "method_b"]
    return match_counts(a, b, match_points(a, b, k, F.lit(radius), "a_id", "b_id"), k).select(*k, F.round("f1", 2).alias("f1"))


def flagged_clusters(suggestions: DataFrame, clusters: DataFrame, keys: list[str]) -> DataFrame:
    """Review clusters: flagged themselves or holding a flagged suggestion (SET3)."""
    a = clusters.where("status = 'review'").select(*keys, "cluster_id")
    b = suggestions.where("status = 'review'").select(*keys, "cluster_id")
    return a.union(b).distinct()


def review_share(suggestions: DataFrame, clusters: DataFrame, keys: list[str]) -> DataFrame:
    """Share of suggestions in review regions, number of regions, largest region (AGG17)."""
    flagged = flagged_clusters(suggestions, clusters, keys)
    per = suggestions.groupBy(*keys, "cluster_id").agg(F.count(F.lit(1)).alias("n")).join(flagged.withColumn("f", F.lit(True)), [*keys, "cluster_id"], "full_outer")
    n, f = F.coalesce("n", F.lit(0)), F.coalesce("f", F.lit(False))
    return per.groupBy(*keys).agg(
        (F.coalesce(F.sum(F.when(f, n).otherwise(0)) / F.nullif(F.sum(n), F.lit(0)), F.lit(0.0))).alias("share"), F.count_if(f).alias("regions"), F.max(F.when(f, n).otherwise(0)).alias("largest")
    )


def under_split(clusters: DataFrame, r_median: float, factor: float = 1.8) -> DataFrame:
    """Clusters whose area implies more colonies than placed; ``strict`` = at least one more (AGG18)."""
    a0 = math.pi * r_median * r_median
    placed = c("chosen_k") + c("fixed")
    return clusters.where("status <> 'too-large'").withColumns(
        {"suspect": c("area") >= F.greatest(F.lit(1), placed) * (factor * a0), "strict": c("area") >= (placed + 1) * a0}
    ).where("suspect or strict")


def box_counts(suggestions: DataFrame, seeds: DataFrame, boxes: DataFrame, tolerance: float) -> DataFrame:
    """Suggestions, seeds and their total per counting box against an expected count (AGG20).

    ``boxes(box_id, image_id, bx, by, w, h, expected)``.
    """
    inside = (c("x") >= c("bx")) & (c("y") >= c("by")) & (c("x") < c("bx") + c("w")) & (c("y") < c("by") + c("h"))
    s = suggestions.join(boxes, "image_id").where(inside).groupBy("box_id").agg(F.count(F.lit(1)).alias("suggestions"), F.count_if(F.expr("status = 'review'")).alias("review"))
    m = seeds.join(boxes, "image_id").where(inside).groupBy("box_id").agg(F.count(F.lit(1)).alias("seeds"))
    j = boxes.join(s, "box_id", "left").join(m, "box_id", "left")
    z = lambda n: F.coalesce(n, F.lit(0)).cast("bigint").alias(n)
    j = j.select("box_id", "expected", z("suggestions"), z("seeds"), z("review")).withColumn("total", c("suggestions") + c("seeds"))
    dev = (c("total") - c("expected")) / c("expected")
    return j.withColumn("deviation", dev).withColumn("ok", F.abs(c("deviation")) <= tolerance)


def accept_statistics(decisions: DataFrame) -> DataFrame:
    """accepted / duplicates / rejected per run (AGG23)."""
    return decisions.groupBy("run_id").agg(
        F.count_if(F.expr("outcome = 'accepted'")).alias("accepted"), F.count_if(F.expr("outcome = 'duplicate'")).alias("duplicates"), F.count_if(F.expr("outcome = 'rejected'")).alias("rejected")
    )


def same_result(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Does a repeated run give identical suggestions? Row-hash sums per key on both sides (AGG24)."""

    def sig(df: DataFrame, n: str) -> DataFrame:
        rest = sorted(x for x in df.columns if x not in keys)
        h = lambda s: F.sum(F.xxhash64(F.lit(s), *rest).cast("decimal(38,0)"))
        return df.groupBy(*keys).agg(F.struct(F.count(F.lit(1)), h(1), h(2)).alias(n))

    j = sig(a, "_a").join(sig(b, "_b"), keys, "full_outer")
    return j.select(*keys, c("_a").eqNullSafe(c("_b")).alias("identical"))


def seeded_sample(df: DataFrame, keys: list[str], item: str, k: int, seed: str = "0") -> DataFrame:
    """``k`` rows per key without replacement, ordered by a hash of (seed, key, item) (SAM1)."""
    from pyspark.sql.window import Window as W

    h = F.sha2(F.concat_ws(":", F.lit(seed), *[c(x).cast("string") for x in keys], c(item).cast("string")), 256)
    w = W.partitionBy(*keys).orderBy("_h", item)
    return df.withColumn("_h", h).withColumn("_rn", F.row_number().over(w)).where(c("_rn") <= k).drop("_h", "_rn")


def resamples(df: DataFrame, keys: list[str], item: str, k: int, runs: int) -> DataFrame:
    """``runs`` seeded samples of size ``k`` per key, all in one job (SAM1)."""
    each = df.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    return seeded_sample(each, [*keys, "run"], item, k, "resample")


def jitter(df: DataFrame, item: str, radius: float, seed: str = "0") -> DataFrame:
    """Uniform in a disc, from two hash-derived uniforms (SAM2)."""
    u = lambda s: F.pmod(F.xxhash64(F.lit(f"{seed}:{s}"), c(item)), F.lit(1 << 53)) / float(1 << 53)
    ang, d = u("a") * (2 * math.pi), F.sqrt(u("d")) * radius
    return df.withColumns({"x": c("x") + d * F.cos(ang), "y": c("y") + d * F.sin(ang)})


def typical_radius(priors: DataFrame, suggestions: DataFrame, keys: list[str], fallback: float) -> DataFrame:
    """Seed prior, else upper median of fitted radii, else a fallback (STA13)."""
    med = upper_median(suggestions, keys, "r", "_m")
    return priors.join(med, keys, "left").select(*keys, F.coalesce(F.when(c("r_median") > 0, c("r_median")), c("_m"), F.lit(fallback)).alias("r_typ"))


