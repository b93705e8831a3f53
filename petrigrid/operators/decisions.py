"""Decisions between stored explanations of a unit: scores, runner-up, stability, review flag.

``configs(unit_id, config_id, k, base)``, ``disks(unit_id, config_id, disk_id, x, y, r)``.
A setting is ``{"id", "lambda", "s"}``; a short list of them rides along as an array, so
a sweep needs no extra join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from petrigrid.functions.scoring import WEIGHTS, size_cost
from petrigrid.session import cut

from . import matching

c = F.col
EXISTENCE_MARGIN = 0.05


def _settings(settings: list[dict]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(s["id"]).alias("setting"), F.lit(float(s["lambda"])).alias("lam"), F.lit(float(s["s"])).alias("s")) for s in settings]))


def slider_settings(lam: float, s: float, stability: float = 0.05) -> list[dict]:
    """The chosen setting and its four slider neighbours (REV4)."""
    d = 0.2 * stability
    return [
        {"id": "base", "lambda": lam, "s": s},
        {"id": "fewer", "lambda": max(0.0, lam - d), "s": s},
        {"id": "more", "lambda": lam + d, "s": s},
        {"id": "wider", "lambda": lam, "s": s * (1 + 2 * stability)},
        {"id": "tighter", "lambda": lam, "s": s / (1 + 2 * stability)},
    ]


def config_scores(configs: DataFrame, disks: DataFrame, settings: list[dict], log_r: float) -> DataFrame:
    """Score of every configuration under every setting: base + lambda * area + beta * size cost (REV1, REV15)."""
    r_med = math.exp(log_r)
    e = disks.withColumn("st", _settings(settings))
    cost = size_cost(c("r"), F.lit(log_r), c("st.s"))
    sums = e.groupBy("unit_id", "config_id", c("st.setting").alias("setting")).agg(F.sum(c("r") * c("r")).alias("_rr"), F.sum(cost).alias("_cost"))
    j = configs.withColumn("st", _settings(settings)).select("*", c("st.setting").alias("setting"), c("st.lam").alias("lam")).drop("st")
    j = j.join(sums, ["unit_id", "config_id", "setting"], "left")
    z = lambda n: F.coalesce(n, F.lit(0.0))
    score = c("base") + c("lam") * (z("_rr") / (r_med * r_med)) + z("_cost") * WEIGHTS["beta"]
    return j.select("setting", "unit_id", "config_id", "k", F.round(score, 12).alias("score"))


def decide(scores: DataFrame) -> DataFrame:
    """Best configuration and the best one of any other K per unit; ties go to the smaller K (REV2)."""
    per_k = scores.groupBy("setting", "unit_id", "k").agg(F.min(F.struct("score", "config_id")).alias("m"))
    w = W.partitionBy("setting", "unit_id").orderBy("m.score", "k")
    top = per_k.withColumn("rk", F.row_number().over(w)).where("rk <= 2")
    pick = lambda n, e: [F.max(F.when(c("rk") == n, v)).alias(a) for v, a in e]
    d = top.groupBy("setting", "unit_id").agg(
        *pick(1, [(c("m.config_id"), "best"), (c("k"), "best_k"), (c("m.score"), "best_score")]), *pick(2, [(c("m.config_id"), "runner"), (c("k"), "runner_k"), (c("m.score"), "runner_score")])
    )
    return d.withColumn("gap", c("runner_score") - c("best_score"))


def contested_area(decisions: DataFrame, disks: DataFrame, r_med: float) -> DataFrame:
    """Area of disks without a counterpart in the other explanation, in typical colonies (REV3)."""
    side = lambda cfg, name: disks.join(decisions.select("unit_id", c(cfg).alias("config_id")), ["unit_id", "config_id"]).select("unit_id", c("disk_id").alias(name), "x", "y", "r")
    a, b = cut(side("best", "a_id")), cut(side("runner", "b_id"))
    m = matching.assign_in_order(matching.same_colony(a, b, ["unit_id"], "a_id", "b_id", strict=True), ["unit_id"], "a_id", "b_id")
    loose = a.join(m, ["unit_id", "a_id"], "left_anti").select("unit_id", "r").unionByName(b.join(m, ["unit_id", "b_id"], "left_anti").select("unit_id", "r"))
    area = loose.groupBy("unit_id").agg((F.sum(c("r") * c("r")) / (r_med * r_med)).alias("_area"))
    return decisions.select("unit_id").join(area, "unit_id", "left").select("unit_id", F.coalesce("_area", F.lit(0.0)).alias("contested"))


def with_relative_gap(decisions: DataFrame, disks: DataFrame, r_med: float) -> DataFrame:
    d = cut(decisions)
    return d.join(contested_area(d, disks, r_med), "unit_id").withColumn("relative_gap", c("gap") / F.greatest(F.lit(0.25), c("contested")))


def stability_flips(decisions: DataFrame) -> DataFrame:
    """Other Ks that win under a slightly different slider position (REV4)."""
    base = decisions.where("setting = 'base'").select("unit_id", c("best_k").alias("_k"))
    j = decisions.where("setting <> 'base'").join(base, "unit_id")
    return j.groupBy("unit_id").agg(F.array_sort(F.collect_set(F.when(c("best_k") != c("_k"), c("best_k")))).alias("flips"))


def final_decisions(configs: DataFrame, disks: DataFrame, fixed: DataFrame, lam: float, s: float, log_r: float, stability: float = 0.05, review_gap: float = 0.0) -> DataFrame:
    """Recall bias for empty units, existence-only rule and the review flag (REV5).

    ``fixed(unit_id)`` lists units that hold existing colonies.
    """
    r_med = math.exp(log_r)
    scores = cut(config_scores(configs, disks, slider_settings(lam, s, stability), log_r))
    dec = cut(decide(scores))
    base = with_relative_gap(dec.where("setting = 'base'"), disks, r_med).join(stability_flips(dec), "unit_id")
    has_fixed = fixed.select("unit_id").distinct().withColumn("_fx", F.lit(True))
    b = base.join(has_fixed, "unit_id", "left").withColumn("has_fixed", F.coalesce("_fx", F.lit(False))).drop("_fx")
    near = (c("best_k") == 0) & ~c("has_fixed") & (c("runner_k") > 0) & (c("gap") < EXISTENCE_MARGIN)
    b = b.withColumn("flips", F.when(near, F.array_union("flips", F.array("runner_k"))).otherwise(c("flips")))
    more = F.array_min(F.filter("flips", lambda k: k > 0))
    b = b.withColumn("k_more", F.when((c("best_k") == 0) & ~c("has_fixed"), more))
    per_k = scores.where("setting = 'base'").groupBy("unit_id", c("k").alias("k_more")).agg(F.min(F.struct("score", "config_id")).alias("p"))
    area = disks.groupBy("unit_id", "config_id").agg((F.sum(c("r") * c("r")) / (r_med * r_med)).alias("p_area"))
    j = b.join(per_k, ["unit_id", "k_more"], "left").withColumn("config_id", c("p.config_id")).join(area, ["unit_id", "config_id"], "left")
    bias = c("p").isNotNull()
    gap2 = c("best_score") - c("p.score")
    j = j.select(
        "unit_id", "has_fixed", bias.alias("biased"),
        F.when(bias, c("p.config_id")).otherwise(c("best")).alias("best"), F.when(bias, c("k_more")).otherwise(c("best_k")).alias("best_k"),
        F.when(bias, c("best")).otherwise(c("runner")).alias("runner"), F.when(bias, c("best_k")).otherwise(c("runner_k")).alias("runner_k"),
        F.when(bias, gap2).otherwise(c("gap")).alias("gap"),
        F.when(bias, gap2 / F.greatest(F.lit(0.25), F.coalesce("p_area", F.lit(0.0)))).otherwise(c("relative_gap")).alias("relative_gap"),
        F.when(bias, F.lit(0)).otherwise(F.size("flips")).alias("n_flips"),
    )
    existence = c("runner").isNotNull() & ((c("runner_k") == 0) | (c("best_k") == 0)) & ~c("has_fixed")
    unstable = (c("n_flips") > 0) | F.coalesce(c("relative_gap") < review_gap, F.lit(False))
    return j.withColumn("review", ~existence & c("runner").isNotNull() & unstable)


def cluster_summary(decisions: DataFrame, units: DataFrame, fixed: DataFrame) -> DataFrame:
    """Colonies, chosen K, smallest gap and fixed marks per cluster (REV16)."""
    f = fixed.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n_fixed"))
    j = decisions.join(units.select("unit_id", "cluster_id"), "unit_id").join(f, "unit_id", "left")
    return j.groupBy("cluster_id").agg(F.sum("best_k").alias("chosen_k"), F.min("gap").alias("gap"), F.sum(F.coalesce("n_fixed", F.lit(0))).alias("fixed"), F.count(F.lit(1)).alias("units"))
