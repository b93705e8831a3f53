"""Suggestion review and acceptance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stale_layers(layers: DataFrame, images: DataFrame, groups: DataFrame) -> DataFrame:
    """Layers that can no longer be trusted (FIL12)."""
    i = images.select("image_id", F.col("fingerprint").alias("_fp"), F.col("deleted_at").alias("_del"), F.col("source_mismatch").alias("_mm"))
    g = groups.select("group_id", F.lit(True).alias("_g"))
    j = layers.join(i, "image_id", "left").join(g, "group_id", "left")
    stale = F.col("_fp").isNull() | F.col("_del").isNotNull() | F.col("_mm") | (F.col("_fp") != F.col("image_fingerprint")) | F.col("_g").isNull()
    return j.where(stale).select(layers.columns)


from pyspark.sql.window import Window as W  # noqa: E402

from petrigrid.functions.text import review_question  # noqa: E402
from petrigrid.plans.ranks import ordered_rank  # noqa: E402
from petrigrid.session import cut  # noqa: E402

from . import matching, spatial  # noqa: E402
from .counts import MAX_SEEDS, MIN_SEEDS, is_confirmed, manual  # noqa: E402

c = F.col
COMPARE_MAX_SEEDS = 8


def resolved_clusters(marks: DataFrame, runs: DataFrame) -> DataFrame:
    """Clusters that current marks accepted through one of the given runs (JON23)."""
    return marks.join(runs.select("run_id"), "run_id", "left_semi").select("image_id", "cluster_id").distinct()


def compare_options(a: DataFrame, b: DataFrame, keys: list[str], a_id: str, b_id: str) -> DataFrame:
    """Two circle sets as shared / only-a / only-b rows (JON24)."""
    m = cut(matching.match_circles(a, b, keys, a_id, b_id))  # asked three times below
    only_a = a.join(m, [*keys, a_id], "left_anti").select(*keys, F.lit("only-a").alias("part"), a_id, F.lit(None).cast("bigint").alias(b_id))
    only_b = b.join(m, [*keys, b_id], "left_anti").select(*keys, F.lit("only-b").alias("part"), F.lit(None).cast("bigint").alias(a_id), b_id)
    return m.select(*keys, F.lit("shared").alias("part"), a_id, b_id).unionByName(only_a).unionByName(only_b)


def alternative_diff(primary: DataFrame, alt: DataFrame, keys: list[str], a_id: str, b_id: str) -> DataFrame:
    """What the alternative removes and adds, primaries matched in list order (JON25)."""
    m = matching.assign_in_order(matching.same_colony(primary, alt, keys, a_id, b_id, strict=False), keys, a_id, b_id)
    gone = primary.join(m, [*keys, a_id], "left_anti").select(*keys, F.lit("removed").alias("change"), c(a_id).alias("disk_id"))
    new = alt.join(m, [*keys, b_id], "left_anti").select(*keys, F.lit("added").alias("change"), c(b_id).alias("disk_id"))
    return gone.unionByName(new)


def reading_order(df: DataFrame, keys: list[str], y: str, x: str, tie: str) -> DataFrame:
    """Top to bottom, then left to right (WIN8)."""
    return ordered_rank(df.withColumn("_k", F.struct(y, x, tie)), keys, "_k", "position", chunk=F.floor(c(y) / 256)).drop("_k")


def top_candidates(suggestions: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Best ``n`` by score, numbered in reading order (WIN9)."""
    w = W.partitionBy(*keys).orderBy(F.coalesce("score", F.lit(0.0)).desc(), "suggestion_id")
    top = suggestions.withColumn("_rk", F.row_number().over(w)).where(c("_rk") <= n).drop("_rk")
    return top.withColumn("number", F.row_number().over(W.partitionBy(*keys).orderBy("y", "x", "suggestion_id")).cast("bigint"))


def auto_seeds(suggestions: DataFrame, keys: list[str], n: int = 7) -> DataFrame:
    """Best isolated suggestions: alone in their cluster (WIN10)."""
    alone = suggestions.groupBy(*keys, "cluster_id").agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct("suggestion_id", "x", "y", "score")).alias("s")).where("_n = 1").select(*keys, "cluster_id", "s.*")
    w = W.partitionBy(*keys).orderBy(F.coalesce("score", F.lit(0.0)).desc(), "suggestion_id")
    return alone.withColumn("_rk", F.row_number().over(w)).where(c("_rk") <= n).drop("_rk")


def largest_seeds(marks: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The ``k`` marks with the largest radius, list order on ties (WIN11)."""
    w = W.partitionBy(*keys).orderBy(F.coalesce("r", F.lit(0.0)).desc(), "ord")
    return marks.withColumn("_rk", F.row_number().over(w)).where(c("_rk") <= k).drop("_rk")


def comparison_plan(marks: DataFrame, vertices: DataFrame, group: str) -> DataFrame:
    """Role of each manual mark in a comparison, both seed modes (WIN13).

    inside: up to eight spread-out marks of the region are seeds, the rest is scored;
    outside: the most recent marks outside are seeds, all marks inside are scored.
    Regions with too few marks for a mode give no rows for it.
    """
    m = marks.where(c("group_id") == group)
    ins = spatial.in_region(m, vertices, "annotation_id", ["image_id"])
    good = m.where(manual() & is_confirmed())
    inside = good.join(ins, ["image_id", "annotation_id"]).select("region_id", "image_id", "annotation_id", "x", "y", "ord")
    n = inside.groupBy("region_id").agg(F.count(F.lit(1)).alias("n"))
    k = F.least(F.lit(COMPARE_MAX_SEEDS), F.greatest(F.lit(MIN_SEEDS), F.floor(c("n") / 2)))
    enough = n.where(c("n") >= MIN_SEEDS + 1).withColumn("k", k)
    picks = matching.farthest_points(inside.join(enough, "region_id", "left_semi"), ["region_id"], "annotation_id", COMPARE_MAX_SEEDS)
    seeds = picks.join(enough, "region_id").where((c("pick") <= c("k"))).select("region_id", "annotation_id")
    # farthest-point picks are nested: the first k of eight are the picks for k
    scored = inside.join(enough, "region_id", "left_semi").join(seeds, ["region_id", "annotation_id"], "left_anti").select("region_id", "annotation_id")
    role = lambda df, mode, r: df.select("region_id", "annotation_id", F.lit(mode).alias("mode"), F.lit(r).alias("role"))
    a = role(seeds, "inside", "seed").unionByName(role(scored, "inside", "scored"))
    regions = vertices.select("region_id", "image_id").distinct()
    out = good.join(regions, "image_id").join(ins, ["region_id", "annotation_id"], "left_anti")
    w = W.partitionBy("region_id").orderBy(c("ord").desc())
    last = out.withColumn("_rk", F.row_number().over(w)).where(c("_rk") <= MAX_SEEDS)
    able = last.groupBy("region_id").agg(F.count(F.lit(1)).alias("m")).where(c("m") >= MIN_SEEDS).join(n, "region_id").select("region_id")
    b = role(last.join(able, "region_id", "left_semi"), "outside", "seed").unionByName(role(inside.join(able, "region_id", "left_semi"), "outside", "scored"))
    return a.unionByName(b)


IMG = ["image_id"]


def reconcile_clusters(clusters: DataFrame, kept: DataFrame, alternatives: DataFrame) -> DataFrame:
    """Cluster K, runner-up K and status after suggestions were filtered (REV6); too-large clusters stay as they are.

    ``clusters(image_id, cluster_id, chosen_k, runner_up_k, status)``, ``kept`` the surviving suggestions,
    ``alternatives(image_id, cluster_id, ...)`` the surviving circles of runner-ups, one row each;
    clusters with a runner-up carry ``has_alternative``. An alternative of as many colonies as the cluster goes.
    """
    key = ["image_id", "cluster_id"]
    k = kept.groupBy(*key).agg(F.count(F.lit(1)).alias("_k"))
    a = alternatives.groupBy(*key).agg(F.count(F.lit(1)).alias("_a"))
    j = clusters.join(k, key, "left").join(a, key, "left")
    n, m = F.coalesce("_k", F.lit(0)), F.coalesce("_a", F.lit(0))
    big, alt = c("status") == "too-large", c("has_alternative")
    same = alt & (n == m) & ~big
    runner_up = F.when(big | ~alt, c("runner_up_k")).when(~same, m)
    return j.select(*key, F.when(big, c("chosen_k")).otherwise(n).alias("chosen_k"), runner_up.alias("runner_up_k"), F.when(same, "ok").otherwise(c("status")).alias("status"), (alt & ~same).alias("has_alternative"))


def pending_marks(suggestions: DataFrame, clusters: DataFrame, marks: DataFrame, rejected: DataFrame, resolved: DataFrame) -> DataFrame:
    """Suggestions still pending with their state ok / review / rejected (REV7).

    Dropped: near-duplicates of a better one, resolved clusters, and those a current mark covers.
    """
    from .metrics import flagged_clusters

    best = matching.near_duplicates(suggestions, IMG, "suggestion_id").where("kept").drop("kept")
    open_ = best.join(resolved, ["image_id", "cluster_id"], "left_anti")
    shown = spatial.uncovered(open_, marks, IMG, "suggestion_id")
    rev = flagged_clusters(suggestions, clusters, IMG).withColumn("_rev", F.lit(True))
    rej = rejected.select("suggestion_id").distinct().withColumn("_rej", F.lit(True))
    j = shown.join(rev, ["image_id", "cluster_id"], "left").join(rej, "suggestion_id", "left")
    state = F.when(c("_rej"), "rejected").when(c("_rev"), "review").otherwise("ok")
    return j.select("image_id", "cluster_id", "suggestion_id", "x", "y", "r", "score", "status", state.alias("state"), F.coalesce("_rev", F.lit(False)).alias("in_review"))


def pending_counts(pending: DataFrame) -> DataFrame:
    s = c("state")
    return pending.groupBy("image_id").agg(
        F.count_if(s != "rejected").alias("suggested"), F.count_if(s == "review").alias("need_review"), F.count_if(s == "rejected").alias("rejected"), F.count_if(s == "ok").alias("ok")
    )


def review_clusters(pending: DataFrame) -> DataFrame:
    """Review regions with their pending and rejected suggestions, box and question."""
    p = pending.where("in_review").groupBy("image_id", "cluster_id").agg(
        F.count_if(c("state") != "rejected").alias("primary"),
        F.count_if(c("state") == "rejected").alias("rejected"),
        F.min(c("x") - c("r")).alias("x0"), F.min(c("y") - c("r")).alias("y0"), F.max(c("x") + c("r")).alias("x1"), F.max(c("y") + c("r")).alias("y1"),
    )
    return p.withColumn("question", review_question(c("primary"), F.lit(None).cast("bigint")))


def accept_plan(pending: DataFrame, marks: DataFrame) -> DataFrame:
    """Outcome per suggestion of "accept all OK": accepted / duplicate / negative (REV8).

    Candidates already under a mark or overlapping a better candidate are duplicates;
    rejected suggestions outside review regions become the run's negatives.
    """
    ok = pending.where("state = 'ok'").select("image_id", "suggestion_id", "x", "y", "r", "score", "cluster_id", "status")
    free = spatial.uncovered(ok, marks, IMG, "suggestion_id")
    kept = matching.near_duplicates(free, IMG, "suggestion_id").where("kept").select("image_id", "suggestion_id", F.lit("accepted").alias("outcome"))
    dup = ok.join(kept, ["image_id", "suggestion_id"], "left_anti").select("image_id", "suggestion_id", F.lit("duplicate").alias("outcome"))
    neg = pending.where("state = 'rejected' and not in_review").select("image_id", "suggestion_id", F.lit("negative").alias("outcome"))
    return kept.unionByName(dup).unionByName(neg)


def to_annotations(suggestions: DataFrame, group: str, run_id, method: str, version: str, at) -> DataFrame:
    """Accepted suggestions as automated, accepted marks with provenance, confidence null (REV9)."""
    new_id = F.sha2(F.concat_ws(":", run_id, c("suggestion_id").cast("string")), 256)
    return suggestions.select(
        new_id.alias("annotation_id"), "image_id", "x", "y", F.lit(group).alias("group_id"), F.lit("automated").alias("origin"), F.lit("accepted").alias("review_status"),
        F.lit("automated").alias("last_edit_source"), F.lit(False).alias("manually_adjusted"), at.alias("created_at"), F.lit(method).alias("detector_name"), F.lit(version).alias("detector_version"),
        run_id.alias("run_id"), F.lit(None).cast("double").alias("confidence"), "cluster_id", "score", "status", (F.floor(c("r") * 100 + 0.5) / 100).alias("geometry_r"),
    )


def toggle_rejections(rejected: DataFrame, toggled: DataFrame) -> DataFrame:
    """Symmetric difference: toggled ids enter or leave the rejected set (REV10). Each id toggles once per occurrence."""
    odd = toggled.groupBy("suggestion_id").agg((F.count(F.lit(1)) % 2).alias("_o")).where("_o = 1").select("suggestion_id")
    return rejected.join(odd, "suggestion_id", "left_anti").unionByName(odd.join(rejected, "suggestion_id", "left_anti"))


def reject_runs(pending_rejected: DataFrame, recorded: DataFrame) -> DataFrame:
    """Reject-only run per image: rejected, still shown, not recorded by a stored accept run (REV11)."""
    left = pending_rejected.join(recorded.select("suggestion_id"), "suggestion_id", "left_anti")
    return left.groupBy("image_id").agg(F.count(F.lit(1)).alias("negatives"))


def display_marks(pending: DataFrame, options: DataFrame, focus: DataFrame) -> DataFrame:
    """Rings to draw when the detector's choice of one region per image is focused (REV12).

    ``focus(image_id, cluster_id)``; ``options`` comes from ``compare_options`` (column ``a_id``).
    """
    f = focus.select("image_id", "cluster_id", F.lit(True).alias("_f"))
    only = options.where("part = 'only-a'").select("image_id", "cluster_id", c("a_id").alias("suggestion_id"), F.lit(True).alias("_c"))
    j = pending.join(f, ["image_id", "cluster_id"], "left").join(only, ["image_id", "cluster_id", "suggestion_id"], "left")
    inside = F.coalesce("_f", F.lit(False))
    state = F.when(~inside, c("state")).when(c("state") == "rejected", "rejected").when(c("_c"), "changed").otherwise("review")
    return j.select("image_id", "suggestion_id", "x", "y", "r", state.alias("state"))


def comparison_marks(scored: DataFrame, detected: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Overlay marks: matched, extra and missed (REV13)."""
    m = detected.join(pairs.select(*keys, "suggestion_id"), [*keys, "suggestion_id"], "left_semi").select(*keys, "x", "y", F.lit("matched").alias("kind"))
    e = detected.join(pairs.select(*keys, "suggestion_id"), [*keys, "suggestion_id"], "left_anti").select(*keys, "x", "y", F.lit("extra").alias("kind"))
    x = scored.join(pairs.select(*keys, "annotation_id"), [*keys, "annotation_id"], "left_anti").select(*keys, "x", "y", F.lit("missed").alias("kind"))
    return m.unionByName(e).unionByName(x)


def detection_requests(images: DataFrame, marks: DataFrame, references: DataFrame, group: str) -> DataFrame:
    """Points of each request: local seeds, remote seeds, existing marks with known radii (REV14).

    ``references(image_id, reference_image_id)`` names the image that lends examples.
    """
    from .counts import active, seed_marks

    act = active(images).select("image_id")
    seeds = seed_marks(marks.where(c("group_id") == group)).select("image_id", "annotation_id", "x", "y")
    local = seeds.join(act, "image_id").select("image_id", F.lit("seed").alias("role"), "annotation_id", "x", "y", F.lit(None).cast("double").alias("r"))
    ref = references.where(c("reference_image_id").isNotNull()).join(act, "image_id")
    remote = ref.join(seeds.withColumnRenamed("image_id", "reference_image_id"), "reference_image_id").select("image_id", F.lit("remote-seed").alias("role"), "annotation_id", "x", "y", F.lit(None).cast("double").alias("r"))
    known = F.when(c("origin") == "automated", c("r"))
    existing = marks.join(act, "image_id").select("image_id", F.lit("existing").alias("role"), "annotation_id", "x", "y", known.alias("r"))
    return local.unionByName(remote).unionByName(existing)
