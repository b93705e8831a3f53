"""Counts derived from annotation records, filters and edit policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petrigrid.plans.ranks import ordered_rank

MAX_SEEDS = 40
MIN_SEEDS = 3


def is_confirmed(status: str = "review_status") -> Column:
    """Accepted is the one definition of confirmed; hidden and locked groups still count."""
    return F.col(status) == "accepted"


def manual() -> Column:
    return F.col("origin") == "manual"


def active(images: DataFrame) -> DataFrame:
    return images.where(F.col("deleted_at").isNull())


def removed(images: DataFrame) -> DataFrame:
    """Removed images, most recently removed first (ties keep import order)."""
    return images.where(F.col("deleted_at").isNotNull()).orderBy(F.col("deleted_at").desc(), "ord")


def with_known_group(images: DataFrame, groups: DataFrame) -> DataFrame:
    """``effective_group``: the image group if the project knows it, null otherwise (dangling = ungrouped)."""
    g = groups.select(F.col("image_group_id").alias("effective_group"), F.col("group_ord"))
    return images.join(g, images.image_group_id == g.effective_group, "left")


def images_in_group(images: DataFrame, groups: DataFrame, group: int | None) -> DataFrame:
    j = with_known_group(active(images), groups)
    return j.where(F.col("effective_group").isNull() if group is None else F.col("effective_group") == group)


def edit_block(exists: Column, locked: Column, hidden: Column) -> Column:
    return F.when(~exists, "no-group").when(locked, "locked").when(hidden, "hidden")


def with_edit_block(df: DataFrame, groups: DataFrame) -> DataFrame:
    """Edit policy per row after a lookup of its group (FIL4)."""
    g = groups.select("group_id", F.lit(True).alias("_known"), "locked", "hidden")
    j = df.join(g, "group_id", "left")
    return j.withColumn("block", edit_block(F.coalesce("_known", F.lit(False)), F.col("locked"), F.col("hidden"))).drop("_known", "locked", "hidden")


def check_batches(ops: DataFrame, groups: DataFrame) -> DataFrame:
    """Why a batch of ops may not be applied: invalid > locked > hidden > missing, null = allowed (FIL5).

    ``ops(batch_id, kind, before_id, after_id, before_origin, after_origin, before_group, after_group)``.
    The worst reason per batch is a minimum, so batches combine map-side.
    """
    upd = F.col("kind") == "update"
    invalid = upd & ((F.col("before_id") != F.col("after_id")) | (F.col("before_origin") != F.col("after_origin")))
    touched = ops.select("batch_id", invalid.alias("invalid"), F.explode(F.array_distinct(F.array_compact(F.array("before_group", "after_group")))).alias("group_id"))
    j = with_edit_block(touched, groups)
    rank = F.when(F.col("invalid"), 1).when(F.col("block") == "locked", 2).when(F.col("block") == "hidden", 3).when(F.col("block") == "no-group", 4).otherwise(9)
    worst = j.groupBy("batch_id").agg(F.min(rank).alias("rank"))
    reason = F.when(F.col("rank") == 1, "invalid").when(F.col("rank") == 2, "locked").when(F.col("rank") == 3, "hidden").when(F.col("rank") == 4, "missing")
    return worst.select("batch_id", reason.alias("reason"))


def check_runs(runs: DataFrame, images: DataFrame, groups: DataFrame, new: bool = True) -> DataFrame:
    """Run record against its image and (for new runs) its target group (FIL6)."""
    i = images.select("image_id", F.col("fingerprint").alias("i_fp"), F.col("source_mismatch").alias("i_mm"))
    g = groups.select(F.col("group_id").alias("target_group_id"), F.lit(True).alias("_g"))
    j = runs.join(i, "image_id").join(g, "target_group_id", "left")
    problem = F.when(F.col("image_fingerprint") != F.col("i_fp"), "fingerprint mismatch").when(F.col("i_mm"), "bytes changed")
    if new:
        problem = problem.when(F.col("_g").isNull(), "unknown group")
    return j.select("run_id", problem.alias("problem"))


def seed_marks(marks: DataFrame, k: int = MAX_SEEDS) -> DataFrame:
    """Manual accepted marks, the most recent ``k`` per image and group (FIL7).

    A filter on ``row_number() <= k`` gets a partial group limit before the
    shuffle, so a hot image sends at most k rows per task.
    """
    from pyspark.sql.window import Window as W

    w = W.partitionBy("image_id", "group_id").orderBy(F.col("ord").desc())
    return marks.where(manual() & is_confirmed()).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def seed_counts(marks: DataFrame, k: int = MAX_SEEDS) -> DataFrame:
    """Number of usable examples per image and group, without listing them."""
    n = F.least(F.count(F.lit(1)), F.lit(k))
    return marks.where(manual() & is_confirmed()).groupBy("image_id", "group_id").agg(n.alias("seeds"))


def breakdown(marks: DataFrame, keys: list[str]) -> DataFrame:
    """confirmed / manual / automated accepted / automated unreviewed (AGG2); rejected counts nowhere."""
    auto = F.col("origin") == "automated"
    return marks.groupBy(*keys).agg(
        F.count_if(is_confirmed()).alias("confirmed"),
        F.count_if(is_confirmed() & manual()).alias("manual"),
        F.count_if(is_confirmed() & ~manual()).alias("automated_accepted"),
        F.count_if(auto & (F.col("review_status") == "unreviewed")).alias("automated_unreviewed"),
    )


def tally(marks: DataFrame, keys: list[str]) -> DataFrame:
    """Stored marks by origin, every review state (AGG3)."""
    return marks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(manual()).alias("manual"), F.count_if(~manual()).alias("automated")
    )


def visibility_split(marks: DataFrame, groups: DataFrame) -> DataFrame:
    hidden = groups.where("hidden").select("group_id", F.lit(True).alias("_h"))
    # count per (image, group) first: the lookup then joins counts, not marks
    per = marks.where(is_confirmed()).groupBy("image_id", "group_id").agg(F.count(F.lit(1)).alias("n"))
    j = per.join(hidden, "group_id", "left")
    h = F.coalesce(F.col("_h"), F.lit(False))
    return j.groupBy("image_id").agg(
        F.sum(F.when(h, 0).otherwise(F.col("n"))).alias("visible"), F.sum(F.when(h, F.col("n")).otherwise(0)).alias("hidden")
    )


def image_group_frame(images: DataFrame, groups: DataFrame, present: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """Image x group frame with zero rows, plus groups only the document knows (JON12/JON13).

    ``groups(project_id, ...)`` is a short list per project (a legend people pick
    from), so the frame is an equi-join on the project and one explode per image.
    ``present(image_id, group_id)`` are the groups with marks.
    """
    keep = [c for c in images.columns if c not in ("ord",)]
    listed = groups.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("ord", "group_id", "group_name", "hidden", "locked"))).alias("gs"))
    frame = images.join(listed, "project_id").select(*keep, F.explode("gs").alias("g")).select(*keep, "g.group_id", "g.group_name", "g.hidden", "g.locked", F.col("g.ord").alias("group_rank"))
    placed = present.join(images.select("image_id", "project_id"), "image_id")
    orphans = placed.join(groups.select("project_id", "group_id"), ["project_id", "group_id"], "left_anti").drop("project_id")
    if snapshots is not None:
        s = snapshots.select("image_id", "group_id", F.col("group_name").alias("_n"), F.col("hidden").alias("_h"), F.col("locked").alias("_l"))
        orphans = orphans.join(s, ["image_id", "group_id"], "left")
    else:
        orphans = orphans.withColumns({"_n": F.lit(None).cast("string"), "_h": F.lit(None).cast("boolean"), "_l": F.lit(None).cast("boolean")})
    extra = images.join(orphans, "image_id").select(
        *keep,
        "group_id",
        F.coalesce("_n", F.lit("(unknown group)")).alias("group_name"),
        F.coalesce("_h", F.lit(False)).alias("hidden"),
        F.coalesce("_l", F.lit(False)).alias("locked"),
        F.lit(1_000_000).alias("group_rank"),
    )
    return frame.unionByName(extra)


CSV_COLUMNS = [
    "project_id", "project_name", "image_group_id", "image_group_name", "image_id", "image_name", "drive_file_id",
    "annotation_group_id", "annotation_group_name", "confirmed_count", "manual_count", "automated_accepted_count",
    "automated_unreviewed_count", "group_hidden", "group_locked", "image_width", "image_height",
    "image_fingerprint_sha256", "annotations_updated_at",
]  # fixed format: the summary header


def summary_rows(images: DataFrame, image_groups: DataFrame, groups: DataFrame, marks: DataFrame, projects: DataFrame, documents: DataFrame) -> DataFrame:
    """The 19 summary columns, one row per active image and group, zeros included (AGG5).

    ``documents(image_id, updated_at)``. Marks shuffle once, as partial counts on
    (image, group); everything else joins those counts.
    """
    counts = breakdown(marks, ["image_id", "group_id"])
    frame = image_group_frame(active(images), groups, counts.select("image_id", "group_id"))
    g = image_groups.select("image_group_id", "image_group_name")
    p = projects.select("project_id", "project_name")
    j = (
        frame.join(counts, ["image_id", "group_id"], "left")
        .join(g, "image_group_id", "left")
        .join(p, "project_id", "left")
        .join(documents.select("image_id", F.col("updated_at").alias("_at")), "image_id", "left")
    )

    def zero(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0)).cast("bigint")

    file_id = F.col("drive_file_id") if "drive_file_id" in images.columns else F.lit("")
    return j.select(
        "project_id", "project_name",
        F.coalesce(F.col("image_group_id").cast("string"), F.lit("")).alias("image_group_id"),
        F.coalesce("image_group_name", F.lit("")).alias("image_group_name"),
        "image_id", "image_name", F.coalesce(file_id, F.lit("")).alias("drive_file_id"),
        F.col("group_id").alias("annotation_group_id"), F.col("group_name").alias("annotation_group_name"),
        zero("confirmed").alias("confirmed_count"), zero("manual").alias("manual_count"),
        zero("automated_accepted").alias("automated_accepted_count"), zero("automated_unreviewed").alias("automated_unreviewed_count"),
        F.col("hidden").alias("group_hidden"), F.col("locked").alias("group_locked"),
        F.col("width").alias("image_width"), F.col("height").alias("image_height"),
        F.col("fingerprint").alias("image_fingerprint_sha256"),
        F.coalesce(F.col("_at").cast("string"), F.lit("")).alias("annotations_updated_at"),
    )


def clear_summary(marks: DataFrame, images: DataFrame) -> DataFrame:
    """What clearing each group of a project would remove on active images (AGG8)."""
    per = tally(marks, ["image_id", "group_id"]).join(active(images).select("image_id", "project_id"), "image_id")
    return per.groupBy("project_id", "group_id").agg(
        F.sum("total").alias("total"), F.sum("manual").alias("manual"), F.sum("automated").alias("automated"), F.count(F.lit(1)).alias("images")
    )


def group_usage(marks: DataFrame, images: DataFrame) -> DataFrame:
    """Annotations and images per project and group over all documents, removed images too (AGG9)."""
    per = marks.groupBy("group_id", "image_id").agg(F.count(F.lit(1)).alias("n")).join(images.select("image_id", "project_id"), "image_id")
    return per.groupBy("project_id", "group_id").agg(F.sum("n").alias("annotations"), F.count(F.lit(1)).alias("images"))


def confirmed_by_group(marks: DataFrame, keys: list[str]) -> DataFrame:
    return marks.where(is_confirmed()).groupBy(*keys).agg(F.count(F.lit(1)).alias("confirmed"))


def confirmed_by_project(marks: DataFrame, images: DataFrame) -> DataFrame:
    """Confirmed marks per project and group; the images are joined to counts, not to marks."""
    per = confirmed_by_group(marks, ["image_id", "group_id"]).join(images.select("image_id", "project_id"), "image_id")
    return per.groupBy("project_id", "group_id").agg(F.sum("confirmed").alias("confirmed"))


def version_counts(marks: DataFrame, images: DataFrame, groups: DataFrame) -> DataFrame:
    """Per group of a project and per project in total (orphan groups included), active images only (AGG10)."""
    key = ["project_id", "group_id"]
    per = confirmed_by_project(marks, active(images))
    named = groups.select(*key, "group_name").join(per, key, "left").select(*key, "group_name", F.coalesce("confirmed", F.lit(0)).alias("confirmed"))
    sums = groups.select("project_id").distinct().join(per.groupBy("project_id").agg(F.sum("confirmed").alias("n")), "project_id", "full_outer")
    return named.unionByName(sums.select("project_id", F.lit("*").alias("group_id"), F.lit("(total)").alias("group_name"), F.coalesce("n", F.lit(0)).alias("confirmed")))


def display_order(images: DataFrame, groups: DataFrame) -> DataFrame:
    """Position of active images per project: image-group order, import order, ungrouped last (WIN1)."""
    j = with_known_group(active(images), groups)
    slot = j.withColumn("_slot", F.coalesce(F.col("group_ord"), F.lit(2_000_000_000)).cast("bigint"))
    # the chunk follows the full order: group first, then ranges of the import order
    return ordered_rank(
        slot.withColumn("_key", F.struct("_slot", "ord")), ["project_id"], "_key", "position",
        chunk=F.struct(F.col("_slot").alias("a"), F.floor(F.col("ord") / (1 << 20)).alias("b")),
    ).drop("_slot", "_key")


def label_numbers(marks: DataFrame) -> DataFrame:
    """1-based number of each mark within its image and group, list order (WIN2)."""
    return ordered_rank(marks, ["image_id", "group_id"], "ord", "label")
