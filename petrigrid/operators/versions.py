"""Version history: retention, quota relief, parts, restore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US
# Retention policy.
KEEP_ALL, HOURLY_UNTIL, DAILY_UNTIL, MAX_VERSIONS, KEEP_NEWEST, PROTECT_SAFETY = DAY_US, 7 * DAY_US, 30 * DAY_US, 200, 3, 7 * DAY_US


def micros(c: Column) -> Column:
    """Epoch microseconds of a UTC timestamp."""
    return F.unix_micros(c.cast("timestamp"))


def is_safety(reason: Column) -> Column:
    return reason.isin("before-destructive", "before-restore")


def _facts(versions: DataFrame, now: Column) -> DataFrame:
    us = micros(F.col("created_at"))
    return versions.select("project_id", "version_id", "created_at", "reason", us.alias("us"), (now - us).alias("age"))


def _newest(facts: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` per project: a limited rank, so it stays partial before the shuffle."""
    w = W.partitionBy("project_id").orderBy(F.col("us").desc(), F.col("version_id"))
    return facts.select("project_id", "version_id", "us").withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= n).select("project_id", "version_id")


def _latest_safety(facts: DataFrame) -> DataFrame:
    # newest first; equal times keep list order (smaller id)
    s = facts.where(is_safety(F.col("reason")) & (F.col("age") < PROTECT_SAFETY))
    return s.groupBy("project_id").agg(F.max(F.struct("us", (-F.col("version_id")).alias("v"))).alias("m")).select("project_id", (-F.col("m.v")).alias("version_id"))


def retention_plan(versions: DataFrame, now: Column, max_versions: int = MAX_VERSIONS) -> DataFrame:
    """keep / drop per version (VER2).

    Buckets are clock hours and days; the winner of a bucket is a maximum over
    (rank, time), so a bucket of any size combines map-side. Only the cap needs an
    order; it looks at kept versions alone, which buckets bound per project except
    for the last day.
    """
    facts = _facts(versions, now)
    rank = F.when(is_safety(F.col("reason")), 2).when(F.col("reason") == "manual", 1).otherwise(0)
    age = F.col("age")
    bucket = (
        F.when(age < KEEP_ALL, F.concat(F.lit("v"), F.col("version_id").cast("string")))
        .when(age < HOURLY_UNTIL, F.concat(F.lit("h"), F.floor(F.col("us") / HOUR_US).cast("string")))
        .when(age < DAILY_UNTIL, F.concat(F.lit("d"), F.floor(F.col("us") / DAY_US).cast("string")))
    )
    best = (
        facts.withColumn("bucket", bucket).where(F.col("bucket").isNotNull()).groupBy("project_id", "bucket")
        .agg(F.max(F.struct(rank.alias("rk"), "us", (-F.col("version_id")).alias("v"))).alias("m"))
        .select("project_id", (-F.col("m.v")).alias("version_id"))
    )
    shield = _newest(facts, KEEP_NEWEST).unionByName(_latest_safety(facts)).distinct().withColumn("shield", F.lit(True))
    kept = best.unionByName(shield.drop("shield")).distinct()
    f = kept.join(facts.select("project_id", "version_id", "us"), ["project_id", "version_id"]).join(shield, ["project_id", "version_id"], "left")
    total = f.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
    # surplus = the oldest unprotected beyond the cap: a bounded rank from the old end
    over = total.where(F.col("n") > max_versions).withColumn("surplus", F.col("n") - max_versions)
    from petrigrid.plans.ranks import ordered_rank

    loose = f.where(F.col("shield").isNull()).join(over, "project_id")
    aged = ordered_rank(loose, ["project_id"], "us", "old_rank", ties=[F.col("version_id").desc()], chunk=F.floor(F.col("us") / (60_000_000)))
    dropped = aged.where(F.col("old_rank") <= F.col("surplus")).select("project_id", "version_id")
    final = f.select("project_id", "version_id").join(dropped, ["project_id", "version_id"], "left_anti").withColumn("_k", F.lit(True))
    return versions.select("project_id", "version_id").join(final, ["project_id", "version_id"], "left").select(
        "project_id", "version_id", F.coalesce("_k", F.lit(False)).alias("keep")
    )


def quota_relief(versions: DataFrame, now: Column) -> DataFrame:
    """Versions to delete under quota pressure: oldest automatic quarter, at least one, never protected (VER3)."""
    from petrigrid.plans.ranks import ordered_rank

    facts = _facts(versions, now)
    shield = _newest(facts, 1).unionByName(_latest_safety(facts)).distinct()
    free = facts.join(shield, ["project_id", "version_id"], "left_anti").withColumn("auto", F.col("reason").isin("periodic", "session-start"))
    # automatic ones when there are any, else all unprotected
    per = free.groupBy("project_id").agg(F.max("auto").alias("has_auto"), F.count_if("auto").alias("n_auto"), F.count(F.lit(1)).alias("n_all"))
    j = free.join(per, "project_id").where(~F.col("has_auto") | F.col("auto"))
    n = F.when(F.col("has_auto"), F.col("n_auto")).otherwise(F.col("n_all"))
    ranked = ordered_rank(j.withColumn("take", F.greatest(F.lit(1), F.ceil(n / 4))), ["project_id"], "us", "old_rank", ties=[F.col("version_id").desc()], chunk=F.floor(F.col("us") / HOUR_US))
    return ranked.where(F.col("old_rank") <= F.col("take")).select("project_id", "version_id")


def orphan_parts(parts: DataFrame, version_docs: DataFrame, deleted: DataFrame) -> DataFrame:
    """Stored parts that no remaining version refers to (VER4)."""
    remaining = version_docs.join(deleted, "version_id", "left_anti")
    return parts.join(remaining.select("part_key").distinct(), "part_key", "left_anti")


def fresh_parts(candidates: DataFrame, parts: DataFrame) -> DataFrame:
    """Content-addressed insert: only keys not stored yet, once each (SNK7)."""
    return candidates.dropDuplicates(["part_key"]).join(parts.select("part_key"), "part_key", "left_anti")


def load_status(version_docs: DataFrame, parts: DataFrame) -> DataFrame:
    """complete / incomplete per version (VER5)."""
    p = parts.select("part_key", F.lit(1).alias("_p"))
    j = version_docs.join(p, "part_key", "left")
    return j.groupBy("version_id").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("_p").isNull()).alias("missing")
    ).withColumn("complete", F.col("missing") == 0)


def unchanged_captures(captures: DataFrame) -> DataFrame:
    """Automatic captures whose document keys equal the previous version's (VER1).

    ``captures(project_id, capture_id, reason, part_key, image_id)``. The signature is a
    sum of row hashes, so a project with many documents is never collected.
    """
    h = lambda s: F.sum(F.xxhash64(F.lit(s), "image_id", "part_key").cast("decimal(38,0)"))
    sig = captures.groupBy("project_id", "capture_id", "reason").agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), h(1).cast("string"), h(2).cast("string")).alias("sig"))
    prev = sig.select("project_id", (F.col("capture_id") + 1).alias("capture_id"), F.col("sig").alias("_prev"))
    j = sig.join(prev, ["project_id", "capture_id"], "left")
    skip = F.col("reason").isin("periodic", "session-start") & F.col("_prev").eqNullSafe(F.col("sig"))
    return j.select("project_id", "capture_id", skip.alias("skipped"))


def restored_images(current: DataFrame, version: DataFrame, storage_owned: list[str], at: Column) -> DataFrame:
    """Images after a restore (VER6): the version's rows with storage columns as now; later ones soft-deleted."""
    c = current.select(F.col("image_id").alias("c_id"), *[F.col(k).alias("c_" + k) for k in current.columns if k != "image_id"])
    v = version.withColumn("_v", F.lit(True))
    j = v.join(c, v.image_id == c.c_id, "full_outer")
    in_version = F.col("_v").isNotNull()
    cols = []
    for k in version.columns:
        if k == "image_id":
            cols.append(F.coalesce("image_id", "c_id").alias(k))
        elif k == "deleted_at":
            cols.append(F.when(in_version, F.col(k)).otherwise(F.coalesce(F.col("c_deleted_at"), at)).alias(k))
        elif k in storage_owned:
            cols.append(F.when(in_version & F.col("c_id").isNull(), F.col(k)).otherwise(F.col("c_" + k)).alias(k))
        else:
            cols.append(F.when(in_version, F.col(k)).otherwise(F.col("c_" + k)).alias(k))
    return j.select(*cols, (~in_version & F.col("c_deleted_at").isNull()).alias("removed_later"))


def restored_documents(version_images: DataFrame, version_docs: DataFrame, current_docs: DataFrame) -> DataFrame:
    """Where each restored document comes from: version / emptied / current (VER6)."""
    vi = version_images.select("image_id", F.lit(True).alias("_i"))
    vd = version_docs.select("image_id", F.lit(True).alias("_v"))
    cd = current_docs.select("image_id", F.lit(True).alias("_c"))
    j = vi.join(vd, "image_id", "full_outer").join(cd, "image_id", "full_outer")
    src = F.when(F.col("_i") & F.col("_v"), "version").when(F.col("_i") & F.col("_c"), "emptied").when(F.col("_i").isNull() & F.col("_c"), "current")
    return j.select("image_id", src.alias("source")).where(F.col("source").isNotNull())


def restore_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """What a restore changes per project (VER8), from the image comparison: images whose annotations change, images
    added later that move to the removed ones, and a code for the two."""
    a = rows.groupBy(*keys).agg(F.count_if(F.col("changed") & ~F.col("added_later")).alias("images_changed"), F.count_if("added_later").alias("images_removed"))
    changes, removals = F.col("images_changed") > 0, F.col("images_removed") > 0
    return a.withColumn("effect", F.when(changes & removals, "changes+removals").when(changes, "changes").when(removals, "removals").otherwise("none"))


def day_title(day: Column, today: Column) -> Column:
    """Today / Yesterday / weekday, day, month (year when it differs)."""
    base = F.concat(F.date_format(day, "E"), F.lit(", "), F.date_format(day, "MMM d"))
    return F.when(day == today, "Today").when(day == F.date_sub(today, 1), "Yesterday").when(F.year(day) == F.year(today), base).otherwise(F.concat(base, F.lit(", "), F.year(day).cast("string")))


def versions_by_day(versions: DataFrame, today: Column, zone: str | None = None) -> DataFrame:
    at = F.col("created_at").cast("timestamp")
    local = F.from_utc_timestamp(at, zone) if zone else at
    per = versions.groupBy("project_id", F.to_date(local).alias("day")).agg(F.count(F.lit(1)).alias("versions"), F.max("created_at").alias("newest"))
    return per.select("project_id", F.col("day").cast("string").alias("day"), day_title(F.col("day"), today).alias("title"), "versions", "newest")


def delete_annotation_group(marks: DataFrame, groups: DataFrame, doomed: DataFrame) -> dict[str, DataFrame]:
    """Remove groups with their marks; locked groups and the last one are refused (VER12)."""
    n = groups.groupBy("project_id").agg(F.count(F.lit(1)).alias("_n"))
    j = doomed.join(groups, ["project_id", "group_id"]).join(n, "project_id")
    verdict = j.select("project_id", "group_id", F.when(F.col("locked"), "locked").when(F.col("_n") <= 1, "last").otherwise("deleted").alias("outcome"))
    gone = verdict.where("outcome = 'deleted'")
    return {
        "outcome": verdict,
        "groups": groups.join(gone, ["project_id", "group_id"], "left_anti"),
        "marks": marks.join(gone, ["project_id", "group_id"], "left_anti"),
    }


def delete_image_group(images: DataFrame, doomed: DataFrame) -> DataFrame:
    d = doomed.select(F.col("image_group_id"), F.lit(True).alias("_d"))
    return images.join(d, "image_group_id", "left").withColumn("image_group_id", F.when(F.col("_d").isNull(), F.col("image_group_id"))).drop("_d")


def apply_image_edits(images: DataFrame, edits: DataFrame, groups: DataFrame) -> DataFrame:
    """Soft delete, restore, assign, rename by key (VER14).

    ``edits(image_id, action, text, group_id, at)``, at most one per image; unknown
    target groups and blank names change nothing.
    """
    known = groups.select(F.col("image_group_id").alias("e_group"), F.lit(True).alias("_ok"))
    e = edits.select("image_id", "action", F.trim("text").alias("e_text"), F.col("group_id").alias("e_group"), F.col("at").alias("e_at")).join(known, "e_group", "left")
    j = images.join(e, "image_id", "left")
    act = F.coalesce("action", F.lit(""))
    return j.select(
        *[F.col(c) for c in images.columns if c not in ("image_name", "image_group_id", "deleted_at")],
        F.when((act == "rename") & (F.col("e_text") != ""), F.col("e_text")).otherwise(F.col("image_name")).alias("image_name"),
        F.when((act == "assign") & (F.col("e_group").isNull() | F.col("_ok")), F.col("e_group")).otherwise(F.col("image_group_id")).alias("image_group_id"),
        F.when(act == "restore", None).when((act == "remove") & F.col("deleted_at").isNull(), F.col("e_at")).otherwise(F.col("deleted_at")).alias("deleted_at"),
    )
