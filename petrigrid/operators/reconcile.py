"""Lookups, full-outer comparisons and folder reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .counts import MIN_SEEDS, active, edit_block, is_confirmed, seed_counts


def resolve_groups(marks: DataFrame, groups: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Group name per mark: project first, then the document snapshot (JON13)."""
    g = groups.select("group_id", F.col("group_name").alias("_g"))
    s = snapshots.select("image_id", "group_id", F.col("group_name").alias("_s"))
    j = marks.join(g, "group_id", "left").join(s, ["image_id", "group_id"], "left")
    return j.withColumn("group_name", F.coalesce("_g", "_s", F.lit("(unknown group)"))).drop("_g", "_s")


def find_block(images: DataFrame, groups: DataFrame, marks: DataFrame) -> DataFrame:
    """Why a similarity search cannot run, per image and group of its project (FIL8); null = it can.

    Order: no-group > locked > hidden > source-mismatch > size-mismatch > no-seeds. An image of a project
    without groups has one row without a group. Examples come from images of the same project only.
    """
    seeds = seed_counts(marks)
    ok = seeds.join(images.where(F.col("deleted_at").isNull() & ~F.col("source_mismatch")).select("image_id", "project_id"), "image_id").where(F.col("seeds") >= MIN_SEEDS)
    refs = ok.groupBy("project_id", "group_id").agg(F.count(F.lit(1)).alias("refs"))
    own = ok.select("image_id", "group_id", F.lit(1).alias("own"))
    grid = images.join(groups.select("project_id", "group_id", "locked", "hidden"), "project_id", "left")
    j = grid.join(seeds, ["image_id", "group_id"], "left").join(refs, ["project_id", "group_id"], "left").join(own, ["image_id", "group_id"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    block = edit_block(F.col("group_id").isNotNull(), F.col("locked"), F.col("hidden"))
    block = (
        F.when(block.isNotNull(), block)
        .when(F.col("source_mismatch"), "source-mismatch")
        .when(F.col("size_mismatch"), "size-mismatch")
        .when((zero("seeds") == 0) & (zero("refs") - zero("own") == 0), "no-seeds")
    )
    return j.select("image_id", "group_id", block.alias("block"))


def reference_candidates(images: DataFrame, marks: DataFrame) -> DataFrame:
    """Images that can lend examples, per project and group: at least three seeds, unchanged, not removed (JON22).

    The list "for another image" is this list without that image, so no image pairs are formed.
    """
    usable = images.where(F.col("deleted_at").isNull() & ~F.col("source_mismatch")).select("project_id", "image_id", "image_name")
    return seed_counts(marks).where(F.col("seeds") >= MIN_SEEDS).join(usable, "image_id")


def default_seed_source(images: DataFrame, groups: DataFrame, marks: DataFrame) -> DataFrame:
    """Per image and group: this image when it has enough seeds, else the best other image of its project, if any.

    The best two candidates per project and group settle every image: the best one that is not itself. Both are
    map-side-combined extremes, the second over what is left without the first.
    """
    key = ["project_id", "group_id"]
    cand = reference_candidates(images, marks).select(*key, F.struct((-F.col("seeds")).alias("s"), "image_name", "image_id").alias("c"))
    first = cand.groupBy(*key).agg(F.min("c").alias("c1"))
    second = cand.join(first, key).where("c <> c1").groupBy(*key).agg(F.min("c").alias("c2"))
    best = first.join(second, key, "left").select(*key, F.col("c1.image_id").alias("b1"), F.col("c2.image_id").alias("b2"))
    grid = active(images).join(groups.select(*key), "project_id").select("project_id", "image_id", "group_id")
    j = grid.join(seed_counts(marks), ["image_id", "group_id"], "left").join(best, key, "left")
    other = F.when(F.col("b1") == F.col("image_id"), F.col("b2")).otherwise(F.col("b1"))
    local = (F.coalesce("seeds", F.lit(0)) >= MIN_SEEDS) | other.isNull()
    return j.select("image_id", "group_id", F.when(local, F.lit(None)).otherwise(other).alias("reference_image_id"))


def diff_ops(before: DataFrame, after: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Ops that turn ``before`` into ``after`` (JON14): a changed origin is remove + add."""
    b = before.select(*keys, F.col("origin").alias("_bo"), F.struct(*payload).alias("before"))
    a = after.select(*keys, F.col("origin").alias("_ao"), F.struct(*payload).alias("after"))
    j = b.join(a, keys, "full_outer")
    add, rem, upd = F.array(F.lit("add")), F.array(F.lit("remove")), F.array(F.lit("update"))
    kinds = (
        F.when(F.col("after").isNull(), rem)
        .when(F.col("before").isNull(), add)
        .when(F.col("_bo") != F.col("_ao"), F.array(F.lit("remove"), F.lit("add")))
        .when(~F.col("before").eqNullSafe(F.col("after")), upd)
    )
    e = j.select(*keys, "before", "after", F.explode(kinds).alias("kind"))
    return e.select(
        *keys, "kind",
        F.when(F.col("kind") != "add", F.col("before")).alias("before"),
        F.when(F.col("kind") != "remove", F.col("after")).alias("after"),
    )


def compare_groups(version_groups: DataFrame, now_groups: DataFrame, version_counts: DataFrame, now_counts: DataFrame) -> DataFrame:
    """Counts per project and group then and now: both / version-only / now-only (JON15)."""
    key = ["project_id", "group_id"]
    v = version_groups.select(*key, F.lit(True).alias("_v")).join(version_counts.select(*key, F.col("confirmed").alias("cv")), key, "left")
    j = v.join(now_groups.select(*key, F.lit(True).alias("_n")), key, "full_outer").join(now_counts.select(*key, F.col("confirmed").alias("cn")), key, "left")
    status = F.when(F.col("_v").isNull(), "now-only").when(F.col("_n").isNull(), "version-only").otherwise("both")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return j.select(*key, F.when(F.col("_v").isNull(), F.lit(0)).otherwise(zero("cv")).cast("bigint").alias("version"), zero("cn").alias("now"), status.alias("status"))


def list_signature(marks: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Order-aware content signature per list without collecting it.

    Each row hashes its position and payload; the per-list sums and the count are
    equal exactly when the lists are equal (two independent 64-bit hashes).
    """
    cols = [F.col("ord"), *[F.col(p) for p in payload]]
    h1, h2 = F.xxhash64(*cols), F.xxhash64(F.lit(7919), *cols)
    wide = lambda h: F.sum(h.cast("decimal(38,0)"))  # noqa: E731 - cannot overflow, order-independent
    return marks.groupBy(*keys).agg(
        F.concat_ws(":", F.count(F.lit(1)).cast("string"), wide(h1).cast("string"), wide(h2).cast("string")).alias("signature"),
        F.count_if(is_confirmed()).alias("confirmed"),
    )


def compare_images(version_images: DataFrame, version_marks: DataFrame, now_images: DataFrame, now_marks: DataFrame, payload: list[str]) -> DataFrame:
    """Version against now per image (JON16): counts, changed, added later.

    Rows: active images now, plus images of the version that are removed now.
    """
    v = version_images.select("image_id", F.col("deleted_at").isNull().alias("va"))
    n = now_images.select("image_id", F.col("deleted_at").isNull().alias("na"))
    sv = list_signature(version_marks, ["image_id"], payload).select("image_id", F.col("signature").alias("sv"), F.col("confirmed").alias("cv"))
    sn = list_signature(now_marks, ["image_id"], payload).select("image_id", F.col("signature").alias("sn"), F.col("confirmed").alias("cn"))
    j = n.join(v, "image_id", "full_outer").join(sv, "image_id", "left").join(sn, "image_id", "left")
    act, ver = F.coalesce("na", F.lit(False)), F.coalesce("va", F.lit(False))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return j.where(act | ver).select(
        "image_id",
        F.when(ver, zero("cv")).otherwise(0).cast("bigint").alias("version"),
        F.when(act, zero("cn")).otherwise(0).cast("bigint").alias("now"),
        F.col("va").isNull().alias("added_later"),
        (~F.coalesce("sv", F.lit("")).eqNullSafe(F.coalesce("sn", F.lit("")))).alias("changed"),
    )


def apply_storage_owned(editor: DataFrame, stored: DataFrame, owned: list[str], key: str = "image_id") -> DataFrame:
    """Storage-owned columns from ``stored`` where the row exists there, everything else from ``editor`` (JON17)."""
    s = stored.select(key, F.lit(True).alias("_s"), *[F.col(c).alias("_" + c) for c in owned])
    j = editor.join(s, key, "left")
    return j.select(*[F.when(F.col("_s"), F.col("_" + c)).otherwise(F.col(c)).alias(c) if c in owned else F.col(c) for c in editor.columns])


def reconcile_documents(local: DataFrame, remote: DataFrame, seen: DataFrame) -> DataFrame:
    """Folder plan per local document: skip / create / update / conflict (JON18).

    ``local(image_id, sha, dirty)``, ``remote(image_id, file_id, md5)`` is the listing,
    ``seen(image_id, file_id, md5)`` the last-read tokens (null md5 = never read).
    """
    s = seen.select("image_id", F.col("file_id").alias("s_id"), F.col("md5").alias("s_md5"), F.lit(True).alias("_s"))
    by_id = remote.select(F.col("file_id").alias("s_id"), F.col("md5").alias("k_md5"), F.lit(True).alias("_k"))
    by_name = remote.select("image_id", F.col("file_id").alias("n_id"), F.col("md5").alias("n_md5"), F.lit(True).alias("_n"))
    j = local.join(s, "image_id", "left").join(by_id, "s_id", "left").join(by_name, "image_id", "left")
    known = F.coalesce("_k", F.lit(False))
    never = F.coalesce("_s", F.lit(False)) & F.col("s_md5").isNull()
    action = (
        F.when(~F.col("dirty") & (known | never), "skip")
        .when(known & ~F.col("k_md5").eqNullSafe(F.col("s_md5")), "conflict")
        .when(known, "update")
        .when(never, "conflict")
        .when(F.col("_n") & (F.col("n_md5") != F.col("sha")), "conflict")
        .when(F.col("_n"), "update")
        .otherwise("create")
    )
    target = F.when(known | never, F.col("s_id")).otherwise(F.col("n_id"))
    return j.select("image_id", action.alias("action"), F.when(action.isin("update", "conflict"), target).alias("target"))


def replaced_images(images: DataFrame, listing: DataFrame) -> DataFrame:
    """Images whose remote bytes changed since import and are not flagged for them yet (JON19).

    ``images(image_id, file_id, md5, flagged_md5)``.
    """
    r = listing.select("file_id", F.col("md5").alias("remote_md5"))
    j = images.join(r, "file_id")
    hit = F.col("md5").isNotNull() & F.col("remote_md5").isNotNull() & (F.col("md5") != F.col("remote_md5")) & ~F.col("flagged_md5").eqNullSafe(F.col("remote_md5"))
    return j.where(hit).select("image_id", "remote_md5")


def unreferenced(listing: DataFrame, references: DataFrame) -> DataFrame:
    """Files nobody refers to, and references without a readable file (JON20)."""
    a = listing.join(references.select("file_id"), "file_id", "left_anti").select(F.lit("unreferenced").alias("kind"), "file_id")
    b = references.select("file_id").join(listing, "file_id", "left_anti").distinct().select(F.lit("inaccessible").alias("kind"), "file_id")
    return a.unionByName(b)


def import_dedupe(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Outcome per incoming file: added / already / removed / repeated in the batch (JON21).

    The first occurrence per file is a minimum, not a window, so copies combine map-side.
    """
    first = incoming.groupBy("file_id").agg(F.min("pos").alias("_first"))
    k = known.select("file_id", F.lit(True).alias("_known"), F.col("deleted_at").isNotNull().alias("_removed"))
    j = incoming.join(first, "file_id").join(k, "file_id", "left")
    status = F.when(F.col("_removed"), "removed").when(F.col("_known"), "already").when(F.col("pos") > F.col("_first"), "repeated").otherwise("added")
    return j.select("pos", "file_id", status.alias("status"))


def import_under_new_id(incoming: DataFrame, existing: DataFrame, new_id: Column) -> DataFrame:
    """Projects whose id is taken get a new id and a marked name (SRC8)."""
    e = existing.select("project_id", F.lit(True).alias("_e")).distinct()
    j = incoming.join(e, "project_id", "left")
    taken = F.coalesce("_e", F.lit(False))
    return j.select(
        F.col("project_id").alias("old_id"),
        F.when(taken, new_id).otherwise(F.col("project_id")).alias("project_id"),
        F.when(taken, F.concat("project_name", F.lit(" (imported)"))).otherwise(F.col("project_name")).alias("project_name"),
        taken.alias("rekeyed"),
    )


def folder_open_action(exists: Column, same_folder: Column, dirty: Column) -> Column:
    """Opening a folder whose project exists locally: keep unsaved work, re-key a different copy, else replace."""
    return F.when(~exists, "new").when(same_folder & dirty, "keep-local").when(~same_folder, "re-key").otherwise("replace")


def stale_comparisons(comparisons: DataFrame, regions: DataFrame, marks: DataFrame, scored: DataFrame, inside: DataFrame) -> DataFrame:
    """Comparisons whose region or scored marks changed since the run (JON27).

    ``comparisons(comparison_id, image_id, group_id, region_key, n_scored, n_seeds)``,
    ``regions(image_id, region_key)`` now, ``scored(comparison_id, annotation_id, x, y)``,
    ``inside(comparison_id, n)`` manual marks of the group inside the region now.
    """
    m = marks.select("annotation_id", F.col("x").alias("mx"), F.col("y").alias("my"))
    s = scored.join(m, "annotation_id", "left")
    moved = s.where(~(F.col("x").eqNullSafe(F.col("mx")) & F.col("y").eqNullSafe(F.col("my")))).select("comparison_id").distinct().withColumn("moved", F.lit(True))
    r = regions.select("image_id", F.col("region_key").alias("now_key"))
    j = comparisons.join(r, "image_id", "left").join(moved, "comparison_id", "left").join(inside.select("comparison_id", F.col("n").alias("n_now")), "comparison_id", "left")
    stale = ~F.col("region_key").eqNullSafe(F.col("now_key")) | F.coalesce("moved", F.lit(False)) | (F.coalesce("n_now", F.lit(0)) != F.col("n_scored") + F.col("n_seeds"))
    return j.select("comparison_id", stale.alias("stale"))


def edited_since(dirty: DataFrame, edits_then: DataFrame, edits_now: DataFrame, key: str = "image_id") -> DataFrame:
    """Dirty keys that stay dirty after a push: edited again since the snapshot (VER11)."""
    then = edits_then.groupBy(key).agg(F.max("seq").alias("s0"))
    now = edits_now.groupBy(key).agg(F.max("seq").alias("s1"))
    j = dirty.join(then, key, "left").join(now, key, "left")
    return j.where(~F.col("s0").eqNullSafe(F.col("s1"))).select(dirty.columns)
