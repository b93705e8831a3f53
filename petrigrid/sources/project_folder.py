"""Project folders as tables: scan, validate, explode; shared JSON and document export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from petrigrid.operators import quality as Q

from .schemas import DOCUMENT, PROJECT

c = F.col


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per JSON file below ``path``; damaged files keep their text in ``_corrupt_record``.

    Folders are listed in tasks; a pattern for many files would be resolved one by one on the driver.
    """
    raw = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(path)
    meta = raw.select(c("value"), c("_metadata.file_path").alias("path"), c("_metadata.file_modification_time").alias("modified"))
    return meta.withColumn("doc", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))


def read_projects(spark: SparkSession, path: str, folder_pattern: str) -> dict[str, DataFrame]:
    """Newest readable ``project.json`` per folder, its children, and warnings (SRC1).

    ``folder_pattern`` extracts the folder from a path (first group).
    """
    p = _read(spark, path, PROJECT).withColumn("folder", F.regexp_extract("path", folder_pattern, 1))
    newest = p.groupBy("folder").agg(F.max_by(F.struct("path", "doc"), F.struct("modified", "path")).alias("m"), F.count(F.lit(1)).alias("n"))
    d = newest.select("folder", "n", "m.path", c("m.doc").alias("doc"))
    gate = F.when(c("doc._corrupt_record").isNotNull(), "broken-json").otherwise(Q.schema_gate(c("doc.schemaVersion")))
    d = d.withColumn("problem", gate)
    ok = d.where(c("problem").isNull())
    several = d.where("n > 1").select("folder", F.format_string("project-files: %d", "n").alias("warning"))
    bad = d.where(c("problem").isNotNull()).select("folder", F.concat(F.lit("project-unreadable: "), c("problem")).alias("warning"))
    child = lambda arr, name: ok.select("folder", c("doc.id").alias("project_id"), F.posexplode(f"doc.{arr}").alias("ord", name))
    images = child("images", "i").select(
        "folder", "project_id", "ord", c("i.id").alias("image_id"), c("i.name").alias("image_name"), c("i.imageGroupId").alias("image_group_id"), c("i.width").alias("width"), c("i.height").alias("height"),
        c("i.mimeType").alias("mime"), c("i.fingerprint").alias("fingerprint"), c("i.source").alias("source"), c("i.deletedAt").alias("deleted_at"),
    )
    groups = child("annotationGroups", "g").select(
        "folder", "project_id", "ord", c("g.id").alias("group_id"), c("g.name").alias("group_name"), c("g.color").alias("color"), c("g.render").alias("render"), c("g.opacity").alias("opacity"), c("g.size").alias("size"),
        F.coalesce("g.labelSize", F.lit(12.0)).alias("label_size"), c("g.hidden").alias("hidden"), c("g.locked").alias("locked"),
    )
    image_groups = child("imageGroups", "g").select("folder", "project_id", c("ord").alias("group_ord"), c("g.id").alias("image_group_id"), c("g.name").alias("image_group_name"))
    projects = ok.select(
        "folder", c("doc.id").alias("project_id"), c("doc.name").alias("project_name"), c("doc.updatedAt").alias("updated_at"), F.coalesce("doc.storage.kind", F.lit("local")).alias("storage_kind"), F.coalesce("doc.revision", F.lit(0)).alias("revision")
    )
    return {"projects": projects, "images": images, "annotation_groups": groups, "image_groups": image_groups, "warnings": several.unionByName(bad)}


def read_documents(spark: SparkSession, path: str, folder_pattern: str, file_pattern: str) -> dict[str, DataFrame]:
    """Annotation documents of all folders: header rows, marks, and damaged files that were skipped (SRC1, VAL13)."""
    d = _read(spark, path, DOCUMENT).select("path", F.regexp_extract("path", folder_pattern, 1).alias("folder"), F.regexp_extract("path", file_pattern, 1).alias("file_image_id"), "doc")
    problem = F.when(c("doc._corrupt_record").isNotNull() | c("doc").isNull(), "broken-json").otherwise(Q.schema_gate(c("doc.schemaVersion")))
    problem = F.when(problem.isNull() & c("doc.annotations").isNull(), "annotations-absent").otherwise(problem)
    d = d.withColumn("problem", problem)
    ok = d.where(c("problem").isNull())
    head = ok.select(
        "folder", "file_image_id", c("doc.imageId").alias("image_id"), c("doc.projectId").alias("project_id"), c("doc.imageFingerprint").alias("fingerprint"), c("doc.width").alias("width"), c("doc.height").alias("height"), c("doc.updatedAt").alias("updated_at")
    )
    a = ok.select("folder", c("doc.imageId").alias("image_id"), F.posexplode("doc.annotations").alias("ord", "a"))
    marks = a.select(
        "folder", "image_id", "ord", c("a.id").alias("annotation_id"), c("a.x").alias("x"), c("a.y").alias("y"), c("a.geometry.r").alias("r"), c("a.groupId").alias("group_id"), c("a.origin").alias("origin"), c("a.reviewStatus").alias("review_status_raw"), c("a.updatedAt").alias("updated_at")
    )
    damaged = d.where(c("problem").isNotNull()).select("folder", "file_image_id", "problem")
    return {"documents": head, "marks": Q.normalise_marks(marks), "damaged": damaged}


def archive_images(spark: SparkSession, path: str, id_pattern: str = r"images/([^/.]+)\.[^/]+$") -> DataFrame:
    """Image files by id in the unpacked layout below ``path``, with their content hash (SRC2).

    Folders are listed in tasks; a pattern for many folders would be resolved one by one on the driver.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return f.select(F.regexp_extract("path", id_pattern, 1).alias("image_id"), "path", "length", F.sha2("content", 256).alias("sha256")).where("image_id <> ''")


def archive_warnings(images: DataFrame, files: DataFrame, documents: DataFrame) -> DataFrame:
    """Missing image files, fingerprints that differ, stray documents (SRC2, VAL12)."""
    j = images.join(files.select("image_id", "sha256"), "image_id", "left")
    gone = j.where(c("sha256").isNull() & (c("source.kind") == "local")).select(F.concat(F.lit("image-file-missing: "), c("image_name")).alias("warning"))
    diff = j.where(c("sha256") != c("fingerprint")).select(F.concat(F.lit("fingerprint-differs: "), c("image_name")).alias("warning"))
    stray = documents.select(c("file_image_id").alias("image_id")).join(images.select("image_id"), "image_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    return gone.unionByName(diff).unionByName(stray.select(F.format_string("stray-documents: %d", "n").alias("warning")))


def seeds_of(entries: DataFrame) -> DataFrame:
    """Seed file entries ``(name, seeds array, seeds_from)`` resolved over one hop (SRC7)."""
    own = entries.where(c("seeds").isNotNull()).select("name", c("name").alias("source_name"), F.posexplode("seeds").alias("ord", "p"))
    lend = entries.select(c("name").alias("seeds_from"), c("seeds").alias("_s")).where(c("_s").isNotNull())
    borrowed = entries.where(c("seeds").isNull()).join(lend, "seeds_from").select("name", c("seeds_from").alias("source_name"), F.posexplode("_s").alias("ord", "p"))
    return own.unionByName(borrowed).select("name", "source_name", "ord", c("p.x").alias("x"), c("p.y").alias("y"))


def shared_project(doc: Column) -> Column:
    """Project document for shared locations: without the signed-in account (SNK3)."""
    return doc.withField("storage", doc["storage"].dropFields("account"))


def project_documents(projects: DataFrame, images: DataFrame, groups: DataFrame, image_groups: DataFrame) -> DataFrame:
    """One project document per project; child lists are a project's own images, groups and the image groups its images are in."""
    im = images.groupBy("project_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "ord", c("image_id").cast("string").alias("id"), c("image_name").alias("name"), c("image_group_id").cast("string").alias("imageGroupId"), "width", "height", F.lit("image/jpeg").alias("mimeType"), F.lit(0).alias("byteSize"), "fingerprint",
                    F.struct(F.lit("local").alias("kind")).alias("source"), F.lit("2024-01-01T00:00:00Z").alias("addedAt"), c("deleted_at").cast("string").alias("deletedAt"),
                )
            )
        ).alias("images")
    )
    gr = groups.groupBy("project_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct("ord", c("group_id").alias("id"), c("group_name").alias("name"), F.lit("#d55e00").alias("color"), F.lit("dot").alias("render"), F.lit(0.9).alias("opacity"), F.lit(6.0).alias("size"), F.lit(False).alias("labels"), "hidden", "locked")
            )
        ).alias("groups")
    )
    used = images.where(c("image_group_id").isNotNull()).select("project_id", "image_group_id").distinct()
    ig = used.join(image_groups, "image_group_id").groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("group_ord", c("image_group_id").cast("string").alias("id"), c("image_group_name").alias("name")))).alias("ig"))
    drop = lambda arr, n: F.transform(arr, lambda s: s.dropFields(n))
    j = projects.join(im, "project_id", "left").join(gr, "project_id", "left").join(ig, "project_id", "left")
    storage = F.struct(c("storage_kind").alias("kind"), F.lit("folder").alias("folderId"), F.lit("Folder").alias("folderName"), F.lit("someone@example.org").alias("account"))
    doc = F.struct(
        F.lit(1).alias("schemaVersion"), c("project_id").alias("id"), c("project_name").alias("name"), F.lit("2024-01-01T00:00:00Z").alias("createdAt"), F.lit("2024-01-02T00:00:00Z").alias("updatedAt"),
        drop(c("ig"), "group_ord").alias("imageGroups"), drop(c("images"), "ord").alias("images"), drop(c("groups"), "ord").alias("annotationGroups"), storage.alias("storage"), c("revision").alias("revision"),
    )
    return j.select("project_id", doc.alias("doc"))


def export_documents(images: DataFrame, marks: DataFrame, groups: DataFrame) -> DataFrame:
    """Annotation document per image with the project's current groups (SNK4).

    A document holds the marks of one image in list order: the unit of the format.
    """
    a = marks.groupBy("image_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "ord", c("annotation_id").cast("string").alias("id"), "x", "y", c("group_id").alias("groupId"), "origin", c("updated_at").cast("string").alias("createdAt"), c("updated_at").cast("string").alias("updatedAt"), c("review_status").alias("reviewStatus"),
                    F.lit("manual").alias("lastEditSource"), F.lit(False).alias("manuallyAdjusted"), F.struct(F.lit("circle").alias("kind"), c("r").alias("r"), F.lit("fit").alias("source")).alias("geometry"),
                )
            )
        ).alias("a"),
        F.max("updated_at").cast("string").alias("at"),
    )
    g = groups.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("ord", c("group_id").alias("id"), c("group_name").alias("name"), "hidden", "locked"))).alias("g"))
    j = images.join(a, "image_id").join(g, "project_id")
    doc = F.struct(
        F.lit(1).alias("schemaVersion"), c("project_id").alias("projectId"), c("image_id").cast("string").alias("imageId"), c("fingerprint").alias("imageFingerprint"), "width", "height",
        F.transform("g", lambda s: s.dropFields("ord")).alias("groups"), F.transform("a", lambda s: s.dropFields("ord")).alias("annotations"), F.array().cast("array<string>").alias("detectionRuns"), c("at").alias("updatedAt"),
    )
    return j.select("project_id", "image_id", F.to_json(doc).alias("value"))


def push_steps(plan: DataFrame, project_conflict: Column) -> DataFrame:
    """Writes of one push in order: documents, summary, project marker last; nothing on conflict (VER9)."""
    stop = plan.groupBy("project_id").agg(F.max((c("action") == "conflict") | project_conflict).alias("blocked"))
    docs = plan.where("action in ('create', 'update')").select("project_id", F.lit(1).alias("step"), F.concat(F.lit("annotations/"), c("image_id").cast("string"), F.lit(".json")).alias("file"), "action", "target")
    tail = stop.select("project_id", F.explode(F.array(F.struct(F.lit(2).alias("step"), F.lit("summary.csv").alias("file")), F.struct(F.lit(3).alias("step"), F.lit("project.json").alias("file")))).alias("t"))
    tail = tail.select("project_id", "t.step", "t.file", F.lit("update").alias("action"), F.lit(None).cast("bigint").alias("target"))
    return docs.unionByName(tail).join(stop.where("not blocked").select("project_id"), "project_id", "left_semi")


def take_remote(local: DataFrame, remote: DataFrame, project: str, backup_id: str, stamp: str) -> DataFrame:
    """Keep the local rows under a backup id and replace them by the remote rows (VER10)."""
    mine = local.where(c("project_id") == project)
    backup = mine.withColumn("project_id", F.lit(backup_id))
    if "project_name" in local.columns:
        backup = backup.withColumn("project_name", F.concat("project_name", F.lit(f" (local copy {stamp})")))
    rest = local.where(c("project_id") != project)
    return rest.unionByName(backup).unionByName(remote.withColumn("project_id", F.lit(project)))
