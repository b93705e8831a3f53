"""Record constructors with their defaults (SCA29)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petrigrid.functions.style import PRESETS, preset_values
from petrigrid.operators.ordering import next_colours, unique_names

ANNOTATION = "struct<id:string,x:double,y:double,group_id:string>"


def manual_marks(points: DataFrame) -> DataFrame:
    """Manual marks from ``(id, x, y, group_id, at)``: accepted, reviewed when placed."""
    at = F.col("at")
    return points.select(
        "id", "x", "y", "group_id", F.lit("manual").alias("origin"), at.alias("created_at"), at.alias("updated_at"), F.lit("accepted").alias("review_status"),
        at.alias("reviewed_at"), F.lit("manual").alias("last_edit_source"), F.lit(False).alias("manually_adjusted"),
    )


def empty_documents(images: DataFrame) -> DataFrame:
    empty = lambda t: F.array().cast(f"array<{t}>")
    return images.select(
        F.lit(1).alias("schema_version"), "project_id", "image_id", F.col("fingerprint").alias("image_fingerprint"), "width", "height",
        empty("string").alias("groups"), empty(ANNOTATION).alias("annotations"), empty("string").alias("detection_runs"),
    )


def new_groups(projects: DataFrame, existing: DataFrame) -> DataFrame:
    """One new annotation group per project: a free name, the next colour, default style."""
    n = existing.groupBy("project_id").agg(F.count(F.lit(1)).alias("_n"))
    wanted = projects.select("project_id").join(n, "project_id", "left").select("project_id", F.when(F.col("_n") > 0, "Group").otherwise("Colonies").alias("base"))
    named = unique_names(wanted, existing.select("project_id", F.col("group_name").alias("name")), ["project_id"])
    colours = next_colours(existing.select("project_id", F.col("color").alias("colour")), ["project_id"])
    return named.join(colours, "project_id", "left").select(
        "project_id", F.col("name").alias("group_name"), F.coalesce("colour", F.lit("#d55e00")).alias("color"), F.lit("dot").alias("render"), F.lit(0.9).alias("opacity"),
        F.lit(6.0).alias("size"), F.lit(False).alias("labels"), F.lit(12).alias("label_size"), F.lit(False).alias("hidden"), F.lit(False).alias("locked"),
    )


def apply_preset(images: DataFrame, preset: str) -> DataFrame:
    """Every display column becomes the preset's, except sampled centre colours."""
    if preset not in PRESETS:
        raise ValueError(f"unknown preset {preset}")
    return images.withColumns(preset_values(preset))


def effective_rim(picked: str = "picked_rim", estimated: str = "rim"):
    return F.coalesce(F.col(picked), F.col(estimated))
