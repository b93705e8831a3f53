"""Ground truth from project tables, and its lookup for local image files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petrigrid.operators.counts import is_confirmed

c = F.col


def confirmed_points(marks: DataFrame, groups: DataFrame, group: str | None = None) -> DataFrame:
    """Confirmed marks, optionally of one group by id or name; an unknown group is an error (SRC5)."""
    points = marks.where(is_confirmed())
    if group is None:
        return points
    wanted = groups.where((c("group_id") == group) | (c("group_name") == group)).select("group_id").distinct()
    found = [r[0] for r in wanted.limit(2).collect()]
    if not found:
        raise ValueError(f'group "{group}" not found')
    return points.join(wanted, "group_id", "left_semi")


def _stem(name):
    return F.regexp_replace(name, r"\.[^.]+$", "")


def find_images(files: DataFrame, images: DataFrame) -> DataFrame:
    """Image per local file: fingerprint first, then name or name without extension, first in list order (SRC6)."""
    i = images.select("image_id", "fingerprint", "image_name", "ord")
    by_fp = files.join(i, files.sha == i.fingerprint).select("file_no", "image_id", F.lit(0).alias("p"), "ord")
    stem = i.groupBy(_stem(c("image_name")).alias("stem")).agg(F.min(F.struct("ord", "image_id")).alias("m"))
    f = files.withColumn("stem", _stem(c("file_name")))
    by_name = f.join(stem, "stem").select("file_no", c("m.image_id").alias("image_id"), F.lit(1).alias("p"), c("m.ord").alias("ord"))
    best = by_fp.unionByName(by_name).groupBy("file_no").agg(F.min(F.struct("p", "ord", "image_id")).alias("m"))
    return files.join(best, "file_no", "left").select(*files.columns, c("m.image_id").alias("image_id"))
