"""Planes and images that lack lines, as the last one does where the vectors are no multiple of 50, against SQL."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from petrigrid.catalog.fixtures import BASE
from tests.compare import ROOT, compare

NAMES = [
    "pix2_box_blur", "pix3_gaussian", "pix3_gaussian_wide", "pix4_masked_blur", "pix5_median_filter", "pix5_gradients", "pix6_resize_area", "pix9_adaptive_threshold",
    "pix12_distance", "pix16_log_response", "pix20_rendered_grey", "pix23_bilinear", "pix24_contrast_plane", "pix26_rim_width", "src3_image_intake", "src4_pixel_source", "src4_oriented_tiles",
]


@pytest.fixture(scope="module")
def short(spark, tmp_path_factory):
    """Two whole planes, and others of 6, 32 and 1 lines."""
    d = tmp_path_factory.mktemp("short")
    for t in BASE:
        if t != "embeddings":
            (d / f"{t}.parquet").symlink_to(Path(ROOT) / "sf0.001" / f"{t}.parquet")
    v = spark.read.parquet(f"{ROOT}/sf0.001/embeddings.parquet")
    v.where("vec_id < 106 or vec_id between 150 and 181 or vec_id = 200").coalesce(1).write.parquet(str(d / "part"))
    next((d / "part").glob("*.parquet")).rename(d / "embeddings.parquet")  # DuckDB reads one file of that name
    return str(d)


@pytest.mark.parametrize("name", NAMES)
def test_short_rasters_equal_sql(spark, short, name):
    _, status, _, _, note = compare(spark, name, entry.queries()[name], entry.oracle_sql()[name], short)
    assert status == "ok", note
