"""Files in folders of folders: written by tasks, found without a pattern per file."""

import os

import __spark_entry__  # noqa: F401  (registers in order)
from petrigrid.catalog import q_sources as Q
from petrigrid.catalog.fixtures import Tables
from petrigrid.sources import project_folder as PF
from petrigrid.streaming import edits as ST

GIF = b"GIF89a\x01\x01\x02\x01"


def _nested(root, texts):
    for name, body in texts.items():
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(body)
    return str(root)


def test_archive_finds_nested_images(spark, tmp_path):
    root = _nested(tmp_path / "images", {"a/1.gif": GIF, "b/c/2.gif": GIF + b"x"})
    found = PF.archive_images(spark, root, r"/([^/.]+)\.gif$")
    assert sorted((r.image_id, r.length) for r in found.collect()) == [("1", 10), ("2", 11)]


def test_import_finds_nested_images(spark, tmp_path):
    root = _nested(tmp_path / "images", {"a/1.gif": GIF, "b/c/2.gif": b"text"})
    found = ST.run_available(ST.folder_import_stream(spark, root), "append", "imports")
    assert sorted((r.path[-5:], r.width, r.rejected) for r in found.collect()) == [("1.gif", 257, None), ("2.gif", None, "unknown-format")]


def test_documents_are_found_nested(spark, tmp_path):
    root = _nested(tmp_path / "docs", {"folder-p0/x/name-1.json": b'{"schemaVersion":1,', "folder-p1/name-2.json": b'{"schemaVersion":2}'})
    bad = PF.read_documents(spark, root, r"folder-([^/%]+)", r"name-([^/.]+)\.json")["damaged"]
    assert sorted((r.folder, r.file_image_id, r.problem) for r in bad.collect()) == [("p0", "1", "broken-json"), ("p1", "2", "newer")]


def test_files_share_folders(spark):
    """A folder per image makes as many directories as images, all to be listed and moved one by one."""
    suppliers = spark.range(500).selectExpr("id as s_suppkey", "concat('s', id) as s_name")
    t = Tables(spark, "")
    t._made["supplier"] = suppliers
    root = Q._image_folder(t).removeprefix("file:")
    folders, files = 0, []
    for _, below, names in os.walk(root):
        folders += len(below)
        files += names
    assert len(files) == 500 and folders <= 64
    assert PF.archive_images(spark, root, Q._IMAGE_ID).select("image_id").distinct().count() == 500
