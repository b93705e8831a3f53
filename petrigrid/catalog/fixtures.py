"""Views that derive the plate data model from the driver tables.

Each view has one text, or a Spark and a DuckDB text where the dialects differ.
Spark builds them lazily from Parquet; the oracle inlines them as CTEs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petrigrid.session import tune

BASE = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def _both(text: str) -> tuple[str, str]:
    return text, text


VIEWS: dict[str, tuple[str, str]] = {
    "images": (
        """SELECT s_suppkey AS image_id, s_name AS image_name, 'p' || CAST(s_nationkey % 5 AS STRING) AS project_id,
           CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_nationkey END AS image_group_id, 4000 AS width, 3000 AS height,
           sha2(s_name, 256) AS fingerprint,
           CASE WHEN s_suppkey % 10 = 9 THEN TIMESTAMP_NTZ '2024-01-15 00:00:00' END AS deleted_at, s_suppkey AS ord FROM supplier""",
        """SELECT s_suppkey AS image_id, s_name AS image_name, 'p' || CAST(s_nationkey % 5 AS VARCHAR) AS project_id,
           CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_nationkey END AS image_group_id, 4000 AS width, 3000 AS height,
           sha256(s_name) AS fingerprint,
           CASE WHEN s_suppkey % 10 = 9 THEN TIMESTAMP '2024-01-15 00:00:00' END AS deleted_at, s_suppkey AS ord FROM supplier""",
    ),
    "image_groups": _both(
        "SELECT n_nationkey AS image_group_id, n_name AS image_group_name, n_nationkey AS group_ord FROM nation WHERE n_nationkey < 20"
    ),
    "annotation_groups": _both(
        """SELECT * FROM (VALUES ('F','Main colonies',FALSE,FALSE,0),('O','Small colonies',TRUE,FALSE,1),
           ('Z','=Empty group',FALSE,TRUE,2)) AS t(group_id,group_name,hidden,locked,ord)"""
    ),
    "annotations": _both(
        """SELECT o_orderkey AS annotation_id, o_custkey % (SELECT count(*) FROM supplier) AS image_id,
           CAST((o_orderkey * 7919 + o_custkey * 104729) % 4000 AS DOUBLE) + CAST(0.5 AS DOUBLE) AS x,
           CAST((o_orderkey * 48611 + 17) % 3000 AS DOUBLE) + CAST(0.5 AS DOUBLE) AS y,
           CAST(8 + o_orderkey % 17 AS DOUBLE) AS r, o_orderstatus AS group_id,
           CASE WHEN o_orderkey % 3 = 0 THEN 'manual' ELSE 'automated' END AS origin,
           CASE WHEN o_orderkey % 5 < 3 THEN 'accepted' WHEN o_orderkey % 5 = 3 THEN 'unreviewed' ELSE 'rejected' END AS review_status_raw,
           o_orderdate AS updated_at FROM orders"""
    ),
    "marks": _both(
        """SELECT annotation_id, image_id, x, y, r, group_id, origin, updated_at,
           CASE WHEN origin = 'manual' THEN 'accepted' ELSE review_status_raw END AS review_status, annotation_id AS ord FROM annotations"""
    ),
    "suggestions": (
        """SELECT annotation_id AS suggestion_id, image_id, x + CAST(annotation_id % 7 - 3 AS DOUBLE) AS x,
           y + CAST(annotation_id % 5 - 2 AS DOUBLE) AS y, r, CAST(annotation_id % 1000 AS DOUBLE) / 1000 AS score,
           'c' || CAST(CAST(floor(x / 400) AS BIGINT) * 10 + CAST(floor(y / 400) AS BIGINT) AS STRING) AS cluster_id,
           CASE WHEN annotation_id % 13 = 0 THEN 'review' ELSE 'ok' END AS status FROM annotations WHERE annotation_id % 11 <> 0
           UNION ALL SELECT 1000000000 + annotation_id, image_id, 4000 - x, y, r, CAST(0 AS DOUBLE), 'fp', 'ok' FROM annotations WHERE annotation_id % 29 = 0""",
        """SELECT annotation_id AS suggestion_id, image_id, x + CAST(annotation_id % 7 - 3 AS DOUBLE) AS x,
           y + CAST(annotation_id % 5 - 2 AS DOUBLE) AS y, r, CAST(annotation_id % 1000 AS DOUBLE) / 1000 AS score,
           'c' || CAST(CAST(floor(x / 400) AS BIGINT) * 10 + CAST(floor(y / 400) AS BIGINT) AS VARCHAR) AS cluster_id,
           CASE WHEN annotation_id % 13 = 0 THEN 'review' ELSE 'ok' END AS status FROM annotations WHERE annotation_id % 11 <> 0
           UNION ALL SELECT 1000000000 + annotation_id, image_id, 4000 - x, y, r, CAST(0 AS DOUBLE), 'fp', 'ok' FROM annotations WHERE annotation_id % 29 = 0""",
    ),
    "versions": _both(
        """SELECT event_id AS version_id, user_id AS project_id, ts AS created_at,
           CASE event_type WHEN 'view' THEN 'periodic' WHEN 'signup' THEN 'session-start' WHEN 'purchase' THEN 'manual'
           WHEN 'error' THEN 'before-destructive' ELSE 'before-restore' END AS reason FROM events"""
    ),
    "op_log": (
        """SELECT user_id AS image_id, event_id AS seq, ts, CAST(get_json_object(props,'$.k') AS INT) % 10 AS annotation_id,
           CASE event_type WHEN 'error' THEN 'remove' WHEN 'purchase' THEN 'update' ELSE 'add' END AS kind, value AS x FROM events""",
        """SELECT user_id AS image_id, event_id AS seq, ts, CAST(json_extract_string(props,'$.k') AS INT) % 10 AS annotation_id,
           CASE event_type WHEN 'error' THEN 'remove' WHEN 'purchase' THEN 'update' ELSE 'add' END AS kind, value AS x FROM events""",
    ),
    "planes": (
        """SELECT CAST(floor(vec_id / 50) AS BIGINT) AS plane_id, vec_id % 50 AS y, CAST(p AS BIGINT) AS x, CAST(e AS DOUBLE) AS v
           FROM embeddings LATERAL VIEW posexplode(embedding) t AS p, e""",
        """SELECT CAST(floor(vec_id / 50) AS BIGINT) AS plane_id, vec_id % 50 AS y, i - 1 AS x, CAST(embedding[i] AS DOUBLE) AS v
           FROM (SELECT vec_id, embedding, unnest(generate_series(1, 64)) AS i FROM embeddings)""",
    ),
    "pixels": (
        """SELECT CAST(floor(vec_id / 50) AS BIGINT) AS image_id, vec_id % 50 AS y, CAST(p AS BIGINT) AS x,
           CAST(floor((CAST(e AS DOUBLE) + 1) * 127.5D) AS INT) AS r,
           CAST(floor((CAST(embedding[(p + 21) % 64] AS DOUBLE) + 1) * 127.5D) AS INT) AS g,
           CAST(floor((CAST(embedding[(p + 42) % 64] AS DOUBLE) + 1) * 127.5D) AS INT) AS b
           FROM embeddings LATERAL VIEW posexplode(embedding) t AS p, e""",
        """SELECT a.plane_id AS image_id, a.y, a.x, CAST(floor((a.v + 1) * 127.5) AS INT) AS r, CAST(floor((b.v + 1) * 127.5) AS INT) AS g,
           CAST(floor((c.v + 1) * 127.5) AS INT) AS b FROM planes a
           JOIN planes b ON a.plane_id=b.plane_id AND a.y=b.y AND b.x=(a.x+21)%64
           JOIN planes c ON a.plane_id=c.plane_id AND a.y=c.y AND c.x=(a.x+42)%64""",
    ),
    "region_vertices": _both(
        """SELECT n.n_nationkey AS region_id, CAST(n.n_nationkey AS BIGINT) % (SELECT count(*) FROM supplier) AS image_id, v.ord,
           CAST(v.dx + (n.n_nationkey % 5) * 100 AS DOUBLE) AS x, CAST(v.dy + (n.n_nationkey % 3) * 100 AS DOUBLE) AS y
           FROM nation n CROSS JOIN (VALUES (0,200,200),(1,3200,200),(2,3200,2400),(3,1700,900),(4,200,2400)) AS v(ord,dx,dy)"""
    ),
    "clusters": _both(
        """SELECT image_id, cluster_id, count(*) AS chosen_k, sum(r * r) * 3 AS area,
           CASE WHEN min(suggestion_id) % 6 = 0 THEN 'review' WHEN min(suggestion_id) % 17 = 0 THEN 'too-large' ELSE 'ok' END AS status
           FROM suggestions GROUP BY image_id, cluster_id"""
    ),
    "unit_configs": _both(
        """SELECT CAST(floor(p_partkey / 8) AS BIGINT) AS unit_id, p_partkey % 8 AS config_id,
           CAST(floor((p_partkey % 8) / 2) AS BIGINT) AS k, CAST((p_size * 7 + p_partkey % 8) % 40 AS DOUBLE) / 10 AS base FROM part"""
    ),
    "unit_disks": _both(
        """SELECT c.unit_id, c.config_id, d.disk_id, CAST(d.disk_id * 10 + c.config_id AS DOUBLE) AS x,
           CAST(c.unit_id % 50 AS DOUBLE) AS y, CAST(6 + (c.unit_id + d.disk_id + c.config_id) % 9 AS DOUBLE) AS r
           FROM unit_configs c JOIN (VALUES (0),(1),(2)) AS d(disk_id) ON d.disk_id < c.k"""
    ),
    "manifest_local": _both(
        "SELECT s_suppkey AS image_id, md5(s_name) AS sha, s_suppkey % 4 = 0 AS dirty FROM supplier WHERE s_suppkey % 9 <> 8"
    ),
    "manifest_remote": _both(
        """SELECT s_suppkey AS image_id, s_suppkey + 1000 AS file_id,
           CASE WHEN s_suppkey % 8 = 0 THEN md5(s_name || '!') ELSE md5(s_name) END AS md5 FROM supplier WHERE s_suppkey % 7 <> 6"""
    ),
    "manifest_seen": _both(
        """SELECT s_suppkey AS image_id, s_suppkey + 1000 AS file_id, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE md5(s_name) END AS md5
           FROM supplier WHERE s_suppkey % 6 <> 5"""
    ),
    "projects": _both(
        """SELECT 'p' || r_regionkey AS project_id, r_name AS project_name, CASE WHEN r_regionkey % 2 = 0 THEN 'local' ELSE 'drive' END AS storage_kind,
           r_regionkey AS revision FROM region"""
    ),
    "project_groups": _both(
        """SELECT 'p' || r_regionkey AS project_id, g.* FROM region JOIN (VALUES ('F','Main colonies',FALSE,FALSE,0),('O','Small colonies',TRUE,FALSE,1),
           ('Z','=Empty group',FALSE,TRUE,2)) AS g(group_id,group_name,hidden,locked,ord) ON r_regionkey >= 0"""
    ),
}

#: Size of the planes and images that the views cut from the vectors. The last one may lack rows.
WIDTH, HEIGHT = 64, 50


def gaps(px: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, y``: raster lines that a plane or image lacks."""
    lines = px.groupBy(*keys).agg(F.collect_set("y").alias("_ys"))
    whole_ = F.sequence(F.lit(0).cast("bigint"), F.lit(HEIGHT - 1).cast("bigint"))
    return lines.select(*keys, F.explode(F.array_except(whole_, "_ys")).alias("y"))


def whole(px: DataFrame, keys: list[str]) -> DataFrame:
    """Rasters of the full size: pixels of lines that are lacking are null and not ``given``."""
    x = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(WIDTH - 1).cast("bigint")))
    lacking = gaps(px, keys).withColumn("x", x).withColumn("given", F.lit(False))
    return px.withColumn("given", F.lit(True)).unionByName(lacking, allowMissingColumns=True)


_WORD = re.compile(r"\b[a-z_]+\b")


def _words(text: str) -> set[str]:
    return set(_WORD.findall(text))


def depends(text: str, dialect: int) -> list[str]:
    """View names a text needs, in creation order."""
    need: set[str] = set()
    queue = [text]
    while queue:
        for w in _words(queue.pop()):
            if w in VIEWS and w not in need:
                need.add(w)
                queue.append(VIEWS[w][dialect])
    return [v for v in VIEWS if v in need]


def oracle(text: str) -> str:
    """DuckDB text with the fixture views it names inlined as CTEs."""
    text = text.strip()
    ctes = ",\n".join(f"{v} AS ({VIEWS[v][1]})" for v in depends(text, 1))
    if not ctes:
        return text
    if re.match(r"(?i)with\s+recursive\s", text):
        return f"WITH RECURSIVE {ctes},\n{re.sub(r'(?i)^with recursive', '', text, count=1)}"
    if re.match(r"(?i)with\s", text):
        return f"WITH {ctes},\n{re.sub(r'(?i)^with', '', text, count=1)}"
    return f"WITH {ctes}\n{text}"


class Tables:
    """Lazy access to driver tables and fixture views of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = tune(spark)
        self.sf_dir = sf_dir
        self._made: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in VIEWS:
                self._made[name] = self.sql(VIEWS[name][0])
            else:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._made[name]

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over the views and tables that the text names."""
        names = [w for w in _words(text) if w in VIEWS or w in BASE]
        used = {n: self(n) for n in names if re.search(rf"(?i)\b(from|join)\s+{n}\b", text)}
        marked = text
        for n in used:
            marked = re.sub(rf"(?i)\b(from|join)\s+{n}\b", rf"\1 {{{n}}}", marked)
        return self.spark.sql(marked, **used)
