"""Queries: spatial joins, reconciliation joins, greedy selection, set operations."""

import math

from pyspark.sql import functions as F

from petrigrid.operators import counts as C
from petrigrid.operators import matching as M
from petrigrid.operators import metrics as E
from petrigrid.operators import reconcile as R
from petrigrid.operators import spatial as S

from . import folds
from .registry import query

c = F.col
IMG = ["image_id"]
_D = "sqrt((s.x - m.x) * (s.x - m.x) + (s.y - m.y) * (s.y - m.y))"


@query("src5_ground_truth", """SELECT m.annotation_id, m.image_id, m.x, m.y, m.group_id FROM marks m JOIN annotation_groups g ON g.group_id = m.group_id
WHERE m.review_status = 'accepted' AND (g.group_id = 'Main colonies' OR g.group_name = 'Main colonies')""")
def _(t):
    from petrigrid.sources.ground_truth import confirmed_points

    return confirmed_points(t("marks"), t("annotation_groups"), "Main colonies").select("annotation_id", "image_id", "x", "y", "group_id")


_FILES = """SELECT s_suppkey AS file_no, CASE s_suppkey % 4 WHEN 0 THEN 'zzz.jpg' WHEN 1 THEN s_name WHEN 2 THEN s_name || '.jpg' ELSE 'none.png' END AS file_name,
 CASE WHEN s_suppkey % 4 = 0 THEN sha2(s_name, 256) ELSE 'x' END AS sha FROM supplier"""


@query("src6_lookup_ground_truth", f"""WITH f AS ({_FILES.replace('sha2(s_name, 256)', 'sha256(s_name)')}),
c AS (SELECT f.file_no, i.image_id, 0 AS p, i.ord FROM f JOIN images i ON i.fingerprint = f.sha UNION ALL SELECT f.file_no, i.image_id, 1, i.ord FROM f JOIN images i ON i.image_name = f.file_name
 UNION ALL SELECT f.file_no, i.image_id, 1, i.ord FROM f JOIN images i ON regexp_replace(i.image_name, '\\.[^.]+$', '') = regexp_replace(f.file_name, '\\.[^.]+$', ''))
SELECT f.file_no, arg_min(c.image_id, c.p * 1000000 + c.ord) AS image_id FROM f LEFT JOIN c ON c.file_no = f.file_no GROUP BY 1""")
def _(t):
    from petrigrid.sources.ground_truth import find_images

    return find_images(t.sql(_FILES), t("images")).select("file_no", "image_id")


@query("src8_import_under_new_id", """SELECT p.project_id AS old_id, CASE WHEN i.project_id IS NOT NULL THEN md5(p.project_id) ELSE p.project_id END AS project_id,
 CASE WHEN i.project_id IS NOT NULL THEN p.project_name || ' (imported)' ELSE p.project_name END AS project_name, i.project_id IS NOT NULL AS rekeyed
FROM projects p LEFT JOIN (SELECT DISTINCT project_id FROM images WHERE image_id % 3 = 0) i ON i.project_id = p.project_id""")
def _(t):
    return R.import_under_new_id(t("projects"), t("images").where("image_id % 3 = 0"), F.md5("project_id"))


@query("snk7_fresh_parts", """SELECT DISTINCT sha256(o_orderpriority || o_orderstatus) AS part_key FROM orders
WHERE sha256(o_orderpriority || o_orderstatus) NOT IN (SELECT sha256(o_orderpriority || o_orderstatus) FROM orders WHERE o_orderkey % 1000 = 7)""")
def _(t):
    from petrigrid.operators.versions import fresh_parts

    parts = t("orders").select("o_orderkey", F.sha2(F.concat("o_orderpriority", "o_orderstatus"), 256).alias("part_key"))
    return fresh_parts(parts.select("part_key"), parts.where("o_orderkey % 1000 = 7").select("part_key").distinct())


# ---------------------------------------------------------------- spatial


@query("jon1_candidate_pairs", f"SELECT s.image_id, s.suggestion_id, m.annotation_id, {_D} AS d FROM suggestions s JOIN marks m ON m.image_id = s.image_id AND {_D} <= 20")
def _(t):
    return S.candidate_pairs(t("suggestions"), t("marks"), IMG, 20.0, "suggestion_id", "annotation_id")


@query("jon2_one_to_one", f"WITH {folds.matched('m', 'suggestions', 'marks', '20.0::DOUBLE')} SELECT image_id, p AS suggestion_id, g AS annotation_id, d FROM m")
def _(t):
    return M.match_points(t("suggestions"), t("marks"), IMG, F.lit(20.0), "suggestion_id", "annotation_id")


_NEAR = """SELECT image_id, {probe} AS probe_id, arg_min(nid, (d, -nord)) AS nearest_id, min(d) AS d FROM ({pairs}) GROUP BY 1, 2"""


@query("jon3_nearest", f"""SELECT image_id, suggestion_id, nearest_id, d FROM (SELECT s.image_id, s.suggestion_id, m.annotation_id AS nearest_id, {_D} AS d,
 row_number() OVER (PARTITION BY s.image_id, s.suggestion_id ORDER BY {_D}, m.ord DESC) AS rn
FROM suggestions s JOIN marks m ON m.image_id = s.image_id AND {_D} <= 60 AND m.origin = 'manual') WHERE rn = 1""")
def _(t):
    m = t("marks").select("image_id", "annotation_id", "x", "y", "ord", "origin")
    return S.nearest(t("suggestions").select("image_id", "suggestion_id", "x", "y"), m, IMG, F.lit(60.0), "suggestion_id", "annotation_id", "ord", extra=c("o_origin") == "manual")


@query("jon4_nearest_row_reach", f"""SELECT image_id, annotation_id, nearest_id, d FROM (SELECT m.image_id, m.annotation_id, s.suggestion_id AS nearest_id, {_D} AS d,
 row_number() OVER (PARTITION BY m.image_id, m.annotation_id ORDER BY {_D}, s.suggestion_id DESC) AS rn
FROM marks m JOIN suggestions s ON m.image_id = s.image_id AND {_D} <= greatest(s.r, 16)) WHERE rn = 1""")
def _(t):
    # the reach belongs to the suggestion, so the suggestion side owns the cells
    from petrigrid.plans import grid

    s = t("suggestions").select("image_id", "suggestion_id", "x", "y", "r")
    p = grid.pairs_in_reach(s, t("marks").select("image_id", "annotation_id", "x", "y"), IMG, F.greatest(c("r"), F.lit(16.0)), strict=False)
    best = p.groupBy("image_id", c("o_annotation_id").alias("annotation_id")).agg(F.min(F.struct("d", (-c("suggestion_id")).alias("n"))).alias("m"))
    return best.select("image_id", "annotation_id", (-c("m.n")).alias("nearest_id"), c("m.d").alias("d"))


_DD = _D.replace("s.", "a.")


@query("jon5_double_marks", f"""SELECT image_id, annotation_id, nearest_id, d FROM (SELECT a.image_id, a.annotation_id, m.annotation_id AS nearest_id, {_DD} AS d,
 row_number() OVER (PARTITION BY a.image_id, a.annotation_id ORDER BY {_DD}, m.ord DESC) AS rn
FROM marks a JOIN marks m ON a.image_id = m.image_id AND a.annotation_id <> m.annotation_id AND {_DD} <= greatest(6, a.r) JOIN annotation_groups g ON g.group_id = m.group_id AND NOT g.hidden) WHERE rn = 1""")
def _(t):
    visible = t("marks").join(t("annotation_groups").where("not hidden").select("group_id"), "group_id", "left_semi")
    return S.double_marks(t("marks"), visible, IMG, F.greatest(F.lit(6.0), c("r")), "annotation_id", "ord")


@query("jon6_erase_targets", f"""SELECT image_id, suggestion_id, nearest_id, d FROM (SELECT s.image_id, s.suggestion_id, m.annotation_id AS nearest_id, {_D} AS d,
 row_number() OVER (PARTITION BY s.image_id, s.suggestion_id ORDER BY {_D}, m.ord DESC) AS rn
FROM (SELECT *, CASE suggestion_id % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS want FROM suggestions) s JOIN marks m ON m.image_id = s.image_id AND m.group_id = s.want AND {_D} <= 44) WHERE rn = 1""")
def _(t):
    s = t("suggestions").select("image_id", "suggestion_id", "x", "y", F.when(c("suggestion_id") % 3 == 0, "F").when(c("suggestion_id") % 3 == 1, "O").otherwise("P").alias("group_id"))
    m = t("marks").select("image_id", "group_id", "annotation_id", "x", "y", "ord")
    return S.nearest(s, m, ["image_id", "group_id"], F.lit(44.0), "suggestion_id", "annotation_id", "ord").drop("group_id")


@query("jon7_uncovered", f"""SELECT s.suggestion_id FROM suggestions s WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE m.image_id = s.image_id AND m.origin = 'manual' AND {_D} < 0.7 * s.r)""")
def _(t):
    return S.uncovered(t("suggestions"), t("marks").where(C.manual()), IMG, "suggestion_id").select("suggestion_id")


@query("jon8_not_near_fixed", f"""SELECT s.suggestion_id FROM suggestions s WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE m.image_id = s.image_id AND m.origin = 'manual' AND {_D} < 0.6 * greatest(s.r, m.r))""")
def _(t):
    return S.not_near_fixed(t("suggestions"), t("marks").where(C.manual()), IMG, "suggestion_id").select("suggestion_id")


@query("jon9_carried_rejections", f"""SELECT DISTINCT s.image_id, s.suggestion_id FROM suggestions s JOIN (SELECT * FROM suggestions WHERE suggestion_id % 4 = 1) m
 ON m.image_id = s.image_id AND {_D} < 0.7 * greatest(s.r, m.r) WHERE s.suggestion_id % 4 <> 1""")
def _(t):
    s = t("suggestions")
    return S.carried_rejections(s.where("suggestion_id % 4 <> 1"), s.where("suggestion_id % 4 = 1"), IMG, "suggestion_id")


POLY = """e AS (SELECT a.region_id, a.image_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM region_vertices a JOIN region_vertices b ON b.region_id = a.region_id AND a.ord = (b.ord + 1) % 5),
box AS (SELECT region_id, image_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM region_vertices GROUP BY 1, 2),
inside AS (SELECT e.region_id, m.image_id, m.annotation_id FROM marks m JOIN e ON e.image_id = m.image_id JOIN box k ON k.region_id = e.region_id AND m.x BETWEEN x0 AND x1 AND m.y BETWEEN y0 AND y1
 WHERE (ay > m.y) <> (by_ > m.y) AND m.x < (bx - ax) * (m.y - ay) / (by_ - ay) + ax GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1)"""


@query("jon10_point_in_polygon", f"WITH {POLY} SELECT region_id, annotation_id FROM inside")
def _(t):
    return S.in_region(t("marks"), t("region_vertices"), "annotation_id", IMG).select("region_id", "annotation_id")


@query("geo0_polygon_arrays", f"WITH {POLY} SELECT region_id, annotation_id FROM inside")
def _(t):
    from petrigrid.functions.geometry import in_polygon

    from .q_scalars import regions

    # the array form: one row per region, for polygons that travel as arrays
    return t("marks").join(regions(t), "image_id").where(in_polygon(c("x"), c("y"), c("points"))).select("region_id", "annotation_id")


def _rim(points: str) -> str:
    """Hull sides as pairs of points: nothing lies to their right or on their line outside them."""
    return f"""pts AS (SELECT DISTINCT image_id, x, y FROM ({points})),
rim AS (SELECT a.image_id, a.x, a.y, b.x AS bx, b.y AS by_ FROM pts a JOIN pts b ON a.image_id = b.image_id AND (a.x <> b.x OR a.y <> b.y)
 WHERE NOT EXISTS (SELECT 1 FROM pts p WHERE p.image_id = a.image_id AND ((b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x) < 0 OR ((b.x - a.x) * (p.y - a.y) = (b.y - a.y) * (p.x - a.x) AND (p.x - a.x) * (p.x - b.x) + (p.y - a.y) * (p.y - b.y) > 0))))"""


@query("geo1_convex_hull", f"WITH {_rim('SELECT image_id, x, y FROM marks')} SELECT image_id, x, y FROM rim")
def _(t):
    from petrigrid.operators.shapes import convex_hull

    return convex_hull(t("marks").select("image_id", "x", "y"), IMG).select("image_id", "x", "y")


@query("geo2_simplified_paths")
def _(t):
    from petrigrid.operators.counts import label_numbers
    from petrigrid.operators.shapes import simplify_paths

    path = label_numbers(t("marks").withColumn("group_id", F.lit("path"))).select("image_id", (c("label") - 1).alias("i"), "x", "y")
    return simplify_paths(path, IMG, "i", F.lit(900.0))


@query("geo3_concave_points")
def _(t):
    from petrigrid.operators.contours import contours
    from petrigrid.operators.shapes import concave_points

    grid = t("region_vertices").select("region_id").distinct().withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(79)))).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(59))))
    pixels = grid.select(c("region_id").alias("image_id"), F.concat_ws(":", "x", "y").alias("annotation_id"), ((c("x") + 0.5) * 50).alias("x"), ((c("y") + 0.5) * 50).alias("y"))
    inside = S.in_region(pixels, t("region_vertices").withColumn("image_id", c("region_id")), "annotation_id", IMG)
    mask = inside.select("region_id", F.split_part("annotation_id", F.lit(":"), F.lit(1)).cast("bigint").alias("x"), F.split_part("annotation_id", F.lit(":"), F.lit(2)).cast("bigint").alias("y"))
    contour = contours(mask, ["region_id"]).where("outer").drop("outer")
    return concave_points(contour, mask, ["region_id"], ["contour"], 6)


@query("geo3_ordered_contours")
def _(t):
    from petrigrid.operators.contours import contours

    return contours(t("planes").where("v > 0.1").select("plane_id", "y", "x"), ["plane_id"])


_PLATES = """SELECT image_id, x, y FROM marks UNION ALL SELECT 100000 + image_id, 2000 + 1000 * cos(annotation_id % 63 / 10.0), 1500 + 1000 * sin(annotation_id % 63 / 10.0) FROM marks
 UNION ALL SELECT 200000 + image_id, x, y FROM marks WHERE x + y < 3000"""
_DOUBLE = _PLATES.replace("10.0", "10.0::DOUBLE").replace("1000 * ", "1000::DOUBLE * ")


@query("sca19_plate_shape", f"""WITH {_rim(_DOUBLE)}, q AS (SELECT image_id, count(*) AS n, abs(sum(x * by_ - bx * y)) / 2 AS area, (max(x) - min(x)) * (max(y) - min(y)) AS box, avg(x) AS mx, avg(y) AS my, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, x * x + y * y) AS xq, covar_pop(y, x * x + y * y) AS yq FROM rim GROUP BY 1),
f AS (SELECT *, (xq * yy - yq * xy) / (2 * (xx * yy - xy * xy)) AS cx, (yq * xx - xq * xy) / (2 * (xx * yy - xy * xy)) AS cy FROM q)
SELECT image_id, CASE WHEN n < 3 THEN 'other' WHEN area / box > 0.9 THEN 'square' WHEN area / ({math.pi!r} * (pow(mx - cx, 2) + pow(my - cy, 2) + xx + yy)) > 0.9 AND area / box < 0.82 THEN 'round' ELSE 'other' END AS shape, round(area, 3) AS area FROM f""")
def _(t):
    from petrigrid.operators.shapes import plate_shapes

    return plate_shapes(t.sql(_PLATES.replace("10.0", "10.0D")), IMG).withColumn("area", F.round("area", 3))


@query("jon11_label_lookup", """SELECT m.annotation_id, coalesce(p.label, 0) AS label FROM marks m LEFT JOIN
 (SELECT plane_id AS image_id, y, x, 1 + CAST(floor(x / 8) AS BIGINT) + 8 * CAST(floor(y / 10) AS BIGINT) AS label FROM planes WHERE v > 0) p
 ON p.image_id = m.image_id AND p.x = floor((m.x - 1000) * 0.032) AND p.y = floor((m.y - 500) * 0.032)""")
def _(t):
    labels = t("planes").where("v > 0").select(c("plane_id").alias("image_id"), "y", "x", (1 + F.floor(c("x") / 8) + 8 * F.floor(c("y") / 10)).alias("label"))
    return S.label_at(t("marks"), labels, IMG, 0.032, 1000, 500).select("annotation_id", "label")


# ---------------------------------------------------------------- comparisons

_BEFORE = "SELECT annotation_id, x, y, group_id, origin FROM marks WHERE annotation_id % 7 <> 3"
_AFTER = """SELECT annotation_id, x + CASE WHEN annotation_id % 5 = 1 THEN 1 ELSE 0 END AS x, y, group_id, CASE WHEN annotation_id % 11 = 2 THEN 'automated' ELSE origin END AS origin FROM marks WHERE annotation_id % 9 <> 4"""


@query("jon14_diff_ops", f"""WITH a AS ({_BEFORE}), b AS ({_AFTER}), j AS (SELECT coalesce(a.annotation_id, b.annotation_id) AS annotation_id, a.annotation_id IS NULL AS na, b.annotation_id IS NULL AS nb, a.origin <> b.origin AS og,
 a.x IS DISTINCT FROM b.x OR a.y IS DISTINCT FROM b.y OR a.group_id IS DISTINCT FROM b.group_id AS ch, a.x AS ax, b.x AS bx FROM a FULL OUTER JOIN b ON a.annotation_id = b.annotation_id)
SELECT annotation_id, 'add' AS kind, NULL::DOUBLE AS before_x, bx AS after_x FROM j WHERE na OR (NOT nb AND og) UNION ALL SELECT annotation_id, 'remove', ax, NULL FROM j WHERE nb OR (NOT na AND og)
UNION ALL SELECT annotation_id, 'update', ax, bx FROM j WHERE NOT na AND NOT nb AND NOT og AND ch""")
def _(t):
    ops = R.diff_ops(t.sql(_BEFORE), t.sql(_AFTER), ["annotation_id"], ["x", "y", "group_id", "origin"])
    return ops.select("annotation_id", "kind", c("before.x").alias("before_x"), c("after.x").alias("after_x"))


@query("jon15_compare_groups", """WITH c AS (SELECT i.project_id, m.group_id, count(*) AS now, count(*) FILTER (WHERE annotation_id % 7 <> 3) AS version FROM marks m JOIN images i ON i.image_id = m.image_id WHERE review_status = 'accepted' GROUP BY 1, 2),
vg AS (SELECT project_id, group_id FROM projects, (VALUES ('F'), ('P'), ('Z')) AS t(group_id) WHERE project_id <> 'p4')
SELECT coalesce(vg.project_id, g.project_id) AS project_id, coalesce(vg.group_id, g.group_id) AS group_id, CASE WHEN vg.group_id IS NULL THEN 0 ELSE coalesce(c.version, 0) END AS version, coalesce(c.now, 0) AS now,
 CASE WHEN vg.group_id IS NULL THEN 'now-only' WHEN g.group_id IS NULL THEN 'version-only' ELSE 'both' END AS status
FROM vg FULL OUTER JOIN project_groups g ON g.project_id = vg.project_id AND g.group_id = vg.group_id LEFT JOIN c ON c.project_id = coalesce(vg.project_id, g.project_id) AND c.group_id = coalesce(vg.group_id, g.group_id)""")
def _(t):
    vg = t("projects").where("project_id <> 'p4'").select("project_id", F.explode(F.array(*map(F.lit, "FPZ"))).alias("group_id"))
    old = C.confirmed_by_project(t("marks").where("annotation_id % 7 <> 3"), t("images"))
    return R.compare_groups(vg, t("project_groups"), old, C.confirmed_by_project(t("marks"), t("images")))


@query("jon16_compare_images", """WITH vi AS (SELECT image_id, deleted_at FROM images WHERE image_id % 4 <> 1), vm AS (SELECT * FROM marks WHERE image_id % 4 <> 1 AND NOT (image_id % 3 = 0 AND annotation_id % 50 = 7)),
a AS (SELECT image_id, count(*) FILTER (WHERE review_status = 'accepted') AS n, count(*) AS k FROM vm GROUP BY 1), b AS (SELECT image_id, count(*) FILTER (WHERE review_status = 'accepted') AS n, count(*) AS k FROM marks GROUP BY 1)
SELECT i.image_id, CASE WHEN vi.image_id IS NOT NULL AND vi.deleted_at IS NULL THEN coalesce(a.n, 0) ELSE 0 END AS version, CASE WHEN i.deleted_at IS NULL THEN coalesce(b.n, 0) ELSE 0 END AS now,
 vi.image_id IS NULL AS added_later, coalesce(a.k, 0) <> coalesce(b.k, 0) AS changed
FROM images i LEFT JOIN vi ON vi.image_id = i.image_id LEFT JOIN a ON a.image_id = i.image_id LEFT JOIN b ON b.image_id = i.image_id WHERE i.deleted_at IS NULL OR (vi.image_id IS NOT NULL AND vi.deleted_at IS NULL)""")
def _(t):
    vm = t("marks").where("image_id % 4 <> 1 AND NOT (image_id % 3 = 0 AND annotation_id % 50 = 7)")
    return R.compare_images(t("images").where("image_id % 4 <> 1"), vm, t("images"), t("marks"), ["annotation_id", "x", "y", "group_id", "origin", "review_status"])


_STORED = "SELECT image_id, 'drive' AS source_kind, image_id + 1000 AS file_id FROM images WHERE image_id % 3 <> 0"


@query("jon17_storage_owned", f"""WITH s AS ({_STORED}) SELECT i.image_id, i.image_name, CASE WHEN s.image_id IS NOT NULL THEN s.source_kind ELSE 'local' END AS source_kind, s.file_id
FROM images i LEFT JOIN s ON s.image_id = i.image_id""")
def _(t):
    editor = t("images").select("image_id", "image_name", F.lit("local").alias("source_kind"), F.lit(None).cast("bigint").alias("file_id"))
    return R.apply_storage_owned(editor, t.sql(_STORED), ["source_kind", "file_id"])


@query("jon18_reconcile", """SELECT l.image_id, CASE WHEN NOT l.dirty AND (k.file_id IS NOT NULL OR (s.image_id IS NOT NULL AND s.md5 IS NULL)) THEN 'skip'
 WHEN k.file_id IS NOT NULL AND k.md5 IS DISTINCT FROM s.md5 THEN 'conflict' WHEN k.file_id IS NOT NULL THEN 'update' WHEN s.image_id IS NOT NULL AND s.md5 IS NULL THEN 'conflict'
 WHEN n.file_id IS NOT NULL AND n.md5 <> l.sha THEN 'conflict' WHEN n.file_id IS NOT NULL THEN 'update' ELSE 'create' END AS action
FROM manifest_local l LEFT JOIN manifest_seen s ON s.image_id = l.image_id LEFT JOIN manifest_remote k ON k.file_id = s.file_id LEFT JOIN manifest_remote n ON n.image_id = l.image_id""")
def _(t):
    return R.reconcile_documents(t("manifest_local"), t("manifest_remote"), t("manifest_seen")).select("image_id", "action")


@query("jon19_replaced_images", """SELECT i.image_id, r.md5 AS remote_md5 FROM (SELECT s_suppkey AS image_id, s_suppkey + 1000 AS file_id, CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE md5(s_name) END AS md5, CASE WHEN s_suppkey % 16 = 0 THEN md5(s_name || '!') END AS flagged FROM supplier) i
JOIN manifest_remote r ON r.file_id = i.file_id WHERE i.md5 IS NOT NULL AND i.md5 <> r.md5 AND i.flagged IS DISTINCT FROM r.md5""")
def _(t):
    i = t.sql("SELECT s_suppkey AS image_id, s_suppkey + 1000 AS file_id, CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE md5(s_name) END AS md5, CASE WHEN s_suppkey % 16 = 0 THEN md5(s_name || '!') END AS flagged_md5 FROM supplier")
    return R.replaced_images(i, t("manifest_remote").select("file_id", "md5"))


@query("jon20_unreferenced", """SELECT 'unreferenced' AS kind, file_id FROM manifest_remote WHERE file_id NOT IN (SELECT file_id FROM manifest_seen)
UNION ALL SELECT 'inaccessible', file_id FROM manifest_seen WHERE file_id NOT IN (SELECT file_id FROM manifest_remote)""")
def _(t):
    return R.unreferenced(t("manifest_remote").select("file_id"), t("manifest_seen").select("file_id"))


@query("jon21_import_dedupe", """WITH inc AS (SELECT event_id AS pos, user_id + 900 AS file_id FROM events), k AS (SELECT image_id + 1000 AS file_id, deleted_at FROM images)
SELECT pos, i.file_id, CASE WHEN k.deleted_at IS NOT NULL THEN 'removed' WHEN k.file_id IS NOT NULL THEN 'already' WHEN row_number() OVER (PARTITION BY i.file_id ORDER BY pos) > 1 THEN 'repeated' ELSE 'added' END AS status
FROM inc i LEFT JOIN k ON k.file_id = i.file_id""")
def _(t):
    inc = t("events").select(c("event_id").alias("pos"), (c("user_id") + 900).alias("file_id"))
    return R.import_dedupe(inc, t("images").select((c("image_id") + 1000).alias("file_id"), "deleted_at"))


@query("jon22_reference_candidates", """WITH s AS (SELECT image_id, group_id, least(count(*), 40) AS seeds FROM marks WHERE origin='manual' AND review_status='accepted' GROUP BY 1,2)
SELECT i.project_id, s.group_id, s.image_id, i.image_name, s.seeds FROM s JOIN images i ON i.image_id = s.image_id WHERE s.seeds >= 3 AND i.deleted_at IS NULL AND i.image_id % 6 <> 1""")
def _(t):
    images = t("images").withColumn("source_mismatch", c("image_id") % 6 == 1)
    return R.reference_candidates(images, t("marks")).select("project_id", "group_id", "image_id", "image_name", c("seeds").cast("bigint").alias("seeds"))


@query("jon22_default_source", """WITH s AS (SELECT image_id, group_id, least(count(*), 40) AS seeds FROM marks WHERE origin='manual' AND review_status='accepted' AND (image_id % 4 <> 0 OR annotation_id % 1000 = 0) GROUP BY 1,2),
k AS (SELECT i.project_id, s.group_id, s.image_id, s.seeds, i.image_name FROM s JOIN images i ON i.image_id = s.image_id WHERE s.seeds >= 3 AND i.deleted_at IS NULL AND i.image_id % 6 <> 1),
q AS (SELECT i.project_id, i.image_id, g.group_id, coalesce(s.seeds, 0) AS own FROM images i JOIN project_groups g ON g.project_id = i.project_id LEFT JOIN s ON s.image_id = i.image_id AND s.group_id = g.group_id WHERE i.deleted_at IS NULL)
SELECT q.image_id, q.group_id, CASE WHEN q.own >= 3 THEN NULL ELSE (SELECT k.image_id FROM k WHERE k.project_id = q.project_id AND k.group_id = q.group_id AND k.image_id <> q.image_id ORDER BY k.seeds DESC, k.image_name, k.image_id LIMIT 1) END AS reference_image_id FROM q""")
def _(t):
    images = t("images").withColumn("source_mismatch", c("image_id") % 6 == 1)
    return R.default_seed_source(images, t("project_groups"), t("marks").where("image_id % 4 <> 0 OR annotation_id % 1000 = 0"))


_TAGGED = "SELECT image_id, annotation_id, CASE WHEN annotation_id % 2 = 0 THEN 'run' || CAST(annotation_id % 6 AS STRING) END AS run_id, 'c' || CAST(annotation_id % 40 AS STRING) AS cluster_id FROM annotations"


@query("jon23_resolved_clusters", f"SELECT DISTINCT image_id, cluster_id FROM ({_TAGGED.replace('AS STRING', 'AS VARCHAR')}) WHERE run_id IN ('run0', 'run4')")
def _(t):
    from petrigrid.operators.review import resolved_clusters

    runs = t("region").select(F.concat(F.lit("run"), c("r_regionkey").cast("string")).alias("run_id")).where("run_id in ('run0', 'run4')")
    return resolved_clusters(t.sql(_TAGGED), runs)


_SETS = """a AS (SELECT image_id, cluster_id, suggestion_id AS a_id, x, y, r FROM suggestions), b AS (SELECT image_id, cluster_id, suggestion_id AS b_id, {x} AS x, y, {r} AS r FROM suggestions WHERE suggestion_id % 5 <> 2),
e AS (SELECT a.image_id, a.cluster_id, a_id AS p, b_id AS g, {d} AS d FROM a JOIN b ON a.image_id = b.image_id AND a.cluster_id = b.cluster_id AND {d} < 0.5::DOUBLE * greatest(a.r, b.r)), {m},
parts AS (SELECT image_id, cluster_id, 'shared' AS part, p AS a_id, g AS b_id FROM m UNION ALL SELECT image_id, cluster_id, 'only-a', a_id, NULL FROM a WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.image_id = a.image_id AND m.cluster_id = a.cluster_id AND m.p = a.a_id)
 UNION ALL SELECT image_id, cluster_id, 'only-b', NULL, b_id FROM b WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.image_id = b.image_id AND m.cluster_id = b.cluster_id AND m.g = b.b_id))"""


def circle_sets(x: str, r: str) -> str:
    """CTEs up to ``parts``: the suggestions against a moved selection of them."""
    return _SETS.format(x=x, r=r, d=folds.distance(), m=folds.pairs("m", "e", "d, p, g", "image_id, cluster_id"))


@query("jon24_circle_sets", f"WITH {circle_sets('x + suggestion_id % 9 - 4', 'r * 1.1::DOUBLE')} SELECT * FROM parts")
def _(t):
    from petrigrid.operators.review import compare_options

    a = t("suggestions").select("image_id", "cluster_id", c("suggestion_id").alias("a_id"), "x", "y", "r")
    b = t("suggestions").where("suggestion_id % 5 <> 2").select("image_id", "cluster_id", c("suggestion_id").alias("b_id"), (c("x") + c("suggestion_id") % 9 - 4).alias("x"), "y", (c("r") * 1.1).alias("r"))
    return compare_options(a, b, ["image_id", "cluster_id"], "a_id", "b_id")


@query("jon25_alternative_diff", f"""WITH a AS (SELECT unit_id, disk_id, x, y, r FROM unit_disks WHERE config_id = 6), b AS (SELECT unit_id, disk_id, x + 2 AS x, y, r FROM unit_disks WHERE config_id = 4),
e AS (SELECT a.unit_id, a.disk_id AS p, b.disk_id AS g, {folds.distance()} AS d FROM a JOIN b ON a.unit_id = b.unit_id AND {folds.distance()} <= 0.5::DOUBLE * greatest(a.r, b.r) AND abs(ln(a.r / b.r)) <= 0.3), {folds.pairs('m', 'e', 'p, d, g', 'unit_id')}
SELECT unit_id, 'removed' AS change, disk_id FROM a WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.unit_id = a.unit_id AND m.p = a.disk_id) UNION ALL SELECT unit_id, 'added', disk_id FROM b WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.unit_id = b.unit_id AND m.g = b.disk_id)""")
def _(t):
    from petrigrid.operators.review import alternative_diff

    a = t("unit_disks").where("config_id = 6").select("unit_id", c("disk_id").alias("a_id"), "x", "y", "r")
    b = t("unit_disks").where("config_id = 4").select("unit_id", c("disk_id").alias("b_id"), (c("x") + 2).alias("x"), "y", "r")
    return alternative_diff(a, b, ["unit_id"], "a_id", "b_id")


@query("jon26_exclude_given", f"""WITH given AS (SELECT * FROM suggestions WHERE suggestion_id % 3 = 0), typ AS (SELECT image_id, avg(r) AS r_typ FROM marks GROUP BY 1), gt AS (SELECT m.*, r_typ FROM marks m JOIN typ ON typ.image_id = m.image_id),
{folds.matched('m', 'given', 'gt', 'b.r_typ * 0.5::DOUBLE')} SELECT image_id, annotation_id FROM marks WHERE annotation_id NOT IN (SELECT g FROM m)""")
def _(t):
    given = t("suggestions").where("suggestion_id % 3 = 0").select("image_id", c("suggestion_id").alias("given_id"), "x", "y")
    typ = t("marks").groupBy("image_id").agg(F.avg("r").alias("r_typ"))
    return E.exclude_given(t("marks"), given, typ, IMG).select("image_id", "annotation_id")


@query("jon27_stale_comparisons", f"""WITH {POLY}, cmp AS (SELECT region_id AS comparison_id, image_id, region_id % 4 AS drift FROM box),
ins AS (SELECT i.region_id, i.annotation_id FROM inside i JOIN marks m ON m.annotation_id = i.annotation_id WHERE m.group_id = 'F' AND m.origin = 'manual' AND m.review_status = 'accepted'),
n AS (SELECT k.comparison_id, k.drift, count(i.annotation_id) AS n, coalesce(bool_or(k.drift = 3 AND i.annotation_id % 2 = 0), FALSE) AS moved FROM cmp k LEFT JOIN ins i ON i.region_id = k.comparison_id GROUP BY 1, 2)
SELECT comparison_id, drift = 1 OR drift = 2 OR moved AS stale FROM n""")
def _(t):
    ins = S.in_region(t("marks").where("group_id = 'F' and origin = 'manual' and review_status = 'accepted'"), t("region_vertices"), "annotation_id", IMG)
    inside = ins.groupBy(c("region_id").alias("comparison_id")).agg(F.count(F.lit(1)).alias("n"))
    scored = ins.join(t("marks").select("annotation_id", "x", "y"), "annotation_id").select(
        c("region_id").alias("comparison_id"), "annotation_id", (c("x") + F.when((c("region_id") % 4 == 3) & (c("annotation_id") % 2 == 0), 1.0).otherwise(0.0)).alias("x"), "y"
    )
    keys = t("region_vertices").groupBy("region_id", "image_id").agg(F.concat_ws(";", F.sort_array(F.collect_list(F.concat_ws(",", "ord", "x", "y")))).alias("k"))
    drift = c("region_id") % 4
    cmp_ = keys.join(inside.withColumnRenamed("comparison_id", "region_id"), "region_id", "left").select(
        c("region_id").alias("comparison_id"), c("region_id").alias("image_id"), F.lit("F").alias("group_id"), F.when(drift == 1, "moved").otherwise(c("k")).alias("region_key"),
        (F.coalesce("n", F.lit(0)) + F.when(drift == 2, 1).otherwise(0)).alias("n_scored"), F.lit(0).alias("n_seeds"),
    )
    return R.stale_comparisons(cmp_, keys.select(c("region_id").alias("image_id"), c("k").alias("region_key")), t("marks"), scored, inside)


# ---------------------------------------------------------------- greedy selection


def _farthest(k: int) -> str:
    """One CTE of picks per round: next comes the point farthest from all picked ones."""
    out = ["""h AS (SELECT m.image_id, annotation_id AS id, x, y, n, sqrt((x - gx) * (x - gx) + (y - gy) * (y - gy)) AS d0 FROM marks m JOIN (SELECT image_id, avg(x) AS gx, avg(y) AS gy, count(*) AS n FROM marks WHERE origin = 'manual' GROUP BY 1) c ON c.image_id = m.image_id WHERE origin = 'manual')""",
           "p1 AS MATERIALIZED (SELECT image_id, unnest(m), 1 AS pick FROM (SELECT image_id, arg_min({'id': id, 'x': x, 'y': y}, (d0, id)) AS m FROM h WHERE n > 8 GROUP BY 1))"]
    for i in range(2, k + 1):
        out.append(f"""d{i} AS (SELECT h.image_id, h.id, h.x, h.y, min({folds.distance('h', 'q')}) AS d FROM h JOIN p{i - 1} AS q ON q.image_id = h.image_id WHERE h.id NOT IN (SELECT id FROM p{i - 1}) GROUP BY ALL),
p{i} AS MATERIALIZED (SELECT * FROM p{i - 1} UNION ALL SELECT image_id, unnest(m), {i} FROM (SELECT image_id, arg_max({{'id': id, 'x': x, 'y': y}}, (d, -id)) AS m FROM d{i} GROUP BY 1))""")
    return ",\n".join(out)


@query("win12_farthest_points", f"WITH {_farthest(8)} SELECT image_id, id AS annotation_id, pick FROM p8 UNION ALL SELECT image_id, id, 0 FROM h WHERE n <= 8")
def _(t):
    return M.farthest_points(t("marks").where(C.manual()), IMG, "annotation_id", 8).select("image_id", "annotation_id", "pick")


@query("win13_comparison_plan")
def _(t):
    from petrigrid.operators.review import comparison_plan

    return comparison_plan(t("marks"), t("region_vertices"), "F")


@query("win14_near_duplicates", f"WITH {folds.kept('k', 'suggestions', 'suggestion_id', 'score DESC NULLS LAST', 0.5)} SELECT image_id, suggestion_id, suggestion_id IN (SELECT suggestion_id FROM k) AS kept FROM suggestions")
def _(t):
    return M.near_duplicates(t("suggestions"), IMG, "suggestion_id").select("image_id", "suggestion_id", "kept")


@query("win15_circle_nms", f"WITH {folds.kept('k', 'suggestions', 'suggestion_id', 'score DESC', 1.5)} SELECT image_id, suggestion_id FROM k")
def _(t):
    return M.greedy_keep(t("suggestions"), IMG, "suggestion_id", [-c("score")], 1.5).where("kept").select("image_id", "suggestion_id")


@query("win16_merge_measurements", f"WITH {folds.kept('k', 'suggestions', 'suggestion_id', 'suggestion_id % 20, r DESC, y, x', 0.8)} SELECT image_id, suggestion_id FROM k")
def _(t):
    m = t("suggestions").withColumn("cv", (c("suggestion_id") % 20) / 100)
    return M.greedy_keep(m, IMG, "suggestion_id", [c("cv"), -c("r"), c("y"), c("x")], 0.8).where("kept").select("image_id", "suggestion_id")


@query("win8_reading_order", """SELECT image_id, cluster_id, row_number() OVER (PARTITION BY image_id ORDER BY cy, cx, cluster_id) AS position FROM (SELECT image_id, cluster_id, (min(y - r) + max(y + r)) / 2 AS cy, min(x - r) AS cx FROM suggestions GROUP BY 1, 2)""")
def _(t):
    from petrigrid.operators.review import reading_order

    boxes = t("suggestions").groupBy("image_id", "cluster_id").agg(((F.min(c("y") - c("r")) + F.max(c("y") + c("r"))) / 2).alias("cy"), F.min(c("x") - c("r")).alias("cx"))
    return reading_order(boxes, IMG, "cy", "cx", "cluster_id").select("image_id", "cluster_id", "position")


@query("win9_top_candidates", """SELECT image_id, suggestion_id, row_number() OVER (PARTITION BY image_id ORDER BY y, x, suggestion_id) AS number FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, suggestion_id) AS rk FROM suggestions) WHERE rk <= 60""")
def _(t):
    from petrigrid.operators.review import top_candidates

    return top_candidates(t("suggestions"), IMG, 60).select("image_id", "suggestion_id", "number")


@query("win10_auto_seeds", """SELECT image_id, suggestion_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, suggestion_id) AS rk FROM (SELECT *, count(*) OVER (PARTITION BY image_id, cluster_id) AS n FROM suggestions) WHERE n = 1) WHERE rk <= 7""")
def _(t):
    from petrigrid.operators.review import auto_seeds

    return auto_seeds(t("suggestions"), IMG, 7).select("image_id", "suggestion_id")


@query("win11_largest_seeds", """SELECT image_id, annotation_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY r DESC, ord) AS rk FROM marks WHERE review_status = 'accepted') WHERE rk <= 5""")
def _(t):
    from petrigrid.operators.review import largest_seeds

    return largest_seeds(t("marks").where(C.is_confirmed()), IMG, 5).select("image_id", "annotation_id")


@query("win17_pyramid_level", """WITH p AS (SELECT image_id, unnest([1.0::DOUBLE, 0.5::DOUBLE, 0.25::DOUBLE, 0.125::DOUBLE]) AS scale, 0.1::DOUBLE * CAST(1 + image_id % 13 AS DOUBLE) AS needed FROM images)
SELECT image_id, coalesce(min(scale) FILTER (WHERE scale >= needed), max(scale)) AS scale FROM p GROUP BY 1""")
def _(t):
    from petrigrid.operators.display import pick_level

    levels = t("images").select("image_id", F.explode(F.array(*[F.lit(v) for v in (1.0, 0.5, 0.25, 0.125)])).alias("scale"), (F.lit(0.1) * (1 + c("image_id") % 13)).alias("needed"))
    return pick_level(levels, IMG)


# ---------------------------------------------------------------- sets


@query("set1_union_dirty", "SELECT image_id FROM manifest_local WHERE dirty UNION SELECT image_id FROM manifest_seen WHERE md5 IS NULL")
def _(t):
    return t("manifest_local").where("dirty").select("image_id").union(t("manifest_seen").where("md5 is null").select("image_id")).distinct()


@query("set2_difference", f"WITH {POLY} SELECT annotation_id FROM marks WHERE annotation_id NOT IN (SELECT annotation_id FROM inside)")
def _(t):
    scored = S.in_region(t("marks"), t("region_vertices"), "annotation_id", IMG)
    return t("marks").join(scored, "annotation_id", "left_anti").select("annotation_id")


@query("set3_flagged_clusters", "SELECT image_id, cluster_id FROM clusters WHERE status = 'review' UNION SELECT image_id, cluster_id FROM suggestions WHERE status = 'review'")
def _(t):
    return E.flagged_clusters(t("suggestions"), t("clusters"), IMG)


@query("set4_same_documents", """WITH a AS (SELECT image_id % 5 AS grp, list(image_id || ':' || sha ORDER BY image_id) AS k FROM manifest_local GROUP BY 1), b AS (SELECT image_id % 5 AS grp, list(image_id || ':' || md5 ORDER BY image_id) AS k FROM manifest_remote GROUP BY 1)
SELECT coalesce(a.grp, b.grp) AS grp, a.k IS NOT DISTINCT FROM b.k AS identical FROM a FULL OUTER JOIN b ON a.grp = b.grp""")
def _(t):
    a = t("manifest_local").select((c("image_id") % 5).alias("grp"), "image_id", c("sha").alias("key"))
    b = t("manifest_remote").select((c("image_id") % 5).alias("grp"), "image_id", c("md5").alias("key"))
    return E.same_result(a, b, ["grp"])


@query("set5_fresh_records", """SELECT image_id, 'old' AS origin FROM manifest_local UNION ALL SELECT image_id, 'new' FROM manifest_remote WHERE image_id NOT IN (SELECT image_id FROM manifest_local)""")
def _(t):
    old = t("manifest_local").select("image_id", F.lit("old").alias("origin"))
    new = t("manifest_remote").join(old, "image_id", "left_anti").select("image_id", F.lit("new").alias("origin"))
    return old.unionByName(new)
