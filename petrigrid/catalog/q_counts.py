"""Queries: filters, policies and derived counts."""

from pyspark.sql import functions as F

from petrigrid.operators import counts as C
from petrigrid.operators import quality as Q

from .registry import query

# ---------------------------------------------------------------- filters


@query("fil1_confirmed", "SELECT annotation_id, image_id, group_id FROM marks WHERE review_status = 'accepted'")
def _(t):
    return t("marks").where(C.is_confirmed()).select("annotation_id", "image_id", "group_id")


@query("fil2_active_images", "SELECT image_id, image_name FROM images WHERE deleted_at IS NULL")
def _(t):
    return C.active(t("images")).select("image_id", "image_name")


@query("fil2_removed_images", "SELECT image_id, image_name, deleted_at FROM images WHERE deleted_at IS NOT NULL ORDER BY deleted_at DESC, ord")
def _(t):
    return C.removed(t("images")).select("image_id", "image_name", "deleted_at")


@query("fil3_images_in_group", """
SELECT i.image_id, 'g10' AS which FROM images i WHERE i.deleted_at IS NULL AND i.image_group_id = 10
UNION ALL SELECT i.image_id, 'ungrouped' FROM images i WHERE i.deleted_at IS NULL
AND (i.image_group_id IS NULL OR i.image_group_id NOT IN (SELECT image_group_id FROM image_groups))""")
def _(t):
    one = C.images_in_group(t("images"), t("image_groups"), 10).select("image_id", F.lit("g10").alias("which"))
    rest = C.images_in_group(t("images"), t("image_groups"), None).select("image_id", F.lit("ungrouped").alias("which"))
    return one.unionByName(rest)


@query("fil4_edit_block", """
SELECT a.annotation_id, CASE WHEN g.group_id IS NULL THEN 'no-group' WHEN g.locked THEN 'locked' WHEN g.hidden THEN 'hidden' END AS block
FROM annotations a LEFT JOIN annotation_groups g ON a.group_id = g.group_id""")
def _(t):
    return C.with_edit_block(t("annotations"), t("annotation_groups")).select("annotation_id", "block")


_BATCHES = """SELECT CAST(floor(annotation_id / 4) AS BIGINT) AS batch_id, CASE annotation_id % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'remove' ELSE 'update' END AS kind,
 annotation_id AS before_id, annotation_id + CASE WHEN annotation_id % 101 = 5 THEN 1 ELSE 0 END AS after_id,
 origin AS before_origin, CASE WHEN annotation_id % 97 = 2 THEN 'other' ELSE origin END AS after_origin,
 CASE WHEN annotation_id % 3 = 0 THEN NULL WHEN annotation_id % 7 = 1 THEN 'Z' ELSE group_id END AS before_group,
 CASE WHEN annotation_id % 3 = 1 THEN NULL ELSE group_id END AS after_group FROM annotations"""


@query("fil5_check_batches", f"""
WITH ops AS ({_BATCHES}),
touched AS (SELECT batch_id, kind = 'update' AND (before_id <> after_id OR before_origin <> after_origin) AS invalid, before_group AS group_id FROM ops WHERE before_group IS NOT NULL
 UNION ALL SELECT batch_id, kind = 'update' AND (before_id <> after_id OR before_origin <> after_origin), after_group FROM ops WHERE after_group IS NOT NULL),
ranked AS (SELECT t.batch_id, min(CASE WHEN t.invalid THEN 1 WHEN g.group_id IS NULL THEN 4 WHEN g.locked THEN 2 WHEN g.hidden THEN 3 ELSE 9 END) AS r
 FROM touched t LEFT JOIN annotation_groups g ON t.group_id = g.group_id GROUP BY t.batch_id)
SELECT batch_id, CASE r WHEN 1 THEN 'invalid' WHEN 2 THEN 'locked' WHEN 3 THEN 'hidden' WHEN 4 THEN 'missing' END AS reason FROM ranked""")
def _(t):
    return C.check_batches(t.sql(_BATCHES), t("annotation_groups"))


_RUNS = """SELECT c.image_id || '/' || c.cluster_id AS run_id, c.image_id, CASE WHEN c.chosen_k % 3 = 0 THEN 'stale' ELSE i.fingerprint END AS image_fingerprint,
 CASE c.chosen_k % 4 WHEN 0 THEN 'F' WHEN 1 THEN 'O' WHEN 2 THEN 'Z' ELSE 'gone' END AS target_group_id
 FROM clusters c JOIN images i ON c.image_id = i.image_id"""


@query("fil6_check_runs", f"""
WITH runs AS ({_RUNS})
SELECT r.run_id, CASE WHEN r.image_fingerprint <> i.fingerprint THEN 'fingerprint mismatch' WHEN i.image_id % 6 = 1 THEN 'bytes changed'
 WHEN g.group_id IS NULL THEN 'unknown group' END AS problem
FROM runs r JOIN images i ON r.image_id = i.image_id LEFT JOIN annotation_groups g ON g.group_id = r.target_group_id""")
def _(t):
    images = t("images").withColumn("source_mismatch", F.col("image_id") % 6 == 1)
    return C.check_runs(t.sql(_RUNS), images, t("annotation_groups"))


@query("fil7_seed_marks", """
SELECT annotation_id, image_id, group_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id, group_id ORDER BY ord DESC) AS rn
 FROM marks WHERE origin = 'manual' AND review_status = 'accepted') WHERE rn <= 40""")
def _(t):
    return C.seed_marks(t("marks")).select("annotation_id", "image_id", "group_id")


# one project without groups and one without examples, so that every reason occurs
@query("fil8_find_block", """
WITH m AS (SELECT m.* FROM marks m JOIN images i ON i.image_id = m.image_id WHERE i.project_id <> 'p2'),
s AS (SELECT image_id, group_id, least(count(*), 40) AS seeds FROM m WHERE origin='manual' AND review_status='accepted' GROUP BY 1,2),
elig AS (SELECT s.*, i.project_id FROM s JOIN images i ON s.image_id = i.image_id WHERE i.deleted_at IS NULL AND i.image_id % 6 <> 1 AND s.seeds >= 3),
refs AS (SELECT project_id, group_id, count(*) AS n FROM elig GROUP BY 1, 2),
grid AS (SELECT i.image_id, i.project_id, i.image_id % 6 = 1 AS mismatch, i.image_id % 8 = 3 AS size_mismatch, g.group_id, g.locked, g.hidden
 FROM images i LEFT JOIN (SELECT * FROM project_groups WHERE project_id <> 'p3') g ON g.project_id = i.project_id)
SELECT q.image_id, q.group_id, CASE WHEN q.group_id IS NULL THEN 'no-group' WHEN q.locked THEN 'locked' WHEN q.hidden THEN 'hidden' WHEN q.mismatch THEN 'source-mismatch'
 WHEN q.size_mismatch THEN 'size-mismatch' WHEN coalesce(s.seeds,0)=0 AND coalesce(r.n,0) - CASE WHEN e.image_id IS NULL THEN 0 ELSE 1 END = 0 THEN 'no-seeds' END AS block
FROM grid q LEFT JOIN s ON s.image_id=q.image_id AND s.group_id=q.group_id LEFT JOIN refs r ON r.project_id=q.project_id AND r.group_id=q.group_id
LEFT JOIN elig e ON e.image_id=q.image_id AND e.group_id=q.group_id""")
def _(t):
    from petrigrid.operators.reconcile import find_block

    images = t("images").withColumns({"source_mismatch": F.col("image_id") % 6 == 1, "size_mismatch": F.col("image_id") % 8 == 3})
    marks = t("marks").join(images.where("project_id = 'p2'").select("image_id"), "image_id", "left_anti")
    return find_block(images, t("project_groups").where("project_id <> 'p3'"), marks)


@query("fil9_points_in_box", """
SELECT annotation_id FROM marks WHERE x >= 1000 AND y >= 500 AND x < 2020 AND y < 1900""")
def _(t):
    from petrigrid.functions.geometry import in_box

    return t("marks").where(in_box(F.col("x"), F.col("y"), 1000, 500, 1020, 1400)).select("annotation_id")


@query("fil11_visible_rect", """
WITH v AS (SELECT image_id, CAST(image_id % 9 * 150 - 300 AS DOUBLE) + 0.25 AS ox, CAST(image_id % 5 * 210 - 200 AS DOUBLE) + 0.5 AS oy, 0.25 * CAST(1 + image_id % 4 AS DOUBLE) AS s, width, height FROM images)
SELECT image_id, CAST(greatest(0, floor(ox)) AS BIGINT) AS x0, CAST(greatest(0, floor(oy)) AS BIGINT) AS y0,
 CAST(least(width, ceil(ox + 1024 / s)) AS BIGINT) AS x1, CAST(least(height, ceil(oy + 768 / s)) AS BIGINT) AS y1 FROM v""")
def _(t):
    from petrigrid.functions.geometry import visible_rect

    v = t("images").select(
        "image_id", "width", "height",
        (F.col("image_id") % 9 * 150 - 300 + F.lit(0.25)).alias("ox"),
        (F.col("image_id") % 5 * 210 - 200 + F.lit(0.5)).alias("oy"),
        (F.lit(0.25) * (1 + F.col("image_id") % 4)).alias("s"),
    )
    return v.select("image_id", *visible_rect(F.col("ox"), F.col("oy"), F.col("s"), 1024, 768, F.col("width"), F.col("height")))


_LAYERS = """SELECT c.image_id, CASE WHEN c.image_id % 5 = 2 THEN 'old' ELSE i.fingerprint END AS image_fingerprint,
 CASE WHEN c.image_id % 11 = 4 THEN 'gone' ELSE 'F' END AS group_id FROM (SELECT DISTINCT image_id FROM suggestions) c JOIN images i ON i.image_id = c.image_id
 UNION ALL SELECT -1, 'x', 'F' FROM region WHERE r_regionkey = 0"""


@query("fil12_stale_layers", f"""
WITH layers AS ({_LAYERS})
SELECT l.image_id FROM layers l LEFT JOIN images i ON i.image_id = l.image_id LEFT JOIN annotation_groups g ON g.group_id = l.group_id
WHERE i.image_id IS NULL OR i.deleted_at IS NOT NULL OR i.image_id % 6 = 1 OR i.fingerprint <> l.image_fingerprint OR g.group_id IS NULL""")
def _(t):
    from petrigrid.operators.review import stale_layers

    images = t("images").withColumn("source_mismatch", F.col("image_id") % 6 == 1)
    return stale_layers(t.sql(_LAYERS), images, t("annotation_groups")).select("image_id")


# ---------------------------------------------------------------- aggregations

_BD = """count(*) FILTER (WHERE review_status='accepted') AS confirmed, count(*) FILTER (WHERE review_status='accepted' AND origin='manual') AS manual,
 count(*) FILTER (WHERE review_status='accepted' AND origin<>'manual') AS automated_accepted,
 count(*) FILTER (WHERE origin='automated' AND review_status='unreviewed') AS automated_unreviewed"""


@query("agg1_confirmed_by_group", "SELECT image_id, group_id, count(*) AS confirmed FROM marks WHERE review_status='accepted' GROUP BY 1, 2")
def _(t):
    return C.confirmed_by_group(t("marks"), ["image_id", "group_id"])


@query("agg2_breakdown", f"SELECT image_id, group_id, {_BD} FROM marks GROUP BY 1, 2")
def _(t):
    return C.breakdown(t("marks"), ["image_id", "group_id"])


@query("agg3_group_tally", """SELECT image_id, group_id, count(*) AS total, count(*) FILTER (WHERE origin='manual') AS manual,
 count(*) FILTER (WHERE origin<>'manual') AS automated FROM marks GROUP BY 1, 2""")
def _(t):
    return C.tally(t("marks"), ["image_id", "group_id"])


@query("agg4_visibility_split", """
SELECT m.image_id, count(*) FILTER (WHERE NOT coalesce(g.hidden, FALSE)) AS visible, count(*) FILTER (WHERE coalesce(g.hidden, FALSE)) AS hidden
FROM marks m LEFT JOIN annotation_groups g ON g.group_id = m.group_id WHERE m.review_status='accepted' GROUP BY 1""")
def _(t):
    return C.visibility_split(t("marks"), t("annotation_groups"))


_FRAME = """
WITH present AS (SELECT DISTINCT image_id, group_id FROM marks),
frame AS (SELECT i.image_id, i.project_id, g.group_id, g.group_name, g.hidden, g.locked FROM images i JOIN project_groups g ON g.project_id = i.project_id
 UNION ALL SELECT i.image_id, i.project_id, p.group_id, '(unknown group)', FALSE, FALSE FROM present p JOIN images i ON i.image_id = p.image_id
 WHERE NOT EXISTS (SELECT 1 FROM project_groups g WHERE g.project_id = i.project_id AND g.group_id = p.group_id))"""


@query("jon12_image_group_frame", _FRAME + " SELECT image_id, group_id, group_name, hidden, locked FROM frame")
def _(t):
    present = t("marks").select("image_id", "group_id").distinct()
    return C.image_group_frame(t("images"), t("project_groups"), present).select("image_id", "group_id", "group_name", "hidden", "locked")


_SNAP = "SELECT DISTINCT image_id, group_id, 'Snapshot ' || group_id AS group_name, group_id = 'P' AS hidden, FALSE AS locked FROM annotations WHERE image_id % 2 = 0"


@query("jon13_group_resolution", f"""
WITH snap AS ({_SNAP}) SELECT m.annotation_id, coalesce(g.group_name, s.group_name, '(unknown group)') AS group_name
FROM marks m LEFT JOIN annotation_groups g ON g.group_id = m.group_id LEFT JOIN snap s ON s.image_id = m.image_id AND s.group_id = m.group_id""")
def _(t):
    from petrigrid.operators.reconcile import resolve_groups

    return resolve_groups(t("marks"), t("annotation_groups"), t.sql(_SNAP)).select("annotation_id", "group_name")


@query("agg5_summary_rows", _FRAME.replace("FROM images i", "FROM images i").rstrip() + f""",
cnt AS (SELECT image_id, group_id, {_BD} FROM marks GROUP BY 1, 2),
docs AS (SELECT image_id, max(updated_at) AS at FROM marks GROUP BY 1)
SELECT i.project_id, p.project_name, coalesce(CAST(i.image_group_id AS VARCHAR), '') AS image_group_id, coalesce(ig.image_group_name, '') AS image_group_name,
 i.image_id, i.image_name, '' AS drive_file_id, f.group_id AS annotation_group_id, f.group_name AS annotation_group_name,
 coalesce(c.confirmed, 0) AS confirmed_count, coalesce(c.manual, 0) AS manual_count, coalesce(c.automated_accepted, 0) AS automated_accepted_count,
 coalesce(c.automated_unreviewed, 0) AS automated_unreviewed_count, f.hidden AS group_hidden, f.locked AS group_locked,
 i.width AS image_width, i.height AS image_height, i.fingerprint AS image_fingerprint_sha256,
 coalesce(CAST(d.at AS VARCHAR), '') AS annotations_updated_at
FROM frame f JOIN images i ON i.image_id = f.image_id LEFT JOIN cnt c ON c.image_id = f.image_id AND c.group_id = f.group_id
LEFT JOIN image_groups ig ON ig.image_group_id = i.image_group_id LEFT JOIN projects p ON p.project_id = i.project_id
LEFT JOIN docs d ON d.image_id = i.image_id WHERE i.deleted_at IS NULL""")
def _(t):
    docs = t("marks").groupBy("image_id").agg(F.max("updated_at").alias("updated_at"))
    return C.summary_rows(t("images"), t("image_groups"), t("project_groups"), t("marks"), t("projects"), docs)


@query("agg8_clear_summary", """
WITH per AS (SELECT i.project_id, m.group_id, m.image_id, count(*) AS total, count(*) FILTER (WHERE origin='manual') AS manual, count(*) FILTER (WHERE origin<>'manual') AS automated
 FROM marks m JOIN images i ON i.image_id = m.image_id WHERE i.deleted_at IS NULL GROUP BY 1, 2, 3)
SELECT project_id, group_id, CAST(sum(total) AS BIGINT) AS total, CAST(sum(manual) AS BIGINT) AS manual, CAST(sum(automated) AS BIGINT) AS automated, count(*) AS images FROM per GROUP BY 1, 2""")
def _(t):
    return C.clear_summary(t("marks"), t("images"))


@query("agg9_group_usage", "SELECT i.project_id, a.group_id, count(*) AS annotations, count(DISTINCT a.image_id) AS images FROM annotations a JOIN images i ON i.image_id = a.image_id GROUP BY 1, 2")
def _(t):
    return C.group_usage(t("annotations"), t("images"))


@query("agg10_version_counts", """
WITH per AS (SELECT i.project_id, m.group_id, count(*) AS n FROM marks m JOIN images i ON i.image_id = m.image_id WHERE i.deleted_at IS NULL AND m.review_status='accepted' GROUP BY 1, 2)
SELECT g.project_id, g.group_id, g.group_name, coalesce(p.n, 0) AS confirmed FROM project_groups g LEFT JOIN per p ON p.project_id = g.project_id AND p.group_id = g.group_id
UNION ALL SELECT g.project_id, '*', '(total)', coalesce((SELECT CAST(sum(n) AS BIGINT) FROM per WHERE per.project_id = g.project_id), 0) FROM (SELECT DISTINCT project_id FROM project_groups) g""")
def _(t):
    return C.version_counts(t("marks"), t("images"), t("project_groups"))


@query("agg21_project_summaries", """
SELECT p.project_id, p.project_name, p.storage_kind, count(i.image_id) FILTER (WHERE i.deleted_at IS NULL) AS image_count
FROM projects p LEFT JOIN images i ON i.project_id = p.project_id GROUP BY 1, 2, 3""")
def _(t):
    n = C.active(t("images")).groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
    return t("projects").join(n, "project_id", "left").select("project_id", "project_name", "storage_kind", F.coalesce("n", F.lit(0)).alias("image_count"))


@query("agg22_current_counts", """
WITH per AS (SELECT i.project_id, m.group_id, count(*) AS n FROM marks m JOIN images i ON i.image_id = m.image_id
 WHERE i.deleted_at IS NULL AND m.review_status='accepted' GROUP BY 1, 2)
SELECT project_id, group_id, n AS confirmed FROM per UNION ALL SELECT project_id, '*', CAST(sum(n) AS BIGINT) FROM per GROUP BY 1""")
def _(t):
    per_image = C.confirmed_by_group(t("marks"), ["image_id", "group_id"])
    j = per_image.join(C.active(t("images")).select("image_id", "project_id"), "image_id")
    per = j.groupBy("project_id", "group_id").agg(F.sum("confirmed").alias("confirmed"))
    return per.unionByName(per.groupBy("project_id").agg(F.sum("confirmed").alias("confirmed")).withColumn("group_id", F.lit("*")))


# ---------------------------------------------------------------- ordering

_ORDER = """o AS (SELECT i.project_id, i.image_id, row_number() OVER (PARTITION BY i.project_id ORDER BY coalesce(g.group_ord, 2000000000), i.ord) AS position
 FROM images i LEFT JOIN image_groups g ON g.image_group_id = i.image_group_id WHERE i.deleted_at IS NULL)"""


@query("win1_display_order", f"WITH {_ORDER} SELECT * FROM o")
def _(t):
    return C.display_order(t("images"), t("image_groups")).select("project_id", "image_id", "position")


@query("win2_label_number", """SELECT annotation_id, row_number() OVER (PARTITION BY image_id, group_id ORDER BY ord) AS label
FROM marks WHERE review_status='accepted'""")
def _(t):
    return C.label_numbers(t("marks").where(C.is_confirmed())).select("annotation_id", "label")


@query("win3_next_previous", f"""WITH {_ORDER} SELECT image_id, coalesce(lag(image_id) OVER w, image_id) AS previous, coalesce(lead(image_id) OVER w, image_id) AS next
FROM o WINDOW w AS (PARTITION BY project_id ORDER BY position)""")
def _(t):
    from petrigrid.operators.ordering import neighbours

    return neighbours(C.display_order(t("images"), t("image_groups")), ["project_id"], "position", "image_id").select("image_id", "previous", "next")


@query("win4_move_item", """
WITH mv AS (SELECT project_id, min(ord) AS item FROM images GROUP BY 1),
base AS (SELECT i.project_id, i.image_id, i.ord, row_number() OVER (PARTITION BY i.project_id ORDER BY i.ord) - 1 AS idx, count(*) OVER (PARTITION BY i.project_id) AS n FROM images i),
tgt AS (SELECT b.project_id, b.idx AS f, least(b.n - 1, greatest(0, b.idx + 3)) AS t FROM base b JOIN mv ON mv.project_id = b.project_id AND mv.item = b.ord)
SELECT b.project_id, b.image_id, CAST(CASE WHEN b.idx = t.f THEN t.t WHEN t.f < t.t AND b.idx > t.f AND b.idx <= t.t THEN b.idx - 1
 WHEN t.f > t.t AND b.idx >= t.t AND b.idx < t.f THEN b.idx + 1 ELSE b.idx END AS BIGINT) AS position FROM base b JOIN tgt t ON t.project_id = b.project_id""")
def _(t):
    from petrigrid.operators.ordering import move_items
    from petrigrid.plans.ranks import ordered_rank

    items = ordered_rank(t("images"), ["project_id"], "ord", "rank").withColumn("position", F.col("rank") - 1)
    sizes = items.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"))
    moves = items.where("position = 0").select("project_id", F.lit(0).cast("bigint").alias("from_pos"), F.lit(3).cast("bigint").alias("to_pos"))
    return move_items(items.select("project_id", "image_id", "position"), sizes, moves, ["project_id"])


@query("win5_unique_names", """
WITH RECURSIVE taken AS (SELECT DISTINCT image_group_id % 3 AS project, lower(trim(CASE WHEN image_group_id % 4 = 0 THEN 'Group' WHEN image_group_id % 4 = 1 THEN 'group 2' ELSE image_group_name END)) AS name FROM image_groups),
req AS (SELECT DISTINCT image_group_id % 3 AS project, b.base FROM image_groups JOIN (VALUES ('Group'), ('New group'), ('Brazil')) AS b(base) ON TRUE),
cand AS (SELECT r.*, k, CASE WHEN k = 1 THEN r.base ELSE r.base || ' ' || k END AS name FROM req r JOIN (SELECT unnest(generate_series(1, 40)) AS k) ON TRUE)
SELECT CAST(project AS BIGINT) AS project, base, min_by(name, k) AS name FROM cand c
WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.project = c.project AND t.name = lower(c.name)) GROUP BY 1, 2""")
def _(t):
    from petrigrid.operators.ordering import unique_names

    taken = t.sql("""SELECT CAST(image_group_id % 3 AS BIGINT) AS project, CASE WHEN image_group_id % 4 = 0 THEN 'Group' WHEN image_group_id % 4 = 1 THEN 'group 2' ELSE image_group_name END AS name FROM image_groups""")
    wanted = taken.select("project").distinct().withColumn("base", F.explode(F.array(F.lit("Group"), F.lit("New group"), F.lit("Brazil"))))
    return unique_names(wanted, taken, ["project"])


@query("win6_next_colour", """
WITH pal AS (SELECT * FROM (VALUES (0,'#d55e00'),(1,'#56b4e9'),(2,'#009e73'),(3,'#f0e442'),(4,'#0072b2'),(5,'#e69f00'),(6,'#cc79a7'),(7,'#000000')) AS v(ord, value)),
used AS (SELECT n_regionkey AS project, lower(CASE WHEN n_nationkey % 2 = 0 THEN upper(p.value) ELSE p.value END) AS colour FROM nation JOIN pal p ON p.ord = (n_nationkey * n_regionkey) % 8),
n AS (SELECT project, count(*) AS n FROM used GROUP BY 1),
free AS (SELECT n.project, min(p.ord) AS ord FROM n JOIN pal p ON NOT EXISTS (SELECT 1 FROM used u WHERE u.project = n.project AND u.colour = p.value) GROUP BY 1)
SELECT n.project, p.value AS colour FROM n LEFT JOIN free f ON f.project = n.project JOIN pal p ON p.ord = coalesce(f.ord, n.n % 8)""")
def _(t):
    from petrigrid.functions.style import GROUP_PALETTE
    from petrigrid.operators.ordering import next_colours

    pal = F.array(*[F.lit(v) for _, v in GROUP_PALETTE])
    used = t("nation").select(
        F.col("n_regionkey").alias("project"), F.element_at(pal, ((F.col("n_nationkey") * F.col("n_regionkey")) % 8 + 1).cast("int")).alias("v"), (F.col("n_nationkey") % 2 == 0).alias("up")
    ).select("project", F.when(F.col("up"), F.upper("v")).otherwise(F.col("v")).alias("colour"))
    return next_colours(used, ["project"])


# ---------------------------------------------------------------- validation


@query("val1_schema_gate", """SELECT p_partkey, CASE WHEN v IS NULL THEN 'missing' WHEN v > 1 THEN 'newer' WHEN v <> 1 THEN 'unsupported' END AS problem
FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 1 END AS v FROM part)""")
def _(t):
    v = F.when(F.col("p_partkey") % 5 == 0, None).when(F.col("p_partkey") % 5 == 1, 2).when(F.col("p_partkey") % 5 == 2, 0).otherwise(1)
    return t("part").select("p_partkey", Q.schema_gate(v).alias("problem"))


_DOCS = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderpriority END AS name,
 CASE WHEN o_orderkey % 40 = 1 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 30 = 2 THEN NULL ELSE o_orderkey % 2 = 0 END AS flag FROM orders"""


@query("val2_required_fields", f"""WITH d AS ({_DOCS}) SELECT id, 'name' AS path, 'not-text' AS rule FROM d WHERE name IS NULL
UNION ALL SELECT id, 'price', 'not-finite' FROM d WHERE price IS NULL UNION ALL SELECT id, 'flag', 'not-boolean' FROM d WHERE flag IS NULL""")
def _(t):
    rules = [Q.required_string("name", F.col("name")), Q.required_number("price", F.col("price")), ("flag", "not-boolean", F.col("flag").isNull())]
    return Q.violations(t.sql(_DOCS), ["id"], rules)


@query("val3_enumerations", """SELECT annotation_id, 'origin' AS path, 'unlisted: manual|automated' AS rule FROM annotations WHERE annotation_id % 17 = 0 OR origin NOT IN ('manual','automated')
UNION ALL SELECT annotation_id, 'reviewStatus', 'unlisted: accepted|rejected' FROM annotations WHERE review_status_raw NOT IN ('accepted','rejected')""")
def _(t):
    a = t("annotations").withColumn("origin", F.when(F.col("annotation_id") % 17 == 0, "robot").otherwise(F.col("origin")))
    rules = [Q.one_of("origin", F.col("origin"), ["manual", "automated"]), Q.one_of("reviewStatus", F.col("review_status_raw"), ["accepted", "rejected"])]
    return Q.violations(a, ["annotation_id"], rules)


@query("val4_ranges", """SELECT p_partkey, 'opacity' AS path, 'outside: 0..1' AS rule FROM part WHERE CAST(p_size - 3 AS DOUBLE) / 40 NOT BETWEEN 0 AND 1
UNION ALL SELECT p_partkey, 'size', 'not-positive' FROM part WHERE p_size - 10 <= 0""")
def _(t):
    rules = [Q.in_range("opacity", (F.col("p_size") - 3).cast("double") / 40, 0, 1), Q.positive("size", F.col("p_size") - 10)]
    return Q.violations(t("part"), ["p_partkey"], rules)


@query("val5_duplicate_ids", "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return Q.duplicate_ids(t("lineitem"), ["l_orderkey", "l_linenumber"])


@query("val6_dangling_groups", """SELECT i.image_id, CAST(g.image_group_id AS INT) AS image_group_id, CASE WHEN i.image_group_id IS NOT NULL AND g.image_group_id IS NULL
 THEN 'unknown-image-group: ' || i.image_name END AS warning
FROM images i LEFT JOIN image_groups g ON g.image_group_id = i.image_group_id""")
def _(t):
    return Q.drop_dangling_groups(t("images"), t("image_groups")).select("image_id", F.col("image_group_id").cast("int").alias("image_group_id"), "warning")


@query("val7_defaults", """SELECT p_partkey, coalesce(CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END, 12) AS label_size,
 coalesce(CASE WHEN p_size % 2 = 0 THEN NULL ELSE p_size END, 0) AS revision FROM part""")
def _(t):
    raw = t("part").select(
        "p_partkey", F.when(F.col("p_size") % 3 != 0, F.col("p_size")).alias("label_size"), F.when(F.col("p_size") % 2 != 0, F.col("p_size")).alias("revision"), F.lit("x").alias("excluded_drive_file_ids")
    )
    return Q.fill_defaults(raw, {"label_size": Q.DEFAULT_LABEL_SIZE, "revision": 0}, ["excluded_drive_file_ids"])


@query("val8_manual_accepted", "SELECT annotation_id, review_status FROM marks")
def _(t):
    return Q.normalise_marks(t("annotations")).select("annotation_id", "review_status")


_FILES = """SELECT i.image_id AS file_image_id, CASE WHEN i.image_id % 12 = 5 THEN i.image_id + 1 ELSE i.image_id END AS image_id,
 CASE WHEN i.image_id % 5 = 1 THEN 'other' ELSE i.project_id END AS project_id, CASE WHEN i.image_id % 7 = 2 THEN 'old' ELSE i.fingerprint END AS fingerprint,
 CASE WHEN i.image_id % 9 = 3 THEN 10 ELSE i.width END AS width, i.height FROM images i"""


@query("val11_document_vs_image", f"""WITH d AS ({_FILES})
SELECT d.file_image_id, CASE WHEN d.image_id <> d.file_image_id THEN 'other-image' END AS error,
 CASE WHEN d.image_id = d.file_image_id AND d.project_id <> i.project_id THEN i.project_id END AS reassigned_to,
 d.image_id = d.file_image_id AND (d.fingerprint <> i.fingerprint OR d.width <> i.width OR d.height <> i.height) AS different_version
FROM d JOIN images i ON i.image_id = d.file_image_id""")
def _(t):
    return Q.check_documents(t.sql(_FILES), t("images"))


@query("val12_stray_documents", """SELECT 'no-image' AS problem, l.image_id FROM manifest_local l WHERE l.image_id NOT IN (SELECT image_id FROM manifest_remote)
UNION ALL SELECT 'no-document', r.image_id FROM manifest_remote r WHERE r.image_id NOT IN (SELECT image_id FROM manifest_local)
UNION ALL SELECT 'other-content', l.image_id FROM manifest_local l JOIN manifest_remote r ON r.image_id = l.image_id WHERE l.sha <> r.md5""")
def _(t):
    a, b = t("manifest_local"), t("manifest_remote")
    tag = lambda df, p: df.select(F.lit(p).alias("problem"), "image_id")
    diff = a.join(b, "image_id").where(F.col("sha") != F.col("md5"))
    return tag(Q.stray_documents(a, b), "no-image").unionByName(tag(Q.stray_documents(b, a), "no-document")).unionByName(tag(diff, "other-content"))
