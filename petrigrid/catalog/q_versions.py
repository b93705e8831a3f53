"""Queries: version history, restore, edit streams in batch form."""

from pyspark.sql import functions as F

from petrigrid.operators import counts as C
from petrigrid.operators import oplog as O
from petrigrid.operators import reconcile as R
from petrigrid.operators import spatial as S
from petrigrid.operators import versions as V

from .q_joins import IMG, POLY
from .registry import query

c = F.col

_DOCKEYS = """SELECT v.event_id AS version_id, CAST(v.user_id % 5 AS STRING) AS project_id, a.image_id, md5(CAST(a.image_id AS STRING) || ':' || CASE WHEN v.event_id % 20 = 0 THEN CAST(v.event_id AS STRING) ELSE CAST(v.event_id % 7 AS STRING) END) AS part_key
 FROM events v JOIN (SELECT DISTINCT o_custkey % 4 AS image_id FROM orders) a ON a.image_id <= v.event_id % 4 WHERE v.event_id % 10 = 0"""
_DOCKEYS_D = _DOCKEYS.replace("AS STRING", "AS VARCHAR")
_CAP = """SELECT CAST(user_id % 3 AS STRING) AS project_id, event_id % 40 AS capture_id, image_id, md5(CAST(image_id AS STRING) || CAST(CAST(floor(event_id % 40 / 3) AS BIGINT) AS STRING)) AS part_key, CASE event_id % 40 % 4 WHEN 0 THEN 'manual' ELSE 'periodic' END AS reason
 FROM events JOIN (SELECT DISTINCT o_custkey % 5 AS image_id FROM orders) i ON i.image_id <> event_id % 3 WHERE event_type = 'view'"""


@query("ver1_unchanged_captures", f"""WITH k AS (SELECT DISTINCT project_id, capture_id, reason, image_id, part_key FROM ({_CAP.replace('AS STRING', 'AS VARCHAR')})),
s AS (SELECT project_id, capture_id, any_value(reason) AS reason, list(image_id || '=' || part_key ORDER BY image_id) AS sig FROM k GROUP BY 1, 2)
SELECT a.project_id, a.capture_id, coalesce(a.reason IN ('periodic', 'session-start') AND a.sig = b.sig, FALSE) AS skipped FROM s a LEFT JOIN s b ON b.project_id = a.project_id AND b.capture_id = a.capture_id - 1""")
def _(t):
    return V.unchanged_captures(t.sql(_CAP).distinct())


_NOW = "TIMESTAMP '2024-01-31 12:00:00'"
_RET = f"""v AS (SELECT *, epoch_us(created_at) AS us, epoch_us({_NOW}) - epoch_us(created_at) AS age, CASE WHEN reason LIKE 'before%' THEN 2 WHEN reason = 'manual' THEN 1 ELSE 0 END AS rk FROM versions),
b AS (SELECT *, CASE WHEN age < 86400000000 THEN 'v' || version_id WHEN age < 604800000000 THEN 'h' || CAST(floor(us / 3600000000) AS BIGINT) WHEN age < 2592000000000 THEN 'd' || CAST(floor(us / 86400000000) AS BIGINT) END AS bucket FROM v),
best AS (SELECT project_id, version_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id, bucket ORDER BY rk DESC, us DESC, version_id) AS rn FROM b WHERE bucket IS NOT NULL) WHERE rn = 1),
shield AS (SELECT project_id, version_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY us DESC, version_id) AS rn FROM v) WHERE rn <= 3
 UNION SELECT project_id, version_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY us DESC, version_id) AS rn FROM v WHERE rk = 2 AND age < 604800000000) WHERE rn = 1),
kept AS (SELECT * FROM best UNION SELECT * FROM shield),
ranked AS (SELECT k.*, v.us, s.version_id IS NOT NULL AS safe, count(*) OVER (PARTITION BY k.project_id) AS n FROM kept k JOIN v ON v.project_id = k.project_id AND v.version_id = k.version_id LEFT JOIN shield s ON s.project_id = k.project_id AND s.version_id = k.version_id),
cut AS (SELECT *, row_number() OVER (PARTITION BY project_id, safe ORDER BY us, version_id DESC) AS old FROM ranked),
final AS (SELECT project_id, version_id FROM cut WHERE safe OR old > n - {{cap}})"""


@query("ver2_retention", f"WITH {_RET.format(cap=12)} SELECT v.project_id, v.version_id, f.version_id IS NOT NULL AS keep FROM versions v LEFT JOIN final f ON f.project_id = v.project_id AND f.version_id = v.version_id")
def _(t):
    now = F.lit(1706702400000000)  # 2024-01-31 12:00 UTC in microseconds
    return V.retention_plan(t("versions"), now, 12)


@query("ver3_quota_relief", f"""WITH v AS (SELECT *, epoch_us(created_at) AS us, epoch_us({_NOW}) - epoch_us(created_at) AS age FROM versions),
shield AS (SELECT project_id, version_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY us DESC, version_id) AS rn FROM v) WHERE rn = 1
 UNION SELECT project_id, version_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY us DESC, version_id) AS rn FROM v WHERE reason LIKE 'before%' AND age < 604800000000) WHERE rn = 1),
free AS (SELECT *, reason IN ('periodic', 'session-start') AS auto FROM v WHERE NOT EXISTS (SELECT 1 FROM shield s WHERE s.project_id = v.project_id AND s.version_id = v.version_id)),
pick AS (SELECT * FROM (SELECT *, bool_or(auto) OVER (PARTITION BY project_id) AS any_auto FROM free) WHERE auto OR NOT any_auto),
r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY us, version_id DESC) AS rn, count(*) OVER (PARTITION BY project_id) AS n FROM pick)
SELECT project_id, version_id FROM r WHERE rn <= greatest(1, ceil(n / 4))""")
def _(t):
    return V.quota_relief(t("versions"), F.lit(1706702400000000))


@query("ver4_orphan_parts", f"""WITH d AS ({_DOCKEYS_D}) SELECT DISTINCT part_key FROM d WHERE part_key NOT IN (SELECT part_key FROM d WHERE version_id % 30 <> 0)""")
def _(t):
    d = t.sql(_DOCKEYS)
    deleted = d.where("version_id % 30 = 0").select("version_id").distinct()
    return V.orphan_parts(d.select("part_key").distinct(), d, deleted)


@query("ver5_load_status", f"""WITH d AS ({_DOCKEYS_D}), p AS (SELECT DISTINCT part_key FROM d WHERE left(part_key, 1) <> 'a')
SELECT d.version_id, count(*) AS documents, count(*) FILTER (WHERE p.part_key IS NULL) AS missing, count(*) FILTER (WHERE p.part_key IS NULL) = 0 AS complete FROM d LEFT JOIN p ON p.part_key = d.part_key GROUP BY 1""")
def _(t):
    d = t.sql(_DOCKEYS)
    return V.load_status(d, d.where("left(part_key, 1) <> 'a'").select("part_key").distinct())


_VIMG = "SELECT image_id, image_name || ' (old)' AS image_name, image_group_id, deleted_at, 'local' AS source_kind FROM images WHERE image_id % 4 <> 1"
_CIMG = "SELECT image_id, image_name, image_group_id, deleted_at, CASE WHEN image_id % 2 = 0 THEN 'drive' ELSE 'local' END AS source_kind FROM images WHERE image_id % 6 <> 2"


@query("ver6_restored_images", f"""WITH v AS ({_VIMG}), k AS ({_CIMG}) SELECT coalesce(v.image_id, k.image_id) AS image_id, CASE WHEN v.image_id IS NOT NULL THEN v.image_name ELSE k.image_name END AS image_name,
 CASE WHEN v.image_id IS NOT NULL THEN v.image_group_id ELSE k.image_group_id END AS image_group_id, CASE WHEN v.image_id IS NOT NULL THEN v.deleted_at ELSE coalesce(k.deleted_at, TIMESTAMP '2024-03-01 00:00:00') END AS deleted_at,
 CASE WHEN k.image_id IS NOT NULL THEN k.source_kind ELSE v.source_kind END AS source_kind, v.image_id IS NULL AND k.deleted_at IS NULL AS removed_later FROM v FULL OUTER JOIN k ON k.image_id = v.image_id""")
def _(t):
    return V.restored_images(t.sql(_CIMG), t.sql(_VIMG), ["source_kind"], F.expr("TIMESTAMP_NTZ '2024-03-01 00:00:00'"))


@query("ver6_restored_documents", f"""WITH v AS ({_VIMG}), vd AS (SELECT DISTINCT image_id FROM marks WHERE image_id % 5 <> 0), cd AS (SELECT DISTINCT image_id FROM marks)
SELECT i.image_id, CASE WHEN v.image_id IS NOT NULL AND vd.image_id IS NOT NULL THEN 'version' WHEN v.image_id IS NOT NULL AND cd.image_id IS NOT NULL THEN 'emptied' WHEN v.image_id IS NULL AND cd.image_id IS NOT NULL THEN 'current' END AS source
FROM images i LEFT JOIN v ON v.image_id = i.image_id LEFT JOIN vd ON vd.image_id = i.image_id LEFT JOIN cd ON cd.image_id = i.image_id WHERE (v.image_id IS NOT NULL AND (vd.image_id IS NOT NULL OR cd.image_id IS NOT NULL)) OR (v.image_id IS NULL AND cd.image_id IS NOT NULL)""")
def _(t):
    docs = t("marks").select("image_id").distinct()
    return V.restored_documents(t.sql(_VIMG), docs.where("image_id % 5 <> 0"), docs)


@query("ver7_restore_image_ops", """WITH b AS (SELECT annotation_id, image_id, x FROM marks WHERE annotation_id % 7 <> 3), a AS (SELECT annotation_id, image_id, x + CASE WHEN annotation_id % 5 = 1 THEN 1 ELSE 0 END AS x FROM marks WHERE annotation_id % 9 <> 4)
SELECT coalesce(a.image_id, b.image_id) AS image_id, coalesce(a.annotation_id, b.annotation_id) AS annotation_id, CASE WHEN b.annotation_id IS NULL THEN 'add' WHEN a.annotation_id IS NULL THEN 'remove' ELSE 'update' END AS kind
FROM b FULL OUTER JOIN a ON a.annotation_id = b.annotation_id WHERE a.x IS DISTINCT FROM b.x""")
def _(t):
    m = t("marks")
    after = m.where("annotation_id % 9 <> 4").withColumn("x", c("x") + F.when(c("annotation_id") % 5 == 1, 1).otherwise(0))
    return R.diff_ops(m.where("annotation_id % 7 <> 3"), after, ["image_id", "annotation_id"], ["x", "y", "group_id", "origin"]).select("image_id", "annotation_id", "kind")


@query("ver8_restore_summary", """SELECT project_id, count(*) FILTER (WHERE image_id % 3 = 0 AND image_id % 4 <> 1) AS images_changed, count(*) FILTER (WHERE image_id % 4 = 1) AS images_removed,
 CASE WHEN count(*) FILTER (WHERE image_id % 3 = 0 AND image_id % 4 <> 1) > 0 THEN CASE WHEN count(*) FILTER (WHERE image_id % 4 = 1) > 0 THEN 'changes+removals' ELSE 'changes' END ELSE CASE WHEN count(*) FILTER (WHERE image_id % 4 = 1) > 0 THEN 'removals' ELSE 'none' END END AS effect
FROM images WHERE deleted_at IS NULL GROUP BY project_id""")
def _(t):
    rows = C.active(t("images")).select("project_id", "image_id", (c("image_id") % 4 == 1).alias("added_later"), (c("image_id") % 3 == 0).alias("changed"))
    return V.restore_summary(rows, ["project_id"])


@query("ver11_still_dirty", """SELECT l.image_id FROM manifest_local l LEFT JOIN (SELECT user_id AS image_id, max(event_id) AS s0 FROM events WHERE event_id < 700 GROUP BY 1) a ON a.image_id = l.image_id
LEFT JOIN (SELECT user_id AS image_id, max(event_id) AS s1 FROM events WHERE event_type <> 'view' OR event_id < 700 GROUP BY 1) b ON b.image_id = l.image_id WHERE s0 IS DISTINCT FROM s1""")
def _(t):
    e = t("events").select(c("user_id").alias("image_id"), c("event_id").alias("seq"), "event_type")
    return R.edited_since(t("manifest_local").select("image_id"), e.where("seq < 700"), e.where("event_type <> 'view' or seq < 700"))


@query("ver12_delete_image_groups", "SELECT image_id, CASE WHEN image_group_id % 5 = 2 THEN NULL ELSE image_group_id END AS image_group_id FROM images")
def _(t):
    return V.delete_image_group(t("images"), t("nation").where("n_nationkey % 5 = 2").select(c("n_nationkey").alias("image_group_id"))).select("image_id", "image_group_id")


_PM = "SELECT m.annotation_id, i.project_id, m.group_id FROM marks m JOIN images i ON i.image_id = m.image_id"
_DOOM = "SELECT project_id, CASE WHEN project_id = 'p1' THEN 'Z' ELSE 'F' END AS group_id FROM projects WHERE project_id <> 'p3'"


@query("ver12_delete_annotation_groups", f"""WITH m AS ({_PM}), d AS ({_DOOM}), v AS (SELECT d.*, CASE WHEN g.locked THEN 'locked' WHEN (SELECT count(*) FROM project_groups h WHERE h.project_id = d.project_id) <= 1 THEN 'last' ELSE 'deleted' END AS o FROM d JOIN project_groups g ON g.project_id = d.project_id AND g.group_id = d.group_id)
SELECT annotation_id FROM m WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.o = 'deleted' AND v.project_id = m.project_id AND v.group_id = m.group_id)""")
def _(t):
    return V.delete_annotation_group(t.sql(_PM), t("project_groups"), t.sql(_DOOM))["marks"].select("annotation_id")


@query("ver13_clear_in_region", f"WITH {POLY} SELECT i.region_id, m.annotation_id, 'remove' AS kind FROM inside i JOIN marks m ON m.annotation_id = i.annotation_id WHERE m.group_id = 'O'")
def _(t):
    o = t("marks").where("group_id = 'O'")
    return S.in_region(o, t("region_vertices"), "annotation_id", IMG).select("region_id", "annotation_id", F.lit("remove").alias("kind"))


_EDITS = """SELECT image_id, CASE image_id % 5 WHEN 0 THEN 'rename' WHEN 1 THEN 'assign' WHEN 2 THEN 'remove' WHEN 3 THEN 'restore' ELSE 'none' END AS action, CASE WHEN image_id % 10 = 0 THEN '  ' ELSE ' New ' || image_name END AS text,
 CASE WHEN image_id % 3 = 0 THEN NULL ELSE CAST(image_id % 25 AS INT) END AS group_id FROM images"""


@query("ver14_image_edits", f"""WITH e AS ({_EDITS}) SELECT i.image_id, CASE WHEN action = 'rename' AND trim(text) <> '' THEN trim(text) ELSE image_name END AS image_name,
 CASE WHEN action = 'assign' AND (e.group_id IS NULL OR e.group_id < 20) THEN e.group_id ELSE i.image_group_id END AS image_group_id,
 CASE WHEN action = 'restore' THEN NULL WHEN action = 'remove' AND deleted_at IS NULL THEN TIMESTAMP '2024-02-01 00:00:00' ELSE deleted_at END AS deleted_at FROM images i JOIN e ON e.image_id = i.image_id""")
def _(t):
    e = t.sql(_EDITS).withColumn("at", F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'"))
    return V.apply_image_edits(t("images"), e, t("image_groups")).select("image_id", "image_name", "image_group_id", "deleted_at")


@query("win7_versions_by_day", """WITH d AS (SELECT project_id, CAST(created_at AS DATE) AS day, count(*) AS versions, max(created_at) AS newest FROM versions GROUP BY 1, 2)
SELECT project_id, CAST(day AS VARCHAR) AS day, CASE WHEN day = DATE '2024-01-10' THEN 'Today' WHEN day = DATE '2024-01-09' THEN 'Yesterday' ELSE strftime(day, '%a, %b %-d') END AS title, versions, newest FROM d""")
def _(t):
    return V.versions_by_day(t("versions"), F.lit("2024-01-10").cast("date"))


# ---------------------------------------------------------------- edit streams


@query("str1_replay", """WITH r AS (SELECT image_id, annotation_id, max(seq) AS rm FROM op_log WHERE kind = 'remove' GROUP BY 1, 2),
l AS (SELECT o.* FROM op_log o LEFT JOIN r ON r.image_id = o.image_id AND r.annotation_id = o.annotation_id WHERE r.rm IS NULL OR o.seq > r.rm),
a AS (SELECT image_id, annotation_id, min(seq) AS position, arg_min(x, seq) AS ax FROM l WHERE kind = 'add' GROUP BY 1, 2), u AS (SELECT l.image_id, l.annotation_id, arg_max(x, seq) AS ux FROM l JOIN a ON a.image_id = l.image_id AND a.annotation_id = l.annotation_id WHERE kind = 'update' AND seq > position GROUP BY 1, 2)
SELECT a.image_id, a.annotation_id, a.position, coalesce(u.ux, a.ax) AS x FROM a LEFT JOIN u ON u.image_id = a.image_id AND u.annotation_id = a.annotation_id""")
def _(t):
    return O.replay(t("op_log"), IMG, "annotation_id", ["x"])


@query("str2_inverse_ops", "SELECT image_id, annotation_id, -seq AS seq, CASE kind WHEN 'add' THEN 'remove' WHEN 'remove' THEN 'add' ELSE kind END AS kind FROM op_log")
def _(t):
    return O.inverse_ops(t("op_log")).select("image_id", "annotation_id", "seq", "kind")


@query("str4_admitted_ops", """WITH b AS (SELECT *, CAST(floor(seq / 5) AS BIGINT) AS batch_id, CASE annotation_id % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'Z' END AS grp FROM op_log), bad AS (SELECT DISTINCT batch_id FROM b JOIN annotation_groups g ON g.group_id = b.grp WHERE g.locked)
SELECT seq, kind FROM b WHERE batch_id NOT IN (SELECT batch_id FROM bad)""")
def _(t):
    ops = t("op_log").withColumns({"batch_id": F.floor(c("seq") / 5), "grp": F.when(c("annotation_id") % 3 == 0, "F").when(c("annotation_id") % 3 == 1, "O").otherwise("Z")})
    checks = ops.select(
        "batch_id", "kind", c("annotation_id").alias("before_id"), c("annotation_id").alias("after_id"), F.lit("m").alias("before_origin"), F.lit("m").alias("after_origin"), c("grp").alias("before_group"), c("grp").alias("after_group")
    )
    groups = t("annotation_groups").withColumn("hidden", F.lit(False))
    ok, _ = O.admitted(ops, C.check_batches(checks, groups))
    return ok.select("seq", "kind")


@query("str5_debounced_saves", """WITH g AS (SELECT image_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY image_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM op_log),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY image_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT image_id, count(*) AS edits, max(ts) AS last_edit FROM s GROUP BY image_id, k""")
def _(t):
    return O.quiet_sessions(t("op_log"), IMG, "ts", "2 hours")


@query("str6_automatic_versions")
def _(t):
    return O.automatic_versions(t("op_log"), IMG, "ts", 600, 6 * 3600)


@query("str7_retry_backoff", """WITH e AS (SELECT user_id, event_id, event_type IN ('error', 'click') AS failed FROM events), g AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM e),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) AS rn FROM g WHERE failed) SELECT user_id, event_id, rn AS failures, CAST(least(300000, 15000 * pow(2, rn - 1)) AS BIGINT) AS delay_ms FROM n""")
def _(t):
    e = t("events").select("user_id", "event_id", "event_type")
    return O.failure_runs(e, ["user_id"], "event_id", c("event_type").isin("error", "click")).drop("event_type")


@query("str8_signed_counts", "SELECT image_id, annotation_id, CAST(sum(CASE kind WHEN 'add' THEN 1 WHEN 'remove' THEN -1 ELSE 0 END) AS BIGINT) AS net FROM op_log GROUP BY 1, 2")
def _(t):
    return O.signed_counts(t("op_log"), ["image_id", "annotation_id"])
