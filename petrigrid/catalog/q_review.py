"""Queries: unit decisions, pending suggestions, acceptance."""

import math

from pyspark.sql import functions as F

from petrigrid.operators import counts as C
from petrigrid.operators import decisions as D
from petrigrid.operators import matching as M
from petrigrid.operators import metrics as E
from petrigrid.operators import review as R
from petrigrid.operators import spatial as S

from .q_joins import IMG
from . import folds
from .q_joins import circle_sets
from .registry import query

c = F.col
LOG_R = math.log(9.0)
_COST = "(CASE WHEN z > 0 THEN 2 ELSE 0.5 END) * (CASE WHEN abs(z) <= 2 THEN 0.5 * z * z ELSE 2 * (abs(z) - 1) END)"


def _scores(lam, s):
    return f"""(SELECT q.unit_id, q.config_id, q.k, round(q.base + {lam}::DOUBLE * coalesce(sum(d.r * d.r) / 81, 0) + 0.6::DOUBLE * coalesce(sum({_COST}), 0), 12) AS score
 FROM unit_configs q LEFT JOIN (SELECT *, (ln(r) - ln(9::DOUBLE)) / {s}::DOUBLE AS z FROM unit_disks) d ON d.unit_id = q.unit_id AND d.config_id = q.config_id GROUP BY q.unit_id, q.config_id, q.k, q.base)"""


@query("rev1_config_scores", f"SELECT unit_id, config_id, round(score, 6) AS score FROM {_scores(0.1, 0.3)}")
def _(t):
    s = D.config_scores(t("unit_configs"), t("unit_disks"), [{"id": "base", "lambda": 0.1, "s": 0.3}], LOG_R)
    return s.select("unit_id", "config_id", F.round("score", 6).alias("score"))


@query("rev2_decisions", f"""WITH s AS {_scores(0.1, 0.3)}, p AS (SELECT unit_id, k, min(score) AS score FROM s GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY score, k) AS rk FROM p)
SELECT unit_id, max(k) FILTER (WHERE rk = 1) AS best_k, max(k) FILTER (WHERE rk = 2) AS runner_k, round(max(score) FILTER (WHERE rk = 2) - max(score) FILTER (WHERE rk = 1), 6) AS gap FROM r GROUP BY 1""")
def _(t):
    s = D.config_scores(t("unit_configs"), t("unit_disks"), [{"id": "base", "lambda": 0.1, "s": 0.3}], LOG_R)
    return D.decide(s).select("unit_id", "best_k", "runner_k", F.round("gap", 6).alias("gap"))


@query("rev3_contested_area", f"""WITH s AS {_scores(0.1, 0.3)}, pk AS (SELECT unit_id, k, min(score) AS score, arg_min(config_id, (score, config_id)) AS cfg FROM s GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY score, k) AS rk FROM pk),
dec AS (SELECT unit_id, max(cfg) FILTER (WHERE rk = 1) AS best, max(k) FILTER (WHERE rk = 1) AS best_k, max(cfg) FILTER (WHERE rk = 2) AS runner, max(k) FILTER (WHERE rk = 2) AS runner_k, max(score) FILTER (WHERE rk = 2) - max(score) FILTER (WHERE rk = 1) AS gap FROM r GROUP BY 1),
a AS (SELECT d.* FROM unit_disks d JOIN dec ON dec.unit_id = d.unit_id AND d.config_id = best), b AS (SELECT d.* FROM unit_disks d JOIN dec ON dec.unit_id = d.unit_id AND d.config_id = runner),
e AS (SELECT a.unit_id, a.disk_id AS p, b.disk_id AS g, {folds.distance()} AS d FROM a JOIN b ON a.unit_id = b.unit_id AND {folds.distance()} < 0.5::DOUBLE * greatest(a.r, b.r) AND abs(ln(a.r / b.r)) < 0.3), {folds.pairs('m', 'e', 'p, d, g', 'unit_id')},
loose AS (SELECT unit_id, r FROM a WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.unit_id = a.unit_id AND m.p = a.disk_id) UNION ALL SELECT unit_id, r FROM b WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.unit_id = b.unit_id AND m.g = b.disk_id)),
ar AS (SELECT unit_id, sum(r * r) / 81 AS area FROM loose GROUP BY 1)
SELECT dec.unit_id, best_k, runner_k, round(gap, 6) AS gap, round(coalesce(area, 0), 6) AS contested, round(gap / greatest(0.25::DOUBLE, coalesce(area, 0)), 6) AS relative_gap FROM dec LEFT JOIN ar ON ar.unit_id = dec.unit_id""")
def _(t):
    s = D.config_scores(t("unit_configs"), t("unit_disks"), [{"id": "base", "lambda": 0.1, "s": 0.3}], LOG_R)
    return D.with_relative_gap(D.decide(s), t("unit_disks"), 9.0).select("unit_id", "best_k", "runner_k", *[F.round(n, 6).alias(n) for n in ("gap", "contested", "relative_gap")])


def _settings():
    return [(x["id"], x["lambda"], x["s"]) for x in D.slider_settings(0.1, 0.3)]


@query("rev4_stability_flips", "WITH " + ", ".join(f"s{i} AS {_scores(lam, s)}" for i, (_, lam, s) in enumerate(_settings())) + ", a AS (" + " UNION ALL ".join(f"SELECT '{n}' AS setting, * FROM s{i}" for i, (n, _, _) in enumerate(_settings())) + """),
d AS (SELECT setting, unit_id, arg_min(k, (sc, k)) AS k FROM (SELECT setting, unit_id, k, min(score) AS sc FROM a GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT d.unit_id, coalesce(string_agg(DISTINCT CASE WHEN d.k <> b.k THEN CAST(d.k AS VARCHAR) END, ',' ORDER BY CASE WHEN d.k <> b.k THEN CAST(d.k AS VARCHAR) END), '') AS flips FROM d JOIN d AS b ON b.unit_id = d.unit_id AND b.setting = 'base' WHERE d.setting <> 'base' GROUP BY 1""")
def _(t):
    s = D.config_scores(t("unit_configs"), t("unit_disks"), D.slider_settings(0.1, 0.3), LOG_R)
    return D.stability_flips(D.decide(s)).select("unit_id", F.array_join(c("flips").cast("array<string>"), ",").alias("flips"))


@query("rev5_review_flags")
def _(t):
    fixed = t("unit_configs").where("unit_id % 5 = 0").select("unit_id")
    return D.final_decisions(t("unit_configs"), t("unit_disks"), fixed, 0.1, 0.3, LOG_R, review_gap=0.2)


@query("rev6_reconciled_clusters", """WITH k AS (SELECT image_id, cluster_id, count(*) AS n FROM suggestions WHERE suggestion_id % 6 <> 1 GROUP BY 1, 2), a AS (SELECT image_id, cluster_id, count(*) AS n FROM suggestions WHERE suggestion_id % 3 <> 1 GROUP BY 1, 2),
q AS (SELECT c.image_id, c.cluster_id, c.chosen_k, c.status, c.status <> 'ok' AS alt, coalesce(k.n, 0) AS n, coalesce(a.n, 0) AS m FROM clusters c LEFT JOIN k ON k.image_id = c.image_id AND k.cluster_id = c.cluster_id LEFT JOIN a ON a.image_id = c.image_id AND a.cluster_id = c.cluster_id)
SELECT image_id, cluster_id, CASE WHEN status = 'too-large' THEN chosen_k ELSE n END AS chosen_k, CASE WHEN status = 'too-large' THEN chosen_k + 1 WHEN alt AND n <> m THEN m END AS runner_up_k,
 CASE WHEN status <> 'too-large' AND alt AND n = m THEN 'ok' ELSE status END AS status, alt AND (status = 'too-large' OR n <> m) AS has_alternative FROM q""")
def _(t):
    cl = t("clusters").withColumns({"has_alternative": c("status") != "ok", "runner_up_k": F.when(c("status") != "ok", c("chosen_k") + 1)})
    return R.reconcile_clusters(cl, t("suggestions").where("suggestion_id % 6 <> 1"), t("suggestions").where("suggestion_id % 3 <> 1"))


def _pending(t):
    s = t("suggestions")
    resolved = t("clusters").where("chosen_k % 9 = 4").select("image_id", "cluster_id")
    rejected = s.where("suggestion_id % 8 = 3").select("suggestion_id")
    return R.pending_marks(s, t("clusters"), t("marks").where(C.manual()), rejected, resolved)


_PENDING = f"""{folds.kept('best', 'suggestions', 'suggestion_id', 'score DESC NULLS LAST', 0.5)},
flagged AS (SELECT image_id, cluster_id FROM clusters WHERE status = 'review' UNION SELECT image_id, cluster_id FROM suggestions WHERE status = 'review'),
hand AS (SELECT * FROM marks WHERE origin = 'manual'),
pending AS (SELECT s.image_id, s.cluster_id, s.suggestion_id, s.x, s.y, s.r, s.score, f.image_id IS NOT NULL AS in_review, CASE WHEN s.suggestion_id % 8 = 3 THEN 'rejected' WHEN f.image_id IS NOT NULL THEN 'review' ELSE 'ok' END AS state
 FROM suggestions s LEFT JOIN flagged f ON f.image_id = s.image_id AND f.cluster_id = s.cluster_id WHERE s.suggestion_id IN (SELECT suggestion_id FROM best)
 AND NOT EXISTS (SELECT 1 FROM clusters k WHERE k.image_id = s.image_id AND k.cluster_id = s.cluster_id AND k.chosen_k % 9 = 4) AND NOT EXISTS (SELECT 1 FROM hand h WHERE h.image_id = s.image_id AND {folds.distance('s', 'h')} < 0.7::DOUBLE * s.r))"""


@query("rev7_pending_view", f"WITH {_PENDING} SELECT image_id, count(*) FILTER (WHERE state <> 'rejected') AS suggested, count(*) FILTER (WHERE state = 'review') AS need_review, count(*) FILTER (WHERE state = 'rejected') AS rejected, count(*) FILTER (WHERE state = 'ok') AS ok FROM pending GROUP BY 1")
def _(t):
    return R.pending_counts(_pending(t))


@query("rev7_review_regions", f"""WITH {_PENDING}, q AS (SELECT image_id, cluster_id, count(*) FILTER (WHERE state <> 'rejected') AS n, count(*) FILTER (WHERE state = 'rejected') AS rejected, min(x - r) AS x0, min(y - r) AS y0, max(x + r) AS x1, max(y + r) AS y1 FROM pending WHERE in_review GROUP BY 1, 2)
SELECT image_id, cluster_id, n AS primary, rejected, x0, y0, x1, y1, CASE WHEN n = 1 THEN 'Colony?' ELSE n || ' colonies?' END AS question FROM q""".replace("n AS primary", 'n AS "primary"'))
def _(t):
    return R.review_clusters(_pending(t))


@query("rev8_accept_plan", f"""WITH {_PENDING}, free AS (SELECT * FROM pending WHERE state = 'ok'), {folds.kept('won', 'free', 'suggestion_id', 'score DESC NULLS LAST', 0.5)}
SELECT image_id, suggestion_id, CASE WHEN suggestion_id IN (SELECT suggestion_id FROM won) THEN 'accepted' ELSE 'duplicate' END AS outcome FROM free UNION ALL SELECT image_id, suggestion_id, 'negative' FROM pending WHERE state = 'rejected' AND NOT in_review""")
def _(t):
    return R.accept_plan(_pending(t), t("marks").where(C.manual()))


@query("rev9_to_annotations", """SELECT sha256('run-' || image_id || ':' || suggestion_id) AS annotation_id, image_id, x, y, 'F' AS group_id, 'automated' AS origin, 'accepted' AS review_status, 'automated' AS last_edit_source, FALSE AS manually_adjusted,
 TIMESTAMP '2024-01-20 00:00:00' AS created_at, 'colony-fitter' AS detector_name, '1' AS detector_version, 'run-' || image_id AS run_id, NULL::DOUBLE AS confidence, cluster_id, score, status, floor(r * 1.037::DOUBLE * 100 + 0.5) / 100 AS geometry_r FROM suggestions""")
def _(t):
    s = t("suggestions").withColumn("r", c("r") * 1.037)
    return R.to_annotations(s, "F", F.concat(F.lit("run-"), c("image_id").cast("string")), "colony-fitter", "1", F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'"))


@query("rev10_toggled", """SELECT suggestion_id FROM suggestions WHERE (suggestion_id % 8 = 3) <> (suggestion_id % 5 = 1)""")
def _(t):
    s = t("suggestions").select("suggestion_id")
    return R.toggle_rejections(s.where("suggestion_id % 8 = 3"), s.where("suggestion_id % 5 = 1"))


@query("rev11_reject_runs", "SELECT image_id, count(*) AS negatives FROM suggestions WHERE suggestion_id % 8 = 3 AND suggestion_id % 5 <> 1 GROUP BY 1")
def _(t):
    s = t("suggestions")
    return R.reject_runs(s.where("suggestion_id % 8 = 3"), s.where("suggestion_id % 5 = 1"))


@query("rev12_display_marks", f"""WITH {_PENDING}, {circle_sets('x', 'r')}, focus AS (SELECT image_id, min(cluster_id) AS cluster_id FROM clusters WHERE status = 'review' GROUP BY 1)
SELECT p.image_id, p.suggestion_id, p.x, p.y, p.r, CASE WHEN f.image_id IS NULL THEN state WHEN state = 'rejected' THEN 'rejected' WHEN o.a_id IS NOT NULL THEN 'changed' ELSE 'review' END AS state
FROM pending p LEFT JOIN focus f ON f.image_id = p.image_id AND f.cluster_id = p.cluster_id LEFT JOIN (SELECT * FROM parts WHERE part = 'only-a') o ON o.image_id = p.image_id AND o.cluster_id = p.cluster_id AND o.a_id = p.suggestion_id""")
def _(t):
    p = _pending(t)
    a = t("suggestions").select("image_id", "cluster_id", c("suggestion_id").alias("a_id"), "x", "y", "r")
    b = t("suggestions").where("suggestion_id % 5 <> 2").select("image_id", "cluster_id", c("suggestion_id").alias("b_id"), "x", "y", "r")
    focus = t("clusters").where("status = 'review'").groupBy("image_id").agg(F.min("cluster_id").alias("cluster_id"))
    return R.display_marks(p, R.compare_options(a, b, ["image_id", "cluster_id"], "a_id", "b_id"), focus)


@query("rev13_comparison", f"""WITH gt AS (SELECT image_id, annotation_id, x, y FROM marks WHERE origin = 'manual'), {folds.matched('m', 'suggestions', 'gt', '12.0::DOUBLE')}
SELECT *, nullif(tp, 0) AS matched, nullif(fp, 0) AS extra, nullif(fn, 0) AS missed FROM ({folds.counts('suggestions', 'gt', 'm')})""")
def _(t):
    det = t("suggestions").select("image_id", "suggestion_id", "x", "y")
    gt = t("marks").where(C.manual()).select("image_id", "annotation_id", "x", "y")
    pairs = M.match_points(det, gt, IMG, F.lit(12.0), "suggestion_id", "annotation_id")
    n = R.comparison_marks(gt, det, pairs, IMG).groupBy("image_id").pivot("kind", ["matched", "extra", "missed"]).count()
    return E.match_counts(det, gt, pairs, IMG).join(n, "image_id", "left")


@query("rev14_requests", """WITH act AS (SELECT image_id FROM images WHERE deleted_at IS NULL), s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY ord DESC) AS rn FROM marks WHERE group_id = 'F' AND origin = 'manual' AND review_status = 'accepted') WHERE rn <= 40)
SELECT s.image_id, 'seed' AS role, annotation_id, x, y, NULL::DOUBLE AS r FROM s JOIN act ON act.image_id = s.image_id
UNION ALL SELECT act.image_id, 'remote-seed', annotation_id, x, y, NULL FROM act JOIN s ON s.image_id = act.image_id + 1 WHERE act.image_id % 4 = 2
UNION ALL SELECT m.image_id, 'existing', annotation_id, x, y, CASE WHEN origin = 'automated' THEN r END FROM marks m JOIN act ON act.image_id = m.image_id""")
def _(t):
    ref = t("images").select("image_id", F.when(c("image_id") % 4 == 2, c("image_id") + 1).alias("reference_image_id"))
    return R.detection_requests(t("images"), t("marks"), ref, "F")


@query("rev15_slider_sweep", "WITH " + ", ".join(f"s{i} AS {_scores(l, s)}" for i, (l, s) in enumerate([(0.0, 0.2), (0.1, 0.3), (0.2, 0.45)])) + """,
a AS (""" + " UNION ALL ".join(f"SELECT '{i}' AS setting, * FROM s{i}" for i in range(3)) + """), b AS (SELECT setting, unit_id, k, min(score) AS sc FROM a GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY setting, unit_id ORDER BY sc, k) AS rk FROM b)
SELECT setting, CAST(sum(k) AS BIGINT) AS colonies, count(*) FILTER (WHERE k = 0) AS empty_units FROM r WHERE rk = 1 GROUP BY 1""")
def _(t):
    st = [{"id": str(i), "lambda": l, "s": s} for i, (l, s) in enumerate([(0.0, 0.2), (0.1, 0.3), (0.2, 0.45)])]
    d = D.decide(D.config_scores(t("unit_configs"), t("unit_disks"), st, LOG_R))
    return d.groupBy("setting").agg(F.sum("best_k").alias("colonies"), F.count_if(c("best_k") == 0).alias("empty_units"))


@query("rev16_cluster_summary", f"""WITH s AS {_scores(0.1, 0.3)}, p AS (SELECT unit_id, k, min(score) AS score FROM s GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY score, k) AS rk FROM p),
d AS (SELECT unit_id, max(k) FILTER (WHERE rk = 1) AS best_k, max(score) FILTER (WHERE rk = 2) - max(score) FILTER (WHERE rk = 1) AS gap FROM r GROUP BY 1)
SELECT 'c' || CAST(floor(unit_id / 3) AS BIGINT) AS cluster_id, CAST(sum(best_k) AS BIGINT) AS chosen_k, round(min(gap), 6) AS gap, CAST(sum(CASE WHEN unit_id % 5 = 0 THEN 2 ELSE 0 END) AS BIGINT) AS fixed, count(*) AS units FROM d GROUP BY 1""")
def _(t):
    d = D.decide(D.config_scores(t("unit_configs"), t("unit_disks"), [{"id": "base", "lambda": 0.1, "s": 0.3}], LOG_R))
    units = t("unit_configs").select("unit_id").distinct().withColumn("cluster_id", F.concat(F.lit("c"), F.floor(c("unit_id") / 3).cast("string")))
    fixed = units.where("unit_id % 5 = 0").select("unit_id")
    return D.cluster_summary(d, units, fixed.unionAll(fixed)).withColumn("gap", F.round("gap", 6))


@query("fil10_post_filter")
def _(t):
    from petrigrid.operators.detector import post_filter

    fixed = t("marks").where(C.manual()).select("image_id", "x", "y", "r")
    roi = t("planes").where("v > -0.2").select(c("plane_id").alias("image_id"), "y", "x", F.lit(1).alias("label"))
    return post_filter(t("suggestions"), fixed, t("region_vertices"), roi, t("images"), 0.016).select("image_id", "suggestion_id")
