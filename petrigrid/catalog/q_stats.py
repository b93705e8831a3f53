"""Queries: evaluation metrics, robust statistics, sampling and fits."""

import math

from pyspark.sql import functions as F

from petrigrid.functions import scoring as G
from petrigrid.operators import counts as C
from petrigrid.operators import fits as FT
from petrigrid.operators import matching as M
from petrigrid.operators import metrics as E
from petrigrid.operators import robust as R
from petrigrid.operators import spatial as S

from .q_joins import IMG, POLY
from . import folds
from .registry import query

c = F.col


def r6(col):
    return F.round(col, 6)


# ---------------------------------------------------------------- regions


@query("agg6_region_tally", f"""WITH {POLY} SELECT k.region_id, count(m.annotation_id) FILTER (WHERE m.group_id = 'F') AS total, count(*) FILTER (WHERE m.group_id = 'F' AND m.origin = 'manual') AS manual,
 count(*) FILTER (WHERE m.group_id = 'F' AND m.origin <> 'manual') AS automated, count(*) FILTER (WHERE m.group_id = 'F' AND m.review_status = 'accepted') AS group_confirmed, count(*) FILTER (WHERE m.review_status = 'accepted') AS all_confirmed
FROM box k LEFT JOIN inside i ON i.region_id = k.region_id LEFT JOIN marks m ON m.annotation_id = i.annotation_id GROUP BY 1""")
def _(t):
    ins = S.in_region(t("marks"), t("region_vertices"), "annotation_id", IMG)
    j = t("region_vertices").select("region_id").distinct().join(ins.join(t("marks").drop("image_id"), "annotation_id"), "region_id", "left")
    g, acc = c("group_id") == "F", c("review_status") == "accepted"
    return j.groupBy("region_id").agg(
        F.count_if(g).alias("total"), F.count_if(g & C.manual()).alias("manual"), F.count_if(g & ~C.manual()).alias("automated"), F.count_if(g & acc).alias("group_confirmed"), F.count_if(acc).alias("all_confirmed")
    )


@query("agg7_inside_outside", f"""WITH {POLY}, s AS (SELECT * FROM marks WHERE group_id = 'F' AND origin = 'manual' AND review_status = 'accepted')
SELECT k.region_id, count(i.annotation_id) AS inside, count(s.annotation_id) - count(i.annotation_id) AS outside FROM box k LEFT JOIN s ON s.image_id = k.image_id LEFT JOIN inside i ON i.region_id = k.region_id AND i.annotation_id = s.annotation_id GROUP BY 1""")
def _(t):
    s = t("marks").where("group_id = 'F' and origin = 'manual' and review_status = 'accepted'")
    ins = S.in_region(s, t("region_vertices"), "annotation_id", IMG).groupBy("region_id").agg(F.count(F.lit(1)).alias("i"))
    n = s.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    k = t("region_vertices").select("region_id", "image_id").distinct().join(n, "image_id", "left").join(ins, "region_id", "left")
    z = lambda x: F.coalesce(x, F.lit(0))
    return k.select("region_id", z("i").alias("inside"), (z("n") - z("i")).alias("outside"))


# ---------------------------------------------------------------- evaluation


@query("agg11_precision_recall", """SELECT image_id, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1 END AS recall,
 CASE WHEN 2 * tp + fp + fn = 0 THEN 1 WHEN tp = 0 AND tp + fp > 0 AND tp + fn > 0 THEN 0 ELSE round(2 * (CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END) * (CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1 END) / ((CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END) + (CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1 END)), 12) END AS f1
FROM (SELECT image_id, CAST(count(*) FILTER (WHERE review_status = 'accepted' AND origin = 'automated') AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE review_status = 'rejected') AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE origin = 'manual') AS DOUBLE) AS fn FROM marks GROUP BY 1)""")
def _(t):
    n = t("marks").groupBy("image_id").agg(F.count_if(F.expr("review_status = 'accepted' and origin = 'automated'")).alias("tp"), F.count_if(F.expr("review_status = 'rejected'")).alias("fp"), F.count_if(F.expr("origin = 'manual'")).alias("fn"))
    p = E.prf(c("tp"), c("fp"), c("fn"))
    return n.select("image_id", p["precision"].alias("precision"), p["recall"].alias("recall"), F.round(p["f1"], 12).alias("f1"))


def _pairs(t):
    return M.match_points(t("suggestions"), t("marks"), IMG, F.lit(20.0), "suggestion_id", "annotation_id")


@query("agg12_centre_error", """WITH d AS (SELECT s.image_id, sqrt((s.x - m.x) * (s.x - m.x) + (s.y - m.y) * (s.y - m.y)) AS d FROM suggestions s JOIN marks m ON m.annotation_id = s.suggestion_id)
SELECT image_id, round(avg(d), 9) AS mean, list_sort(list(d))[1 + CAST(floor(count(*) / 2) AS BIGINT)] AS median FROM d GROUP BY 1""")
def _(t):
    from petrigrid.plans.grid import distance

    m = t("marks").select(c("annotation_id").alias("suggestion_id"), c("x").alias("mx"), c("y").alias("my"))
    d = t("suggestions").join(m, "suggestion_id").select("image_id", distance(c("x"), c("y"), c("mx"), c("my")).alias("d"))
    return E.centre_error(d, IMG).withColumn("mean", F.round("mean", 9))


@query("agg13_duplicate_rate", f"""WITH {folds.matched('m', 'suggestions', 'marks', '20.0::DOUBLE')},
f AS (SELECT s.image_id, s.suggestion_id FROM suggestions s WHERE s.suggestion_id NOT IN (SELECT p FROM m) AND EXISTS (SELECT 1 FROM marks t WHERE t.image_id = s.image_id AND t.annotation_id IN (SELECT g FROM m) AND {folds.distance('s', 't')} <= 20)),
n AS (SELECT image_id, count(*) AS n FROM suggestions GROUP BY 1), u AS (SELECT image_id, count(*) AS k FROM f GROUP BY 1) SELECT n.image_id, coalesce(k, 0) AS duplicates, coalesce(k, 0)::DOUBLE / n::DOUBLE AS duplicate_rate FROM n LEFT JOIN u ON u.image_id = n.image_id""")
def _(t):
    return E.duplicate_rate(t("suggestions"), t("marks"), _pairs(t), IMG, F.lit(20.0), "suggestion_id", "annotation_id")


@query("agg14_cluster_errors", """WITH g AS (SELECT image_id, CAST(floor(x / 200) AS BIGINT) * 20 + CAST(floor(y / 200) AS BIGINT) AS label, count(*) AS n FROM marks GROUP BY 1, 2 HAVING label <> 0),
p AS (SELECT image_id, CAST(floor(x / 200) AS BIGINT) * 20 + CAST(floor(y / 200) AS BIGINT) AS label, count(*) AS k FROM suggestions GROUP BY 1, 2 HAVING label <> 0),
j AS (SELECT coalesce(g.image_id, p.image_id) AS image_id, coalesce(n, 0) AS n, coalesce(k, 0) AS k FROM g FULL OUTER JOIN p ON g.image_id = p.image_id AND g.label = p.label)
SELECT image_id, CASE WHEN n = 0 THEN '0' WHEN n = 1 THEN '1' WHEN n = 2 THEN '2' WHEN n <= 5 THEN '3-5' WHEN n <= 20 THEN '6-20' ELSE '>20' END AS bin, count(*) AS clusters, CAST(sum(n) AS BIGINT) AS gt_colonies,
 round(avg(abs(k - n)), 9) AS mean_abs_error, count(*) FILTER (WHERE k = n) AS exact FROM j GROUP BY 1, 2""")
def _(t):
    lab = lambda df: df.select("image_id", (F.floor(c("x") / 200) * 20 + F.floor(c("y") / 200)).alias("label"))
    return E.cluster_errors(lab(t("marks")), lab(t("suggestions")), IMG).withColumn("mean_abs_error", F.round("mean_abs_error", 9))


@query("agg15_spread", """SELECT image_id, round(avg(r), 9) AS mean, round(coalesce(stddev_samp(r), 0), 9) AS sd, min(r) AS min, max(r) AS max FROM marks GROUP BY 1""")
def _(t):
    return E.spread(t("marks"), IMG, "r").select("image_id", F.round("mean", 9).alias("mean"), F.round("sd", 9).alias("sd"), "min", "max")


@query("agg16_multi_radius", f"""WITH given AS (SELECT image_id, annotation_id AS given_id, x, y FROM marks WHERE origin = 'manual' AND annotation_id % 60 = 0), typ AS (SELECT image_id, avg(r) AS r_typ FROM marks GROUP BY 1), gt AS (SELECT m.*, r_typ FROM marks m JOIN typ ON typ.image_id = m.image_id),
{folds.matched('q', 'given', 'gt', 'b.r_typ * 0.5::DOUBLE', 'given_id')}, fs AS (SELECT unnest([0.6::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE]) AS factor), p AS (SELECT image_id, factor, suggestion_id, x, y FROM suggestions, fs), g AS (SELECT image_id, factor, annotation_id, x, y, r_typ FROM gt, fs WHERE annotation_id NOT IN (SELECT g FROM q)),
{folds.matched('m', 'p', 'g', 'b.factor * b.r_typ', keys='image_id, factor')} {folds.counts('p', 'g', 'm', 'image_id, factor')}""")
def _(t):
    given = t("marks").where(C.manual()).where("annotation_id % 60 = 0").select("image_id", c("annotation_id").alias("given_id"), "x", "y")
    typ = t("marks").groupBy("image_id").agg(F.avg("r").alias("r_typ"))
    return E.ground_truth_metrics(t("suggestions").select("image_id", "suggestion_id", "x", "y"), t("marks").select("image_id", "annotation_id", "x", "y"), given, typ, IMG)


@query("agg17_review_share", """WITH f AS (SELECT image_id, cluster_id FROM clusters WHERE status = 'review' UNION SELECT image_id, cluster_id FROM suggestions WHERE status = 'review'),
p AS (SELECT s.image_id, s.cluster_id, count(*) AS n, f.cluster_id IS NOT NULL AS hit FROM suggestions s LEFT JOIN f ON f.image_id = s.image_id AND f.cluster_id = s.cluster_id GROUP BY 1, 2, 4)
SELECT image_id, coalesce(sum(n) FILTER (WHERE hit), 0)::DOUBLE / sum(n)::DOUBLE AS share, count(*) FILTER (WHERE hit) AS regions, coalesce(max(n) FILTER (WHERE hit), 0) AS largest FROM p GROUP BY 1""")
def _(t):
    return E.review_share(t("suggestions"), t("clusters"), IMG)


@query("agg18_under_split", f"""WITH k AS (SELECT image_id, cluster_id, area, chosen_k, chosen_k % 2 AS fixed, {math.pi!r}::DOUBLE * 10 * 10 AS a0 FROM clusters WHERE status <> 'too-large')
SELECT image_id, cluster_id, area >= 1.8::DOUBLE * a0 * greatest(1, chosen_k + fixed) AS suspect, area >= (chosen_k + fixed + 1) * a0 AS strict FROM k WHERE area >= 1.8::DOUBLE * a0 * greatest(1, chosen_k + fixed) OR area >= (chosen_k + fixed + 1) * a0""")
def _(t):
    k = t("clusters").withColumn("fixed", c("chosen_k") % 2)
    return E.under_split(k, 10.0).select("image_id", "cluster_id", "suspect", "strict")


@query("agg19_agreement", f"""WITH s AS (SELECT image_id, suggestion_id, x, y, 'fitter' AS method FROM suggestions UNION ALL SELECT image_id, suggestion_id, x + 2, y, 'log' FROM suggestions WHERE suggestion_id % 4 <> 0 UNION ALL SELECT image_id, suggestion_id, x, y - 3, 'watershed' FROM suggestions WHERE suggestion_id % 3 <> 0),
w AS (SELECT a.method AS method_a, b.method AS method_b FROM (SELECT DISTINCT method FROM s) a JOIN (SELECT DISTINCT method FROM s) b ON a.method < b.method),
p AS (SELECT image_id, method_a, method_b, suggestion_id AS a_id, x, y FROM s JOIN w ON method = method_a), g AS (SELECT image_id, method_a, method_b, suggestion_id AS b_id, x, y FROM s JOIN w ON method = method_b),
{folds.matched('m', 'p', 'g', '12.0::DOUBLE', 'a_id', 'b_id', 'image_id, method_a, method_b')}
SELECT image_id, method_a, method_b, round(f1, 2) AS f1 FROM ({folds.counts('p', 'g', 'm', 'image_id, method_a, method_b')})""")
def _(t):
    s = t("suggestions").select("image_id", "suggestion_id", "x", "y")
    methods = s.withColumn("method", F.lit("fitter")).unionByName(s.where("suggestion_id % 4 <> 0").withColumns({"method": F.lit("log"), "x": c("x") + 2}))
    methods = methods.unionByName(s.where("suggestion_id % 3 <> 0").withColumns({"method": F.lit("watershed"), "y": c("y") - 3}))
    return E.agreement(methods, IMG, 12.0)


_BOXES = "SELECT s_suppkey AS box_id, s_suppkey AS image_id, CAST(500 AS DOUBLE) AS bx, CAST(400 AS DOUBLE) AS by_, CAST(1600 AS DOUBLE) AS w, CAST(1200 AS DOUBLE) AS h, 20 + s_suppkey % 30 AS expected FROM supplier"
_IN = "x >= bx AND y >= by_ AND x < bx + w AND y < by_ + h"


@query("agg20_box_counts", f"""WITH b AS ({_BOXES}), s AS (SELECT box_id, count(*) AS n, count(*) FILTER (WHERE status = 'review') AS rv FROM b JOIN suggestions q ON q.image_id = b.image_id AND {_IN} GROUP BY 1),
m AS (SELECT box_id, count(*) AS n FROM b JOIN marks q ON q.image_id = b.image_id AND {_IN} AND q.origin = 'manual' GROUP BY 1)
SELECT b.box_id, b.expected, coalesce(s.n, 0) AS suggestions, coalesce(m.n, 0) AS seeds, coalesce(s.rv, 0) AS review, coalesce(s.n, 0) + coalesce(m.n, 0) AS total,
 round((coalesce(s.n, 0) + coalesce(m.n, 0) - b.expected) / b.expected::DOUBLE, 9) AS deviation, abs((coalesce(s.n, 0) + coalesce(m.n, 0) - b.expected) / b.expected::DOUBLE) <= 0.25 AS ok
FROM b LEFT JOIN s ON s.box_id = b.box_id LEFT JOIN m ON m.box_id = b.box_id""")
def _(t):
    b = t.sql(_BOXES).withColumnRenamed("by_", "by")
    return E.box_counts(t("suggestions"), t("marks").where(C.manual()), b, 0.25).withColumn("deviation", F.round("deviation", 9))


@query("agg23_accept_statistics", """SELECT 'run' || CAST(image_id % 7 AS VARCHAR) AS run_id, count(*) FILTER (WHERE suggestion_id % 3 = 0) AS accepted, count(*) FILTER (WHERE suggestion_id % 3 = 1) AS duplicates, count(*) FILTER (WHERE suggestion_id % 3 = 2) AS rejected FROM suggestions GROUP BY 1""")
def _(t):
    m = c("suggestion_id") % 3
    d = t("suggestions").select(F.concat(F.lit("run"), (c("image_id") % 7).cast("string")).alias("run_id"), F.when(m == 0, "accepted").when(m == 1, "duplicate").otherwise("rejected").alias("outcome"))
    return E.accept_statistics(d)


@query("agg24_reproducibility", """WITH a AS (SELECT image_id, list(suggestion_id || ':' || score ORDER BY suggestion_id) AS k FROM suggestions GROUP BY 1), b AS (SELECT image_id, list(suggestion_id || ':' || score ORDER BY suggestion_id) AS k FROM suggestions WHERE image_id % 4 <> 2 OR suggestion_id % 9 <> 1 GROUP BY 1)
SELECT coalesce(a.image_id, b.image_id) AS image_id, a.k IS NOT DISTINCT FROM b.k AS identical FROM a FULL OUTER JOIN b ON a.image_id = b.image_id""")
def _(t):
    s = t("suggestions")
    return E.same_result(s, s.where("image_id % 4 <> 2 or suggestion_id % 9 <> 1"), IMG)


# ---------------------------------------------------------------- robust statistics


@query("sta1_quantiles", "SELECT plane_id, round(median(v), 9) AS median, round(quantile_cont(v, 0.9), 9) AS p90, round(quantile_cont(v, 0.25), 9) AS p25, min(v) AS lowest FROM planes GROUP BY 1")
def _(t):
    q = R.exact_quantiles(t("planes"), ["plane_id"], "v", {"median": 0.5, "p90": 0.9, "p25": 0.25, "lowest": 0.0})
    return q.select("plane_id", *[F.round(x, 9).alias(x) for x in ("median", "p90", "p25")], "lowest")


@query("sta2_scaled_mad", """WITH m AS (SELECT plane_id, median(v) AS med FROM planes GROUP BY 1) SELECT p.plane_id, round(min(med), 9) AS median, round(1.4826::DOUBLE * median(abs(v - med)), 9) AS mad FROM planes p JOIN m ON m.plane_id = p.plane_id GROUP BY 1""")
def _(t):
    return R.scaled_mad(t("planes"), ["plane_id"], "v").select("plane_id", F.round("median", 9).alias("median"), F.round("mad", 9).alias("mad"))


def _wm(src, keys, v, w, out):
    k = ", ".join(keys)
    on = " AND ".join(f"a.{x} = z.{x}" for x in keys)
    return f"""(SELECT {', '.join('a.' + x for x in keys)}, CASE WHEN any_value(z.exact) AND any_value(z.nxt) IS NOT NULL THEN (any_value(z.v) + any_value(z.nxt)) / 2 ELSE any_value(z.v) END AS {out} FROM {src} a JOIN
 (SELECT {k}, arg_min(v, v) FILTER (WHERE acc >= half - 1e-12) AS v, arg_min(abs(acc - half) < 1e-12, v) FILTER (WHERE acc >= half - 1e-12) AS exact, min(v) FILTER (WHERE acc > half + 1e-12) AS nxt FROM
  (SELECT {k}, {v} AS v, sum({w}) OVER (PARTITION BY {k} ORDER BY {v} RANGE UNBOUNDED PRECEDING) AS acc, sum({w}) OVER (PARTITION BY {k}) / 2 AS half FROM {src}) GROUP BY {k}) z ON {on} GROUP BY {', '.join('a.' + x for x in keys)})"""


_SEEDS = """SELECT image_id, group_id, annotation_id, r + CAST(annotation_id % 7 AS DOUBLE) / 8 AS r, CASE annotation_id % 3 WHEN 0 THEN CAST(1 AS DOUBLE) WHEN 1 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS w FROM annotations WHERE annotation_id % 2 = 0"""
_PRIOR = f"""sd AS (SELECT *, ln(r) AS z FROM ({_SEEDS}) WHERE w > 0), mu AS {_wm('sd', ['image_id', 'group_id'], 'z', 'w', 'mu')},
dv AS (SELECT sd.*, abs(z - mu) AS dev, mu FROM sd JOIN mu ON mu.image_id = sd.image_id AND mu.group_id = sd.group_id), sp AS {_wm('dv', ['image_id', 'group_id'], 'dev', 'w', 'm')},
nn AS (SELECT image_id, group_id, sum(w) AS n_eff, count(*) AS k FROM sd GROUP BY 1, 2),
prior AS (SELECT mu.image_id, mu.group_id, mu.mu, greatest(0.25::DOUBLE, CASE WHEN k > 1 THEN 1.4826 * m ELSE 0 END) * sqrt(1 + 1 / n_eff) AS s, n_eff AS n, k FROM mu JOIN sp USING (image_id, group_id) JOIN nn USING (image_id, group_id))"""
GRP = ["image_id", "group_id"]


@query("sta3_weighted_median", f"WITH sd AS (SELECT * FROM ({_SEEDS}) WHERE w > 0) SELECT image_id, group_id, round(wm, 9) AS wmedian FROM {_wm('sd', GRP, 'r', 'w', 'wm')}")
def _(t):
    return R.weighted_median(t.sql(_SEEDS).where("w > 0"), GRP, "r", "w").select(*GRP, F.round("wmedian", 9).alias("wmedian"))


@query("sta4_radius_prior", f"WITH {_PRIOR} SELECT image_id, group_id, round(mu, 6) AS mu, round(s, 6) AS s, round(n, 2) AS n, round(exp(mu), 6) AS r_median, round(exp(mu - 2 * s), 6) AS r_lo, round(exp(mu + 2 * s), 6) AS r_hi FROM prior")
def _(t):
    p = R.radius_prior(t.sql(_SEEDS), GRP)
    return p.select(*GRP, *[r6(x).alias(x) for x in ("mu", "s", "n", "r_median", "r_lo", "r_hi")])


@query("sta5_robust_range", """WITH m AS (SELECT plane_id, median(v) AS med, count(*) AS n FROM planes GROUP BY 1) SELECT p.plane_id, round(min(med), 9) AS median, round(greatest(1.4826::DOUBLE * median(abs(v - med)), 0.35), 9) AS scale FROM planes p JOIN m ON m.plane_id = p.plane_id GROUP BY 1""")
def _(t):
    return R.robust_range(t("planes"), ["plane_id"], "v", F.lit(0.35)).select("plane_id", F.round("median", 9).alias("median"), F.round("scale", 9).alias("scale"))


_MEAS = """SELECT annotation_id, image_id, CASE WHEN annotation_id % 19 = 0 THEN NULL ELSE r END AS r, CASE WHEN annotation_id % 23 = 0 THEN NULL ELSE r * (0.8 + CAST(annotation_id % 12 AS DOUBLE) / 10) END AS r_edge,
 CAST(annotation_id % 31 AS DOUBLE) / 3 AS snr, CAST(annotation_id % 13 AS DOUBLE) / 30 AS cv, CAST(annotation_id % 17 AS DOUBLE) / 20 AS blocked_frac, CAST(annotation_id % 5 AS DOUBLE) / 20 AS seam_frac,
 CAST(annotation_id % 33 AS INT) AS n_rays, CAST(annotation_id % 29 AS DOUBLE) / 90 AS saturated_frac, annotation_id % 37 = 0 AS dip, CAST(annotation_id % 41 AS DOUBLE) - 1 AS edge_clearance,
 CAST(annotation_id % 53 AS DOUBLE) + 5 AS contrast, CAST(annotation_id % 11 AS DOUBLE) / 10 AS sharpness FROM annotations"""
_QUAL = """CASE WHEN edge_clearance < 1 THEN 'edge' WHEN saturated_frac > 0.25 OR dip THEN 'glare' WHEN r IS NULL THEN CASE WHEN blocked_frac > 0.5 AND snr >= 4 THEN 'touching' ELSE 'weak' END
 WHEN blocked_frac + seam_frac >= 0.3 THEN 'touching' WHEN snr < 4 OR cv > 0.3 THEN 'weak' WHEN r_edge IS NOT NULL AND abs(ln(r_edge / r)) > 0.5 THEN 'weak' ELSE 'ok' END"""


@query("sta6_seed_quality", f"""SELECT annotation_id, quality, CASE WHEN r IS NULL THEN 0 WHEN quality = 'ok' THEN 1 WHEN quality = 'touching' AND blocked_frac <= 0.5 AND n_rays >= 32 / 3.0::DOUBLE AND snr >= 4 AND cv <= 0.35 THEN 0.6 ELSE 0 END::DOUBLE AS weight
FROM (SELECT *, {_QUAL} AS quality FROM ({_MEAS.replace("0.8 +", "0.8::DOUBLE +")}))""")
def _(t):
    return t.sql(_MEAS.replace("(0.8 ", "(0.8D ")).select("annotation_id", G.seed_quality().alias("quality"), G.seed_weight().alias("weight"))


@query("sta7_calibration_summary", f"""WITH {_PRIOR}, n AS (SELECT image_id, group_id, count(*) AS total, count(*) FILTER (WHERE w > 0) AS usable, min(r) FILTER (WHERE w > 0) AS lo, max(r) FILTER (WHERE w > 0) AS hi FROM ({_SEEDS}) GROUP BY 1, 2)
SELECT n.image_id, n.group_id, 'seeds=' || total || ' usable=' || usable AS summary, usable < 3 AS tentative,
 (CASE WHEN usable = 0 THEN 1 ELSE 0 END + CASE WHEN usable > 0 AND usable < 3 THEN 1 ELSE 0 END + CASE WHEN p.n >= 3 AND exp(p.s) - 1 < 0.15 THEN 1 ELSE 0 END + CASE WHEN usable >= 2 AND hi / lo >= 1.8 THEN 1 ELSE 0 END) AS warnings
FROM n LEFT JOIN prior p ON p.image_id = n.image_id AND p.group_id = n.group_id""")
def _(t):
    s = t.sql(_SEEDS)
    out = R.calibration_summary(s, GRP, R.radius_prior(s, GRP))
    return out.select(*GRP, "summary", "tentative", F.size("warnings").alias("warnings"))


@query("sta8_fallback_prior", f"""WITH {_PRIOR}, any_ AS (SELECT image_id, median(ln(r)) AS z FROM marks WHERE image_id % 3 <> 0 GROUP BY 1), pr AS (SELECT image_id, mu, s FROM prior WHERE group_id = 'F' AND image_id % 2 = 0),
q AS (SELECT i.image_id, CASE WHEN pr.mu IS NOT NULL THEN 'prior' WHEN a.z IS NOT NULL THEN 'touching' ELSE 'guess' END AS source, coalesce(pr.mu + ln(0.5), a.z + ln(0.5), ln(greatest(3::DOUBLE, 0.008 * 1500))) AS log_r,
 CASE WHEN pr.mu IS NOT NULL THEN pr.s WHEN a.z IS NOT NULL THEN 0.4::DOUBLE ELSE 0.6::DOUBLE END AS s FROM images i LEFT JOIN pr ON pr.image_id = i.image_id LEFT JOIN any_ a ON a.image_id = i.image_id)
SELECT image_id, source, round(log_r, 6) AS log_r, round(s, 6) AS s, round(exp(log_r + 2 * s), 5) AS r_hi FROM q""")
def _(t):
    pr = R.radius_prior(t.sql(_SEEDS).where("group_id = 'F' and image_id % 2 = 0"), IMG)
    images = t("images").select("image_id", F.lit(0.5).alias("scale"), F.lit(1500.0).alias("plate_diameter"))
    out = R.fallback_prior(images, pr, t("marks").where("image_id % 3 <> 0"), IMG)
    return out.select("image_id", "source", r6("log_r").alias("log_r"), r6("s").alias("s"), F.round("r_hi", 5).alias("r_hi"))


_SHIFT = """CASE WHEN abs(d) > s / 2 THEN {lr} + d * t * t * (3 - 2 * t) * least(8, n) / (least(8, n) + 0.5) END"""


@query("sta9_shift_prior", f"""WITH q AS (SELECT p_partkey, ln(CAST(5 + p_size % 20 AS DOUBLE)) - ln(10::DOUBLE) AS d, 0.3::DOUBLE AS s, CAST(1 + p_partkey % 12 AS DOUBLE) AS n FROM part), t AS (SELECT *, least(1::DOUBLE, (abs(d) - s / 2) / (s / 2)) AS t FROM q)
SELECT p_partkey, round({_SHIFT.format(lr='ln(10::DOUBLE)')}, 6) AS log_r, round(CASE WHEN abs(d) > s / 2 THEN greatest(s, abs(d) / 2) END, 6) AS s FROM t""")
def _(t):
    p = G.shift_prior(F.log(F.lit(10.0)), F.lit(0.3), F.log((5 + c("p_size") % 20).cast("double")), 1 + c("p_partkey") % 12, 0)
    return t("part").withColumn("p", p).select("p_partkey", r6(c("p.log_r")).alias("log_r"), r6(c("p.s")).alias("s"))


def _cl_shift(local, n, sign=""):
    d = f"({local} - log_r)"
    t = f"least(1::DOUBLE, (abs({d}) - s / 2) / (s / 2))"
    cond = f"abs({d}) > s / 2" + (f" AND {d} > 0" if sign else "")
    return f"CASE WHEN {cond} THEN log_r + {d} * {t} * {t} * (3 - 2 * {t}) * least(8, {n}) / (least(8, {n}) + 0.5) END"


@query("sta10_cluster_priors", f"""WITH cl AS (SELECT image_id, cluster_id, CAST(area AS DOUBLE) AS area, ln(14::DOUBLE) AS log_r, 0.3::DOUBLE AS s FROM clusters),
col AS (SELECT image_id, cluster_id, r, CASE WHEN suggestion_id % 3 = 0 THEN 0.6 ELSE 1 END AS weight, CAST(suggestion_id % 10 AS DOUBLE) / 100 AS cv FROM suggestions),
mk AS (SELECT image_id, cluster_id, r FROM suggestions WHERE suggestion_id % 7 = 2 AND image_id % 2 = 0),
m AS (SELECT image_id, cluster_id, median(ln(r)) AS med, count(*) AS n FROM mk GROUP BY 1, 2), nc AS (SELECT image_id, cluster_id, count(*) AS n, count(*) FILTER (WHERE weight >= 1 AND cv <= 0.06) AS nr, median(ln(r)) FILTER (WHERE weight >= 1 AND cv <= 0.06) AS med FROM col GROUP BY 1, 2),
cr AS (SELECT *, area >= 2 * {math.pi!r}::DOUBLE * exp(log_r) * exp(log_r) AS crowded FROM cl), pool AS (SELECT mk.image_id, median(ln(r)) AS med, count(*) AS n FROM mk JOIN cr ON cr.image_id = mk.image_id AND cr.cluster_id = mk.cluster_id WHERE crowded GROUP BY 1),
j AS (SELECT cr.*, m.med AS mm, m.n AS mn, nc.n AS cn, nc.nr AS rn, nc.med AS rm, pool.med AS pm, pool.n AS pn FROM cr LEFT JOIN m ON m.image_id = cr.image_id AND m.cluster_id = cr.cluster_id LEFT JOIN nc ON nc.image_id = cr.image_id AND nc.cluster_id = cr.cluster_id LEFT JOIN pool ON pool.image_id = cr.image_id),
k AS (SELECT image_id, cluster_id, log_r, CASE WHEN mn IS NOT NULL THEN {_cl_shift('mm', '3 * mn')} ELSE coalesce(CASE WHEN rn > 0 AND rn >= 0.3 * cn THEN {_cl_shift('rm', '3 * rn', '+')} END, CASE WHEN crowded AND pn >= 2 THEN {_cl_shift('pm', '3 * pn')} END) END AS moved FROM j)
SELECT image_id, cluster_id, round(coalesce(moved, log_r), 6) AS log_r, moved IS NOT NULL AS adapted FROM k""")
def _(t):
    s = t("suggestions")
    cl = t("clusters").select("image_id", "cluster_id", "area")
    col = s.select("image_id", "cluster_id", "r", F.when(c("suggestion_id") % 3 == 0, 0.6).otherwise(1.0).alias("weight"), ((c("suggestion_id") % 10) / 100).alias("cv"))
    mk = s.where("suggestion_id % 7 = 2 and image_id % 2 = 0").select("image_id", "cluster_id", "r")
    pr = t("images").select("image_id", F.log(F.lit(14.0)).alias("log_r"), F.lit(0.3).alias("s"))
    return R.cluster_priors(cl, col, mk, pr, IMG).select("image_id", "cluster_id", r6("log_r").alias("log_r"), "adapted")


@query("sta11_appearance", f"""WITH q AS (SELECT *, CASE WHEN r IS NULL THEN 0 WHEN quality = 'ok' THEN 1 WHEN quality = 'touching' AND blocked_frac <= 0.5 AND n_rays >= 32 / 3.0::DOUBLE AND snr >= 4 AND cv <= 0.35 THEN 0.6 ELSE 0 END AS w FROM (SELECT *, {_QUAL} AS quality FROM ({_MEAS}))),
u AS (SELECT image_id, median(contrast) AS cm, median(snr) AS sm, count(*) AS n FROM q WHERE w > 0 GROUP BY 1), a AS (SELECT image_id, median(contrast) AS am FROM q WHERE snr >= 3 GROUP BY 1),
d AS (SELECT q.image_id, 1.4826::DOUBLE * median(abs(contrast - cm)) AS cmad, 1.4826::DOUBLE * median(abs(snr - sm)) AS smad FROM q JOIN u ON u.image_id = q.image_id WHERE w > 0 GROUP BY 1),
z AS (SELECT i.image_id, coalesce(cm, am, 8 * 0.7::DOUBLE) AS ref, cm, sm, n, CASE WHEN n > 1 THEN cmad ELSE 0 END AS cmad, CASE WHEN n > 1 THEN smad ELSE 0 END AS smad FROM images i LEFT JOIN u ON u.image_id = i.image_id LEFT JOIN a ON a.image_id = i.image_id LEFT JOIN d ON d.image_id = i.image_id)
SELECT image_id, round(ref, 6) AS contrast_ref, round(CASE WHEN cm IS NOT NULL THEN greatest(cmad, 0.15 * ref) END, 6) AS contrast_scale, round(sm, 6) AS snr_median, round(CASE WHEN cm IS NOT NULL THEN greatest(smad, 1) END, 6) AS snr_scale,
 round(least(0.5, greatest(0.25, (coalesce(cm, ref) - 3 * CASE WHEN cm IS NULL THEN 0.15 * ref ELSE greatest(cmad, 0.15 * ref) END) / ref)), 6)::DOUBLE AS contrast_lo FROM z""")
def _(t):
    m = t.sql(_MEAS.replace("(0.8 ", "(0.8D ")).withColumn("w", G.seed_weight())
    noise = t("images").select("image_id", F.lit(0.7).alias("noise"))
    out = R.appearance_ranges(m, IMG, noise)
    return out.select("image_id", *[r6(x).alias(x) for x in ("contrast_ref", "contrast_scale", "snr_median", "snr_scale", "contrast_lo")])


@query("sta12_colour_axis", """WITH m AS (SELECT image_id, median(r - 100.0) AS l, median(g - b + 0.0) AS a, median(b - 127.5) AS b FROM pixels GROUP BY 1), n AS (SELECT *, sqrt(l * l + a * a + b * b) AS n FROM m)
SELECT image_id, round(l / n, 6) AS axis_l, round(a / n, 6) AS axis_a, round(b / n, 6) AS axis_b, CASE WHEN l >= 0 THEN 1 ELSE -1 END AS polarity FROM n""".replace("100.0", "100.0::DOUBLE").replace("0.0)", "0.0::DOUBLE)").replace("127.5", "127.5::DOUBLE"))
def _(t):
    d = t("pixels").select("image_id", (c("r") - 100.0).alias("l"), (c("g") - c("b") + 0.0).alias("a"), (c("b") - 127.5).alias("b"))
    out = R.colour_axis(d, IMG)
    return out.select("image_id", *[r6(x).alias(x) for x in ("axis_l", "axis_a", "axis_b")], "polarity")


@query("sta13_typical_radius", """WITH m AS (SELECT image_id, list_sort(list(r))[1 + CAST(floor(count(*) / 2) AS BIGINT)] AS med FROM suggestions WHERE image_id % 5 <> 1 GROUP BY 1)
SELECT i.image_id, coalesce(CASE WHEN i.image_id % 3 = 0 THEN 11.5::DOUBLE END, m.med, 20::DOUBLE) AS r_typ FROM images i LEFT JOIN m ON m.image_id = i.image_id""")
def _(t):
    pr = t("images").select("image_id", F.when(c("image_id") % 3 == 0, 11.5).alias("r_median"))
    return E.typical_radius(pr, t("suggestions").where("image_id % 5 <> 1"), IMG, 20.0)


@query("sta14_strided", """SELECT plane_id, y, x FROM (SELECT *, row_number() OVER (PARTITION BY plane_id ORDER BY y * 64 + x) - 1 AS k, greatest(1, CAST(floor(count(*) OVER (PARTITION BY plane_id) / 500) AS BIGINT)) AS step FROM planes WHERE v > 0) WHERE k % step = 0""")
def _(t):
    p = t("planes").where("v > 0").withColumn("at", c("y") * 64 + c("x"))
    return R.strided(p, ["plane_id"], "at", 500).select("plane_id", "y", "x")


@query("sam1_seeded_sample", """SELECT image_id, annotation_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY sha256('7:' || image_id || ':' || annotation_id), annotation_id) AS rn FROM marks WHERE origin = 'manual') WHERE rn <= 4""")
def _(t):
    return E.seeded_sample(t("marks").where(C.manual()), IMG, "annotation_id", 4, "7").select("image_id", "annotation_id")


@query("sam1_resampled_spread", """WITH r AS (SELECT m.*, run FROM marks m JOIN (SELECT unnest(generate_series(0, 5)) AS run) ON TRUE WHERE origin = 'manual'),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, run ORDER BY sha256('resample:' || image_id || ':' || run || ':' || annotation_id), annotation_id) AS rn FROM r) WHERE rn <= 4), a AS (SELECT image_id, run, avg(r) AS v FROM s GROUP BY 1, 2)
SELECT image_id, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS sd, min(v) AS min, max(v) AS max FROM a GROUP BY 1""")
def _(t):
    s = E.resamples(t("marks").where(C.manual()), IMG, "annotation_id", 4, 6).groupBy("image_id", "run").agg(F.avg("r").alias("v"))
    return E.spread(s, IMG, "v").select("image_id", r6("mean").alias("mean"), r6("sd").alias("sd"), "min", "max")


@query("sam2_click_jitter")
def _(t):
    return E.jitter(t("marks").select("annotation_id", "x", "y"), "annotation_id", 3.0)


# ---------------------------------------------------------------- fits

_ARC = """SELECT image_id, CAST(1000 + r * 40 * cos(annotation_id % 63 / 10.0) + annotation_id % 5 AS DOUBLE) AS x, CAST(900 + r * 40 * sin(annotation_id % 63 / 10.0) - annotation_id % 3 AS DOUBLE) AS y, annotation_id FROM annotations"""
_ARC_SPARK = _ARC.replace("10.0", "10.0D")
_ARC_DUCK = _ARC.replace("10.0", "10.0::DOUBLE")


def _circle(points: str) -> str:
    """Regression of the squared norm on the coordinates."""
    return f"""SELECT image_id, n, cx, cy, sqrt(pow(mx - cx, 2) + pow(my - cy, 2) + xx + yy) AS cr FROM (SELECT *, (xq * yy - yq * xy) / (2 * (xx * yy - xy * xy)) AS cx, (yq * xx - xq * xy) / (2 * (xx * yy - xy * xy)) AS cy
 FROM (SELECT image_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, x * x + y * y) AS xq, covar_pop(y, x * x + y * y) AS yq FROM {points} GROUP BY 1) WHERE n >= 3 AND n * n * (xx * yy - xy * xy) >= 1e-9)"""


_KASA = f"p AS ({_ARC_DUCK}), fit AS ({_circle('p')})"


def _refined(points: str, first: str, rounds: int = 10) -> str:
    """Rounds of the centre's regression on the unit vectors, as chained CTEs that end in r<rounds>."""
    out = [f"r0 AS MATERIALIZED (SELECT image_id, cx, cy, cr, TRUE AS live FROM {first})"]
    for k in range(1, rounds + 1):
        out.append(f"""u{k} AS (SELECT p.image_id, greatest(d, 0) AS d, (cx - x) / d AS u, (cy - y) / d AS v FROM (SELECT *, CASE WHEN sqrt(pow(x - cx, 2) + pow(y - cy, 2)) = 0 THEN 1e-9::DOUBLE ELSE sqrt(pow(x - cx, 2) + pow(y - cy, 2)) END AS d FROM {points} AS a JOIN r{k - 1} AS b USING (image_id) WHERE live) AS p),
g{k} AS (SELECT *, uu * vv - uv * uv AS w FROM (SELECT image_id, count(*) AS n, avg(d) AS md, avg(u) AS mu, avg(v) AS mv, var_pop(u) AS uu, var_pop(v) AS vv, covar_pop(u, v) AS uv, covar_pop(u, d) AS ud, covar_pop(v, d) AS vd FROM u{k} GROUP BY 1)),
s{k} AS (SELECT image_id, su, sv, md - mu * su - mv * sv AS nr FROM (SELECT *, (ud * vv - vd * uv) / w AS su, (vd * uu - ud * uv) / w AS sv FROM g{k} WHERE pow(n, 3) * w >= 1e-12)),
r{k} AS MATERIALIZED (SELECT image_id, CASE WHEN live AND nr IS NOT NULL THEN cx - su ELSE cx END AS cx, CASE WHEN live AND nr IS NOT NULL THEN cy - sv ELSE cy END AS cy, CASE WHEN live AND nr IS NOT NULL THEN nr ELSE cr END AS cr, live AND nr IS NOT NULL AND abs(su) + abs(sv) + abs(nr - cr) >= 1e-4 AS live FROM r{k - 1} LEFT JOIN s{k} USING (image_id))""")
    return ",\n".join(out)


_ROUND4 = "round(cx, 4) AS cx, round(cy, 4) AS cy, round(cr, 4) AS cr"


def _near(k: int, source: str) -> str:
    return f"""n{k} AS (SELECT a.* FROM p AS a JOIN {source} AS b USING (image_id) WHERE abs(sqrt(pow(x - cx, 2) + pow(y - cy, 2)) - cr) <= greatest(1::DOUBLE, cr * 0.15)),
f{k} AS ({_circle(f'n{k}')}), c{k} AS MATERIALIZED (SELECT b.image_id, coalesce(f.cx, b.cx) AS cx, coalesce(f.cy, b.cy) AS cy, coalesce(f.cr, b.cr) AS cr FROM {source} AS b LEFT JOIN (SELECT * FROM f{k} WHERE n >= 8) AS f USING (image_id))"""


def _round4(f):
    return f.select("image_id", *[F.round(x, 4).alias(x) for x in ("cx", "cy", "cr")])


@query("fit1_kasa", f"WITH {_KASA} SELECT image_id, round(cx, 4) AS cx, round(cy, 4) AS cy, round(cr, 4) AS cr FROM fit")
def _(t):
    return _round4(FT.fit_circles(t.sql(_ARC_SPARK), IMG))


@query("fit2_refined", f"WITH {_KASA}, {_refined('p', 'fit')} SELECT image_id, round(cx, 4) AS cx, round(cy, 4) AS cy, round(abs(cr), 4) AS cr FROM r10")
def _(t):
    p = t.sql(_ARC_SPARK)
    return _round4(FT.refine_circles(p, FT.fit_circles(p, IMG), IMG))


@query("fit3_residual_and_span", f"""WITH {_KASA}, res AS (SELECT p.image_id, sqrt(avg(pow(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) - cr, 2))) AS residual FROM p JOIN fit ON fit.image_id = p.image_id GROUP BY 1),
a AS (SELECT p.image_id, atan2(y - cy, x - cx) AS t FROM p JOIN fit ON fit.image_id = p.image_id), g AS (SELECT image_id, t, t - lag(t) OVER (PARTITION BY image_id ORDER BY t) AS gap FROM a),
sp AS (SELECT image_id, {2 * math.pi!r} - greatest(max(gap), min(t) + {2 * math.pi!r} - max(t)) AS span FROM g GROUP BY 1) SELECT res.image_id, round(residual, 4) AS residual, round(span, 4) AS span FROM res JOIN sp ON sp.image_id = res.image_id""")
def _(t):
    p = t.sql(_ARC_SPARK)
    f = FT.fit_circles(p, IMG)
    return FT.circle_residual(p, f, IMG).join(FT.arc_span(p, f, IMG), "image_id").select("image_id", F.round("residual", 4).alias("residual"), F.round("span", 4).alias("span"))


@query("fit4_consensus")
def _(t):
    return FT.consensus_circles(t.sql(_ARC_SPARK), IMG, "annotation_id", 3.0)


@query("fit5_recentred", f"""WITH p AS ({_ARC_DUCK}), half AS (SELECT * FROM p WHERE annotation_id % 2 = 0), c0 AS MATERIALIZED (SELECT image_id, cx, cy, cr FROM ({_circle('half')})), {_near(1, 'c0')}, {_near(2, 'c1')} SELECT image_id, {_ROUND4} FROM c2""")
def _(t):
    p = t.sql(_ARC_SPARK)
    return _round4(FT.recentre(p.where("annotation_id % 2 = 0"), p, IMG))
