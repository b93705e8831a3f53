"""Queries: scalar functions over the fixture views."""

from pyspark.sql import functions as F

from petrigrid.functions import colour as K
from petrigrid.functions import geometry as G
from petrigrid.functions import scoring as S
from petrigrid.functions import style as Y
from petrigrid.functions import text as X

from .registry import query

c = F.col


def r6(col):
    return F.round(col, 6)


@query("sca1_magic_bytes", """SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/bmp' WHEN 4 THEN 'image/tiff' WHEN 5 THEN 'image/avif' WHEN 6 THEN 'image/heic' WHEN 7 THEN 'image/webp' END AS mime FROM pages""")
def _(t):
    # page texts stand in for file contents: a format header chosen by page, then the page bytes
    heads = ["FFD8FF", "89504E47", "474946383961", "424D", "49492A00", "0000001C6674797061766966", "0000001C66747970686569630000", "52494646000000005745425056503820", "00"]
    h = F.element_at(F.array(*[F.lit(x) for x in heads]), (c("page_id") % len(heads) + 1).cast("int"))
    content = F.concat(F.unhex(h), F.encode(c("html"), "UTF-8"))
    return t("pages").select("page_id", X.sniff_mime(content).alias("mime"))


@query("sca2_extension", """SELECT p_partkey, CASE m WHEN 'image/jpeg' THEN 'jpg' WHEN 'image/png' THEN 'png' WHEN 'image/tiff' THEN 'tif' WHEN 'image/heif' THEN 'heif' ELSE 'bin' END AS ext
FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/tiff' WHEN 3 THEN 'image/heif' ELSE p_type END AS m FROM part)""")
def _(t):
    m = F.when(c("p_partkey") % 5 == 0, "image/jpeg").when(c("p_partkey") % 5 == 1, "image/png").when(c("p_partkey") % 5 == 2, "image/tiff").when(c("p_partkey") % 5 == 3, "image/heif").otherwise(c("p_type"))
    return t("part").select("p_partkey", X.extension_for(m).alias("ext"))


_NAMES = """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN '=SUM(' || o_orderpriority || ')' WHEN 1 THEN 'a "q" ' || o_orderstatus WHEN 2 THEN ' pad'
 WHEN 3 THEN o_orderpriority || ',x' WHEN 4 THEN '-' || o_orderstatus ELSE o_orderpriority END AS name FROM orders"""


@query("sca3_neutralise", f"SELECT id, CASE WHEN left(name, 1) IN ('=', '+', '-', '@') THEN '''' || name ELSE name END AS cell FROM ({_NAMES})")
def _(t):
    return t.sql(_NAMES).select("id", X.neutralise_formula(c("name")).alias("cell"))


@query("sca4_csv_row", f"""SELECT id, CASE WHEN s LIKE '%"%' OR s LIKE '%,%' OR s <> trim(s) THEN '"' || replace(s, '"', '""') || '"' ELSE s END || ',' || CAST(id AS VARCHAR) || ',' || CASE WHEN id % 2 = 0 THEN 'true' ELSE 'false' END AS line
FROM (SELECT id, CASE WHEN left(name, 1) IN ('=', '+', '-', '@') THEN '''' || name ELSE name END AS s FROM ({_NAMES}))""")
def _(t):
    return t.sql(_NAMES).select("id", X.csv_row([X.csv_text(c("name")), X.csv_number(c("id")), X.csv_boolean(c("id") % 2 == 0)]).alias("line"))


@query("sca5_content_key", "SELECT annotation_id, sha256(CAST(annotation_id AS VARCHAR) || ':' || group_id || ':' || origin) AS part_key FROM annotations")
def _(t):
    return t("annotations").select("annotation_id", X.content_key(c("annotation_id"), c("group_id"), c("origin")).alias("part_key"))


@query("sca6_digests", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def _(t):
    return t("documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


@query("sca7_versioned_projection", "SELECT project_id, project_name, storage_kind FROM projects")
def _(t):
    p = t("projects").select(F.struct("project_id", "project_name", "storage_kind", "revision", F.lit("now").alias("updated_at")).alias("doc"))
    return p.select(c("doc").dropFields("revision", "updated_at").alias("doc")).select("doc.*")


@query("sca8_style_clamps", """SELECT p_partkey, least(1.0::DOUBLE, greatest(0.1::DOUBLE, CAST(p_size - 10 AS DOUBLE) / 20)) AS opacity,
 least(24.0::DOUBLE, greatest(2.0::DOUBLE, CAST(floor(CAST(p_size AS DOUBLE) * 0.7::DOUBLE + 0.5::DOUBLE) AS DOUBLE))) AS size,
 least(32.0::DOUBLE, greatest(8.0::DOUBLE, CAST(floor(CAST(p_size AS DOUBLE) + 0.5::DOUBLE) AS DOUBLE))) AS label_size FROM part""")
def _(t):
    d = c("p_size").cast("double")
    return t("part").select("p_partkey", Y.clamp_opacity((c("p_size") - 10).cast("double") / 20).alias("opacity"), Y.clamp_size(d * 0.7).alias("size"), Y.clamp_label_size(d).alias("label_size"))


_HEX = "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '#D55E00' WHEN 1 THEN '#' || left(md5(p_name), 3) WHEN 2 THEN left(md5(p_brand), 6) WHEN 3 THEN '#f0e442' ELSE 'teal' END AS hex FROM part"
_LUM = " + ".join(
    f"{w} * CASE WHEN v{i} <= 0.03928 THEN v{i} / 12.92 ELSE pow((v{i} + 0.055) / 1.055, 2.4) END" for i, w in enumerate(("0.2126", "0.7152", "0.0722"))
)


@query("sca9_colours", f"""WITH h AS (SELECT p_partkey, hex, CASE WHEN regexp_matches(hex, '^#?([0-9a-fA-F]{{3}}|[0-9a-fA-F]{{6}})$') THEN replace(hex, '#', '') END AS d FROM ({_HEX})),
s AS (SELECT p_partkey, hex, CASE WHEN length(d) = 3 THEN d[1] || d[1] || d[2] || d[2] || d[3] || d[3] ELSE d END AS d FROM h),
v AS (SELECT *, CAST(CAST('0x' || d[1:2] AS INT) AS DOUBLE) / 255 AS v0, CAST(CAST('0x' || d[3:4] AS INT) AS DOUBLE) / 255 AS v1, CAST(CAST('0x' || d[5:6] AS INT) AS DOUBLE) / 255 AS v2 FROM s),
l AS (SELECT p_partkey, hex, CASE WHEN d IS NULL THEN 0.5::DOUBLE ELSE {_LUM} END AS lum FROM v)
SELECT p_partkey, CASE lower(hex) WHEN '#d55e00' THEN 'Vermilion' WHEN '#f0e442' THEN 'Yellow' ELSE 'Custom ' || lower(hex) END AS name, round(lum, 6) AS luminance,
 CASE WHEN lum > 0.4 THEN 'rgba(0,0,0,0.8)' ELSE 'rgba(255,255,255,0.92)' END AS outline FROM l""")
def _(t):
    return t.sql(_HEX).select("p_partkey", Y.colour_name(c("hex")).alias("name"), r6(Y.luminance(c("hex"))).alias("luminance"), Y.contrast_outline(c("hex")).alias("outline"))


@query("sca10_marker_radius", """WITH p AS (SELECT p_partkey, CAST(2 + p_size % 23 AS DOUBLE) AS size, CAST(1 + p_partkey % 9 AS DOUBLE) / 12 AS scale, CASE p_partkey % 3 WHEN 0 THEN 'mouse' WHEN 1 THEN 'pen' ELSE 'touch' END AS pointer FROM part),
d AS (SELECT *, CASE WHEN scale >= 0.5 OR size <= 3.5 THEN size ELSE greatest(3.5::DOUBLE, CAST(floor(size * sqrt(scale / 0.5) * 2 + 0.5) AS DOUBLE) / 2) END AS radius FROM p)
SELECT p_partkey, radius, greatest(radius, CASE WHEN pointer = 'mouse' THEN 12.0::DOUBLE ELSE 22.0::DOUBLE END) / scale AS erase_radius FROM d""")
def _(t):
    p = t("part").select(
        "p_partkey", (2 + c("p_size") % 23).cast("double").alias("size"), ((1 + c("p_partkey") % 9).cast("double") / 12).alias("scale"),
        F.when(c("p_partkey") % 3 == 0, "mouse").when(c("p_partkey") % 3 == 1, "pen").otherwise("touch").alias("pointer"),
    )
    d = p.withColumn("radius", Y.display_radius(c("size"), c("scale")))
    return d.select("p_partkey", "radius", (Y.erase_radius(c("radius"), c("pointer")) / c("scale")).alias("erase_radius"))


@query("sca11_transform", """SELECT annotation_id, (x - 12.5) * 0.25 AS sx, (y - 7.25) * 0.25 AS sy, x / 0.5 + 12.5 AS ix, y / 0.5 + 7.25 AS iy
FROM (SELECT annotation_id, x, y FROM annotations)""".replace("12.5", "12.5::DOUBLE").replace("7.25", "7.25::DOUBLE").replace("0.25", "0.25::DOUBLE").replace(" 0.5 ", " 0.5::DOUBLE "))
def _(t):
    o = (F.lit(12.5), F.lit(7.25))
    sx, sy = G.to_screen(c("x"), c("y"), *o, F.lit(0.25))
    ix, iy = G.to_image(c("x"), c("y"), *o, F.lit(0.5))
    return t("annotations").select("annotation_id", sx.alias("sx"), sy.alias("sy"), ix.alias("ix"), iy.alias("iy"))


def regions(t):
    """Region polygons: a handful of drawn vertices each, in order."""
    v = t("region_vertices")
    return v.groupBy("region_id", "image_id").agg(F.sort_array(F.collect_list(F.struct("ord", "x", "y"))).alias("points"))


_EDGES = """e AS (SELECT a.region_id, a.image_id, a.ord, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM region_vertices a JOIN region_vertices b ON b.region_id = a.region_id AND b.ord = (a.ord + 1) % 5)"""


@query("sca12_polygon_area", f"""WITH {_EDGES}, b AS (SELECT region_id, min(x) AS x0, min(y) AS y0, max(x) - min(x) AS w, max(y) - min(y) AS h FROM region_vertices GROUP BY 1)
SELECT e.region_id, abs(sum((ax + bx) * (ay - by_))) / 2 AS area, min(x0) AS min_x, min(y0) AS min_y, min(w) AS width, min(h) AS height FROM e JOIN b ON b.region_id = e.region_id GROUP BY 1""")
def _(t):
    b = G.bounds(c("points"))
    return regions(t).select(
        "region_id", G.polygon_area(c("points")).alias("area"), b["min_x"].alias("min_x"), b["min_y"].alias("min_y"), (b["max_x"] - b["min_x"]).alias("width"), (b["max_y"] - b["min_y"]).alias("height")
    )


@query("sca13_finish_rectangle", """WITH p AS (SELECT annotation_id, least(4000, greatest(0, least(x, x + r * 3 - 40))) AS x0, least(4000, greatest(0, greatest(x, x + r * 3 - 40))) AS x1, least(3000, greatest(0, y - r * 2)) AS y0, least(3000, greatest(0, y)) AS y1 FROM marks),
q AS (SELECT annotation_id, round(x1, 1) - round(x0, 1) AS w, round(y1, 1) - round(y0, 1) AS h FROM p) SELECT annotation_id, w < 16 OR h < 16 OR w * h < 64 AS too_small, round(w * h, 6) AS area FROM q""")
def _(t):
    m = t("marks")
    w, h = F.lit(4000.0), F.lit(3000.0)
    poly = G.rect_points(c("x"), c("y"), c("x") + c("r") * 3 - 40, c("y") - c("r") * 2)
    p = m.select("annotation_id", F.transform(poly, lambda q: G.clamp_point(q, w, h)).alias("points"))
    return p.select("annotation_id", G.too_small(c("points"), F.lit(16.0)).alias("too_small"), F.round(G.polygon_area(c("points")), 6).alias("area"))


@query("sca13_finish_lasso")
def _(t):
    from petrigrid.operators.shapes import finish_lasso

    # every image's marks in list order are one hand-drawn loop
    return finish_lasso(t("marks").select("image_id", "ord", "x", "y"), ["image_id"], "ord", scale=0.5, width=4000.0, height=3000.0)


@query("sca14_translate", """SELECT region_id, CAST(ord AS INT) AS ord, x - 100 AS x, y - 50 AS y, x - 100 + 100 AS back_x, y - 50 + 50 AS back_y FROM region_vertices""")
def _(t):
    there = regions(t).select("region_id", "points", G.translate(c("points"), F.lit(-100.0), F.lit(-50.0)).alias("p"))
    both = there.select("region_id", F.posexplode(F.arrays_zip("p", G.translate(c("p"), F.lit(100.0), F.lit(50.0)).alias("q"))).alias("ord", "z"))
    return both.select("region_id", c("ord").cast("int").alias("ord"), c("z.p.x").alias("x"), c("z.p.y").alias("y"), c("z.q.x").alias("back_x"), c("z.q.y").alias("back_y"))


_SCALE = """SELECT p_partkey, CAST(2000 + p_size * 80 AS DOUBLE) AS w, CAST(1500 + p_size * 50 AS DOUBLE) AS h, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / 2 END AS rmin,
 CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS rtyp, CASE WHEN p_partkey % 5 = 0 THEN CAST(1000000 AS DOUBLE) END AS cap FROM part"""


@query("sca15_analysis_scale", f"""WITH p AS ({_SCALE}), q AS (SELECT *, least(1::DOUBLE, coalesce(sqrt(cap / (w * h)), 1)) AS lim, rmin IS NOT NULL OR rtyp IS NOT NULL AS sized,
 CASE WHEN rmin IS NOT NULL OR rtyp IS NOT NULL THEN greatest(coalesce(4 / rmin, 0), coalesce(8 / rtyp, 0)) ELSE 2048 / greatest(w, h) END AS want FROM p)
SELECT p_partkey, round(least(want, lim), 9) AS scale, CASE WHEN want >= lim THEN CASE WHEN lim >= 1 THEN 'full-resolution' ELSE 'pixel-cap' END WHEN sized THEN 'radius' ELSE 'preliminary' END AS reason FROM q""")
def _(t):
    s, why = G.analysis_scale(c("w"), c("h"), c("rmin"), c("rtyp"), c("cap"))
    return t.sql(_SCALE).select("p_partkey", F.round(s, 9).alias("scale"), why.alias("reason"))


@query("sca16_sensitivity", """SELECT p_partkey, round(0.5 - 0.3 * s, 9) AS thr_frac, round(3.5 - 2 * s, 9) AS noise_k, round(0.2 - 0.2 * s, 9) AS lambda, round(0.45 - 0.35 * s, 9) AS log_frac,
 round(greatest((3.5 - 2 * s) * 1.5, (0.5 - 0.3 * s) * p_size), 9) AS threshold FROM (SELECT p_partkey, p_size, least(1::DOUBLE, greatest(0::DOUBLE, CAST(p_size - 5 AS DOUBLE) / 40)) AS s FROM part)""")
def _(t):
    s = (c("p_size") - 5).cast("double") / 40
    p = S.sensitivity(s)
    r9 = lambda x: F.round(x, 9)
    return t("part").select("p_partkey", *[r9(v).alias(k) for k, v in p.items()], r9(S.mask_threshold(s, F.lit(1.5), c("p_size"))).alias("threshold"))


_COST = "(CASE WHEN z > 0 THEN 2 ELSE 0.5 END) * (CASE WHEN abs(z) <= 2 THEN 0.5 * z * z ELSE 2 * (abs(z) - 1) END)"


@query("sca17_size_cost", f"SELECT unit_id, config_id, round(sum({_COST}), 6) AS cost FROM (SELECT *, (ln(r) - ln(9)) / 0.3 AS z FROM unit_disks) GROUP BY 1, 2")
def _(t):
    cost = S.size_cost(c("r"), F.log(F.lit(9.0)), F.lit(0.3))
    return t("unit_disks").groupBy("unit_id", "config_id").agg(r6(F.sum(cost)).alias("cost"))


@query("sca18_prior_radii", """WITH RECURSIVE q AS (SELECT p_partkey, ln(CAST(1 + p_size % 12 AS DOUBLE)) AS m, 0.02 * CAST(1 + p_partkey % 20 AS DOUBLE) AS s FROM part),
f AS (SELECT p_partkey, k, greatest(1.5::DOUBLE, exp(m + st * s)) AS r FROM q JOIN (VALUES (1, -1.5::DOUBLE), (2, -0.75::DOUBLE), (3, 0::DOUBLE), (4, 0.75::DOUBLE), (5, 1.5::DOUBLE)) AS v(k, st) ON TRUE),
w AS (SELECT p_partkey, 1 AS k, r AS last, TRUE AS kept, r FROM f WHERE k = 1 UNION ALL
 SELECT w.p_partkey, w.k + 1, CASE WHEN f.r - w.last > 0.4 THEN f.r ELSE w.last END, f.r - w.last > 0.4, f.r FROM w JOIN f ON f.p_partkey = w.p_partkey AND f.k = w.k + 1)
SELECT p_partkey, count(*) AS n, round(max(r), 6) AS largest, round(sum(r), 6) AS total FROM w WHERE kept GROUP BY 1""")
def _(t):
    p = t("part").select("p_partkey", S.prior_radii(F.log((1 + c("p_size") % 12).cast("double")), F.lit(0.02) * (1 + c("p_partkey") % 20)).alias("a"))
    return p.select("p_partkey", F.size("a").cast("bigint").alias("n"), r6(F.array_max("a")).alias("largest"), r6(F.aggregate("a", F.lit(0.0), lambda s, v: s + v)).alias("total"))


_LIN = "(CASE WHEN {v} / 255::DOUBLE <= 0.04045 THEN {v} / 255::DOUBLE / 12.92 ELSE pow(({v} / 255::DOUBLE + 0.055) / 1.055, 2.4) END)"
_FF = "(CASE WHEN {t} > 216 / 24389::DOUBLE THEN cbrt({t}) ELSE (24389 / 27::DOUBLE * {t} + 16) / 116 END)"
LAB_CTE = f"""lin AS (SELECT image_id, y, x, r, g, b, {_LIN.format(v='r')} AS rl, {_LIN.format(v='g')} AS gl, {_LIN.format(v='b')} AS bl FROM pixels),
xyz AS (SELECT *, (0.4124564 * rl + 0.3575761 * gl + 0.1804375 * bl) / 0.95047 AS xx, 0.2126729 * rl + 0.7151522 * gl + 0.072175 * bl AS yy, (0.0193339 * rl + 0.119192 * gl + 0.9503041 * bl) / 1.08883 AS zz FROM lin),
fff AS (SELECT *, {_FF.format(t='xx')} AS fx, {_FF.format(t='yy')} AS fy, {_FF.format(t='zz')} AS fz FROM xyz),
lab AS (SELECT image_id, y, x, r, g, b, 116 * fy - 16 AS l, 500 * (fx - fy) AS a, 200 * (fy - fz) AS bb FROM fff)"""


@query("sca20_lab", f"""WITH {LAB_CTE} SELECT image_id, y, x, round(l, 5) AS l, round(a, 5) AS a, round(bb, 5) AS b_, round(CAST(0.2126 * r + 0.7152 * g + 0.0722 * b AS DOUBLE), 5) AS luma,
 r >= 250 OR g >= 250 OR b >= 250 AS saturated, round(sqrt((l - 50) * (l - 50) + a * a + bb * bb), 5) AS from_grey FROM lab""")
def _(t):
    px = K.with_lab(t("pixels"), c("r"), c("g"), c("b"))
    grey = F.struct(F.lit(50.0).alias("l"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    r5 = lambda v: F.round(v, 5)
    return px.select(
        "image_id", "y", "x", r5(c("lab.l")).alias("l"), r5(c("lab.a")).alias("a"), r5(c("lab.b")).alias("b_"), r5(K.luma(c("r"), c("g"), c("b"))).alias("luma"),
        K.saturated(c("r"), c("g"), c("b")).alias("saturated"), r5(K.lab_distance(c("lab"), grey)).alias("from_grey"),
    )


_CURVE = "CAST(floor((CASE WHEN inv THEN 1 - w ELSE w END) * 255 + 0.5) AS INT)"


@query("sca21_transfer_curve", f"""WITH k AS (SELECT image_id, y, x, r, g, b, CAST(image_id % 3 - 1 AS DOUBLE) / 4 AS br, CAST(image_id % 2 AS DOUBLE) * 0.35 AS co, CASE WHEN image_id % 2 = 0 THEN 1::DOUBLE ELSE 2::DOUBLE END AS ga, image_id % 4 = 1 AS inv FROM pixels),
m AS (SELECT *, least(255, greatest(0, CAST(floor(greatest(0, -0.3 * (0.2126 * r + 0.7152 * g + 0.0722 * b) + 1.3 * r) + 0.5) AS INT))) AS v FROM k),
c1 AS (SELECT *, least(1::DOUBLE, greatest(0::DOUBLE, ((CAST(v AS DOUBLE) - 20) / 200 + br / 2 - 0.5) * pow(2, 2 * co) + 0.5)) AS z FROM m),
c2 AS (SELECT *, CASE WHEN ga = 1 THEN z ELSE pow(z, 1 / ga) END AS w FROM c1) SELECT image_id, y, x, v AS mixed, {_CURVE} AS shown FROM c2""")
def _(t):
    m = K.channel_matrix("rgb", 1.3)
    red, _, _ = K.apply_matrix(m, c("r"), c("g"), c("b"))
    i = c("image_id")
    shown = K.transfer(c("mixed").cast("double"), F.lit(20.0), F.lit(220.0), (i % 3 - 1).cast("double") / 4, (i % 2).cast("double") * 0.35, F.when(i % 2 == 0, 1.0).otherwise(2.0), i % 4 == 1)
    return t("pixels").withColumn("mixed", red).select("image_id", "y", "x", "mixed", shown.alias("shown"))


_C, _R = (200, 150, 90), (120, 110, 100)


def _lab_py(rgb):
    lin = [v / 255 / 12.92 if v / 255 <= 0.04045 else ((v / 255 + 0.055) / 1.055) ** 2.4 for v in rgb]
    f = lambda u: u ** (1 / 3) if u > 216 / 24389 else (24389 / 27 * u + 16) / 116
    X_, Y_, Z_ = (sum(k * v for k, v in zip(row, lin)) for row in ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.072175), (0.0193339, 0.119192, 0.9503041)))
    x, y, z = f(X_ / 0.95047), f(Y_), f(Z_ / 1.08883)
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def _tone_sql():
    a, b = _lab_py(_C), _lab_py(_R)
    d = [p - q for p, q in zip(a, b)]
    n = sum(v * v for v in d) ** 0.5
    span = max(n, 6.0)
    dot = " + ".join(f"({name} - ({(p + q) / 2!r})) * ({v / n!r})" for name, p, q, v in zip(("l", "a", "bb"), a, b, d))
    return f"""WITH {LAB_CTE}, p AS (SELECT image_id, y, x, 0.5 + ({dot}) / {span!r} AS t FROM lab)
SELECT image_id, y, x, round(t, 5) AS position, round(0.3 / (1 + exp(-6 * (t + 0.5))) + 0.7 / (1 + exp(-6 * (t - 0.5))), 5) AS tone FROM p"""


@query("sca22_centre_tone", _tone_sql())
def _(t):
    px = t("pixels").withColumns({f"c{k}": F.lit(v) for k, v in zip("rgb", _C)} | {f"m{k}": F.lit(v) for k, v in zip("rgb", _R)})
    px = K.with_lab(K.with_lab(px, c("cr"), c("cg"), c("cb"), "centre"), c("mr"), c("mg"), c("mb"), "rim")
    px = K.with_axis(K.with_lab(px, c("r"), c("g"), c("b")), "centre", "rim").withColumn("t", K.axis_position(c("lab"), c("axis")))
    return px.select("image_id", "y", "x", F.round("t", 5).alias("position"), F.round(K.centre_tone(c("t"), F.lit(6.0)), 5).alias("tone"))


@query("sca23_colour_table")
def _(t):
    from petrigrid.operators.display import centre_view

    styles = t.sql("SELECT DISTINCT image_id FROM pixels").select(
        "image_id", *[F.lit(float(v)).alias(f"centre_{k}") for k, v in zip("rgb", _C)], *[F.lit(float(v)).alias(f"rim_{k}") for k, v in zip("rgb", _R)], (2.0 + c("image_id") % 3 * 4).alias("separation")
    )
    return centre_view(t("pixels"), styles).select("image_id", "y", "x", "grey")


@query("sca24_texts", """WITH e AS (SELECT event_id, CAST(floor(value) AS BIGINT) * 37 AS v, user_id * 11 AS n, event_id % 4 AS k, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 5 END AS alt FROM events)
SELECT event_id, CASE WHEN v = n THEN 'same as now' ELSE format('{:,}', abs(v - n)) || CASE WHEN v > n THEN ' more' ELSE ' fewer' END || ' than now' END AS delta,
 format('{:,}', v) || CASE WHEN v = 1 THEN ' image' ELSE ' images' END AS plural,
 CASE WHEN k = 0 AND alt > 0 THEN CASE WHEN alt = 1 THEN 'One more?' ELSE alt || ' more?' END WHEN alt IS NULL OR alt = k THEN CASE WHEN k = 1 THEN 'Colony?' ELSE k || ' colonies?' END
 ELSE least(k, alt) || ' or ' || greatest(k, alt) || '?' END AS question FROM e""")
def _(t):
    e = t.sql("SELECT event_id, CAST(floor(value) AS BIGINT) * 37 AS v, user_id * 11 AS n, event_id % 4 AS k, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 5 END AS alt FROM events")
    return e.select("event_id", X.delta_text(c("v"), c("n")).alias("delta"), X.plural(c("v"), "image").alias("plural"), X.review_question(c("k"), c("alt")).alias("question"))


@query("sca24_reason_tag", """SELECT version_id, CASE reason WHEN 'before-destructive' THEN 'Before a change' WHEN 'before-restore' THEN 'Before restoring' WHEN 'manual' THEN 'Saved by you'
 WHEN 'session-start' THEN 'Opened' ELSE 'Automatic' END AS tag FROM versions""")
def _(t):
    return t("versions").select("version_id", X.reason_tag(c("reason")).alias("tag"))


@query("sca25_save_status", """SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'local-error' WHEN event_id % 13 = 0 THEN 'idle' WHEN event_id % 2 = 0 THEN 'saved-local' WHEN event_id % 11 = 0 THEN 'saving-drive'
 WHEN event_id % 7 = 0 THEN 'conflict' WHEN event_id % 3 = 0 AND event_id % 5 = 0 THEN 'reconnect-required' WHEN event_id % 3 = 0 AND event_type = 'error' THEN 'failed' WHEN event_id % 3 = 0 THEN 'pending' ELSE 'saved-drive' END AS status FROM events""")
def _(t):
    i = c("event_id")
    return t("events").select(
        "event_id",
        X.save_status(F.when(i % 17 == 0, "disk full"), i % 13 != 0, i % 2 != 0, i % 11 == 0, F.when(i % 7 == 0, 2).otherwise(0), i % 3 == 0, i % 5 != 0, F.when(c("event_type") == "error", "offline")).alias("status"),
    )


@query("sca26_retry_delay", "SELECT event_id, CAST(least(300000, 15000 * pow(2, event_id % 9)) AS BIGINT) AS delay_ms FROM events")
def _(t):
    return t("events").select("event_id", X.retry_delay_ms(c("event_id") % 9 + 1).alias("delay_ms"))


@query("sca27_widen_prior", """SELECT p_partkey, round(s * w, 9) AS s, round(greatest(1, exp(m - 2 * s * w)), 6) AS r_lo, round(exp(m + 2 * s * w), 6) AS r_hi
FROM (SELECT p_partkey, ln(CAST(p_size AS DOUBLE)) AS m, 0.25::DOUBLE AS s, CAST(1 + p_partkey % 4 AS DOUBLE) / 2 AS w FROM part)""")
def _(t):
    w = S.widen(F.log(c("p_size").cast("double")), F.lit(0.25), (1 + c("p_partkey") % 4).cast("double") / 2)
    return t("part").select("p_partkey", F.round(w["s"], 9).alias("s"), r6(w["r_lo"]).alias("r_lo"), r6(w["r_hi"]).alias("r_hi"))


@query("sca28_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def _(t):
    e = t("events").select("event_id", F.from_json("props", "k bigint, missing string").alias("j"))
    return e.select("event_id", "j.k", "j.missing")


@query("sca29_constructors", """SELECT annotation_id AS id, x, y, group_id, 'manual' AS origin, 'accepted' AS review_status, updated_at AS created_at, updated_at AS reviewed_at, 'manual' AS last_edit_source, FALSE AS manually_adjusted FROM annotations""")
def _(t):
    from petrigrid.sources.records import manual_marks

    return manual_marks(t("annotations").select(c("annotation_id").alias("id"), "x", "y", "group_id", c("updated_at").alias("at"))).drop("updated_at")


@query("sca29_empty_documents", """SELECT i.image_id, i.project_id, 1 AS schema_version, i.fingerprint AS image_fingerprint, i.width, i.height, CAST(0 AS BIGINT) AS annotations FROM images i""")
def _(t):
    from petrigrid.sources.records import empty_documents

    return empty_documents(t("images")).select("image_id", "project_id", "schema_version", "image_fingerprint", "width", "height", F.size("annotations").cast("bigint").alias("annotations"))


_RAW = """SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(p_size - 25 AS DOUBLE) / 20 END AS brightness, CASE WHEN p_partkey % 4 = 1 THEN CAST(0.35 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS contrast,
 CAST(p_size AS DOUBLE) / 7 AS gamma, CASE WHEN p_partkey % 4 = 1 THEN CAST(1.3 AS DOUBLE) ELSE CAST(p_size % 2 + 0.12345 AS DOUBLE) END AS saturation, CAST(p_size AS DOUBLE) AS separation,
 CASE p_partkey % 4 WHEN 0 THEN 'luma' WHEN 1 THEN 'rgb' WHEN 2 THEN 'centre' ELSE 'ultraviolet' END AS channel, p_partkey % 5 = 0 AS invert, p_partkey % 4 = 1 AS auto_contrast FROM part"""
_DISP = ", ".join(
    f"CASE WHEN {n} IS NULL THEN {d}::DOUBLE ELSE CAST(floor(least({hi}::DOUBLE, greatest({lo}::DOUBLE, {n})) * 1000 + 0.5) AS DOUBLE) / 1000 END AS {n}"
    for n, d, lo, hi in [(n, Y.DISPLAY_DEFAULTS[n], *Y.DISPLAY_LIMITS[n]) for n in Y.DISPLAY_LIMITS]
)
_DCTE = f"d AS (SELECT p_partkey, {_DISP}, CASE WHEN channel IN ('rgb','red','green','blue','luma','centre') THEN channel ELSE 'rgb' END AS channel, invert, auto_contrast FROM ({_RAW}))"
_ISDEF = "brightness = 0 AND contrast = 0 AND gamma = 1 AND saturation = 1 AND NOT invert AND channel = 'rgb' AND NOT auto_contrast"


def _num(n):
    return f"regexp_replace(CAST({n} AS VARCHAR), '\\.0$', '')"


_KEY = f"""channel || '|' || {_num('brightness')} || '|' || {_num('contrast')} || '|' || {_num('gamma')} || '|' || {_num("CASE WHEN channel = 'rgb' THEN saturation ELSE 1::DOUBLE END")}
 || '|' || CASE WHEN invert THEN '1' ELSE '0' END || '|' || CASE WHEN auto_contrast THEN '1' ELSE '0' END || CASE WHEN channel = 'centre' THEN '|none' ELSE '' END"""


@query("val9_display_repair", f"WITH {_DCTE} SELECT *, NOT ({_ISDEF}) AS stored FROM d")
def _(t):
    d = Y.normalise_display()
    fixed = t.sql(_RAW).select("p_partkey", *[v.alias(k) for k, v in d.items()])
    return fixed.withColumn("stored", ~Y.is_default_display({k: c(k) for k in d}))


@query("fil13_display_key", f"""WITH {_DCTE} SELECT p_partkey, CASE WHEN {_ISDEF} THEN 'default' ELSE {_KEY} END AS display_key,
 CASE WHEN {_ISDEF} THEN 'default' WHEN auto_contrast AND brightness = 0 AND contrast = 0.35 AND gamma = 1 AND saturation = 1.3 AND NOT invert AND channel = 'rgb' THEN 'high-contrast'
 WHEN channel = 'green' AND auto_contrast AND NOT invert AND brightness = 0 AND contrast = 0 AND gamma = 1 THEN 'green' WHEN channel = 'luma' AND auto_contrast AND invert AND brightness = 0 AND contrast = 0 AND gamma = 1 THEN 'inverted-grey'
 WHEN channel = 'centre' AND NOT auto_contrast AND NOT invert AND brightness = 0 AND contrast = 0 AND gamma = 1 AND separation = 6 THEN 'centres' END AS preset
FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 0::DOUBLE ELSE brightness END AS brightness, contrast, CASE WHEN p_partkey % 3 = 0 THEN 1::DOUBLE ELSE gamma END AS gamma, saturation,
 CASE WHEN p_partkey % 3 = 0 THEN 6::DOUBLE ELSE separation END AS separation, channel, invert, auto_contrast FROM d)""")
def _(t):
    raw = t.sql(_RAW)
    third = c("p_partkey") % 3 == 0
    raw = raw.withColumns({"brightness": F.when(third, 0.0).otherwise(c("brightness")), "gamma": F.when(third, 1.0).otherwise(c("gamma")), "separation": F.when(third, 6.0).otherwise(c("separation"))})
    d = Y.normalise_display()
    fixed = raw.select("p_partkey", *[v.alias(k) for k, v in d.items()])
    cols = {k: c(k) for k in d}
    return fixed.select("p_partkey", Y.display_key(cols).alias("display_key"), Y.matching_preset(cols).alias("preset"))
