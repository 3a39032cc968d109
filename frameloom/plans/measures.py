"""Registered queries of the session operators' single expressions and small kernels, each with its SQL for DuckDB."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import kernels as K
from ..operators import background as B
from ..operators import catalog as G
from ..operators import geometry as T
from ..operators import images as I
from ..operators import windows as W
from ..sources import sinks
from . import views as V
from .queries import BLOCKS, MED, ORACLES, QUERIES, SHIFTED, STARS, TEMPORAL, MASKED, _starred, _warped, direction_search, maps, query, rounded

__all__ = ["ORACLES", "QUERIES"]

# ------------------------------------------------------------- files and tags

PATHS = """paths AS (SELECT o_orderkey, '/cards/' || (o_custkey % 7) || '/IMG_' || o_orderkey || '.' || (['CR2', 'nef', 'jpg', 'DNG', 'tar.gz'])[o_orderkey % 5 + 1] AS path FROM orders),
raws AS (SELECT *, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext FROM paths WHERE lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN (""" + ", ".join(f"'{e}'" for e in G.RAW_EXTENSIONS) + "))"


def _paths(spark, sf_dir) -> DataFrame:
    o, k = V.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    kind = F.get(F.array(*(F.lit(e) for e in ("CR2", "nef", "jpg", "DNG", "tar.gz"))), (k % 5).cast("int"))
    return o.select("o_orderkey", F.concat(F.lit("/cards/"), F.col("o_custkey") % 7, F.lit("/IMG_"), k, F.lit("."), kind).alias("path"))


@query("", f"WITH {PATHS} SELECT row_number() OVER (ORDER BY path) - 1 AS frame_idx, path FROM raws ORDER BY path LIMIT 4000")
def list_frames(spark, sf_dir):
    return G.list_frames(_paths(spark, sf_dir), limit=4000).select("frame_idx", "path")


@query("", f"WITH {PATHS} SELECT ext, count(*) AS n FROM raws GROUP BY ext")
def input_counts(spark, sf_dir):
    return _paths(spark, sf_dir).where(G.is_raw(F.col("path"))).groupBy(G.extension(F.col("path")).alias("ext")).agg(F.count(F.lit(1)).alias("n"))


@query("", f"WITH {PATHS} SELECT o_orderkey, regexp_replace(regexp_replace(path, '^.*/', ''), '\\.[^.]*$', '') || '_clean.dng' AS name FROM paths")
def export_names(spark, sf_dir):
    return _paths(spark, sf_dir).select("o_orderkey", sinks.export_name(F.col("path")).alias("name"))


@query("", """WITH t AS (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN strftime(ts, '%Y:%m:%d %H:%M:%S') || '.5' END AS a, CASE WHEN event_id % 2 > 0 THEN 'no date' END AS b,
  '  ' || strftime(ts, '%Y:%m:%d %H:%M:%S') AS c FROM events)
SELECT event_id, coalesce(CAST(epoch(try_strptime(substr(trim(coalesce(a, b, c)), 1, 19), '%Y:%m:%d %H:%M:%S')) AS BIGINT), -1) AS seconds FROM t""")
def capture_seconds(spark, sf_dir):
    e, k = V.table(spark, sf_dir, "events"), F.col("event_id")
    text = F.date_format("ts", "yyyy:MM:dd HH:mm:ss")
    made = G.capture_seconds(F.when(k % 3 > 0, F.concat(text, F.lit(".5"))), F.when(k % 2 > 0, F.lit("no date")), F.concat(F.lit("  "), text))
    return e.select("event_id", F.coalesce(made, F.lit(-1)).alias("seconds"))


@query("", """WITH d AS (SELECT o_orderkey, concat_ws(' + ', CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END, CASE WHEN o_orderkey % 4 > 0 THEN o_orderstatus END) AS t FROM orders)
SELECT o_orderkey, CASE WHEN t = '' THEN 'no identifying tags' ELSE t END AS described FROM d""")
def describe_source(spark, sf_dir):
    k = F.col("o_orderkey")
    return V.table(spark, sf_dir, "orders").select("o_orderkey", G.describe(F.when(k % 3 > 0, F.col("o_orderpriority")), F.when(k % 4 > 0, F.col("o_orderstatus"))).alias("described"))


LINES = ("WARNING: few frames", " f1 LOAD FAILED", "f2 NOT ALIGNED", "2 of different dimensions", "1 implausible alignment", "drift not measurable", "3 skipped", "an error", "warning")


@query("", f"""WITH l AS (SELECT o_orderkey, ({list(LINES)!r})[o_orderkey % 9 + 1] AS line FROM orders)
SELECT line, count(*) AS n, regexp_matches(line, 'WARNING|LOAD FAILED|NOT ALIGNED|different dimensions|implausible alignment') AS warning FROM l GROUP BY line""")
def report_warnings(spark, sf_dir):
    line = F.get(F.array(*(F.lit(x) for x in LINES)), (F.col("o_orderkey") % 9).cast("int"))
    lines = V.table(spark, sf_dir, "orders").select(line.alias("line"))
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")).withColumn("warning", G.is_warning(F.col("line")))


# --------------------------------------------------------------------- colour


@query("pixels", """w AS (SELECT frame_idx, max(CASE WHEN y = 0 AND x = 0 THEN abs(v) * 9 END) AS r, max(CASE WHEN y = 0 AND x = 1 THEN abs(v) * 9 END) AS g, max(CASE WHEN y = 0 AND x = 2 THEN abs(v) * 9 END) AS b FROM pixels GROUP BY frame_idx)
SELECT frame_idx, round(r / greatest(g, 1), 6) AS wb_r, CAST(1 AS DOUBLE) AS wb_g, round(b / greatest(g, 1), 6) AS wb_b, round(0.299 * r + 0.587 * g + 0.114 * b, 6) AS luminance FROM w""")
def white_balance(spark, sf_dir):
    r, g, b = (F.abs(F.get("data", F.lit(k))) * 9 for k in range(3))
    out = V.images(spark, sf_dir).select("frame_idx", C.white_balance(r, g, b).alias("wb"), C.luminance(r, g, b).alias("luminance"))
    wb = [F.get("wb", F.lit(k)).alias(f"wb_{c}") for k, c in enumerate("rgb")]
    return rounded(out.select("frame_idx", *wb, "luminance"), "wb_r", "wb_g", "wb_b", "luminance")


MATRIX = """m AS (SELECT vec_id AS frame_idx, list_transform(embedding[1:12], lambda v: CAST(v AS DOUBLE) * CASE vec_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 100000 END) AS m FROM embeddings),
n AS (SELECT frame_idx, m[1:9] AS m, list_max(list_transform(m[1:9], lambda v: abs(v))) AS biggest FROM m),
c AS (SELECT frame_idx, unnest(CASE WHEN biggest = 0 THEN [1.0, 0, 0, 0, 1, 0, 0, 0, 1] WHEN biggest > 10 THEN list_transform(m, lambda v: v / 10000) ELSE m END) AS v, generate_subscripts(m, 1) - 1 AS pos FROM n)"""


@query("", f"WITH {MATRIX} SELECT frame_idx, CAST(pos AS INT) AS pos, round(v, 6) + 0.0 AS v, CAST(round(v * 10000) AS INT) AS numerator FROM c")
def colour_matrix(spark, sf_dir):
    times = F.get(F.array(F.lit(0.0), F.lit(1.0), F.lit(100000.0)), (F.col("frame_idx") % 3).cast("int"))
    m = V.images(spark, sf_dir).select("frame_idx", F.slice("data", 1, 12).alias("m"), times.alias("times"))
    m = m.select("frame_idx", C.colour_matrix(F.transform("m", lambda v: v * F.col("times"))).alias("m"))
    both = F.arrays_zip(F.col("m").alias("v"), C.matrix_srational(F.col("m")).alias("numerator"))
    return rounded(m.select("frame_idx", F.posexplode(both).alias("pos", "e")).select("frame_idx", "pos", "e.v", "e.numerator"), "v")


# ------------------------------------------------------ transforms and models


@query("catalog", """SELECT frame_idx, round(cos(angle), 6) AS cos_t, round(-sin(angle), 6) + 0.0 AS sin_t, round(-(cos(angle) * tx + sin(angle) * ty), 6) + 0.0 AS tx,
  round(sin(angle) * tx - cos(angle) * ty, 6) + 0.0 AS ty FROM catalog""")
def transform_inverse(spark, sf_dir):
    out = V.catalog(spark, sf_dir).select("frame_idx", T.inverse(T.rotation(F.col("angle"), F.col("tx"), F.col("ty"))).alias("m")).select("frame_idx", "m.*")
    return rounded(out, "cos_t", "sin_t", "tx", "ty")


COEFFICIENTS = [0.5, -0.25, 0.75, 0.1, -0.2, 0.3, 0.05, 0.15, -0.35, 0.4]
PROFILE = [1.0, 0.7, 0.4, 0.35, 0.1]


@query("pixels", f"""p AS (SELECT frame_idx, y, x, (x - 3.5) / 3.5 AS u, (y - 3.5) / 3.5 AS w, sqrt((x - 3.5) ** 2 + (y - 3.5) ** 2) AS r, 2.0 + frame_idx % 5 AS cx, 1.5 + frame_idx % 4 AS cy FROM pixels),
q AS (SELECT *, least(CAST(floor(r / 1.1) AS INT), 4) AS i FROM p)
SELECT frame_idx, y, x, round(0.5 - 0.25 * u + 0.75 * w + 0.1 * u * u - 0.2 * u * w + 0.3 * w * w + 0.05 * u * u * u + 0.15 * u * u * w - 0.35 * u * w * w + 0.4 * w * w * w, 6) + 0.0 AS poly,
  CAST(1 AS DOUBLE) AS harmonic_0, round(cos(2 * atan2(w, u)), 6) + 0.0 AS harmonic_2,
  round(CASE WHEN i >= 4 THEN 0.1 ELSE ({PROFILE})[i + 1] * (1 - (r / 1.1 - i)) + ({PROFILE})[i + 2] * (r / 1.1 - i) END, 6) AS radial,
  round(greatest(least(cx, cy, 8 - cx, 8 - cy), 1), 6) AS full_radius, round(sqrt(greatest(cx, 8 - cx) ** 2 + greatest(cy, 8 - cy) ** 2), 6) AS corner_radius FROM q""")
def model_terms(spark, sf_dir):
    p = V.pixels(spark, sf_dir)
    u, w = (F.col("x") - 3.5) / 3.5, (F.col("y") - 3.5) / 3.5
    cx, cy = F.lit(2.0) + F.col("frame_idx") % 5, F.lit(1.5) + F.col("frame_idx") % 4
    fixed = lambda v: F.array(*(F.lit(x) for x in v))
    out = p.select(
        "frame_idx", "y", "x", C.poly_value(fixed(COEFFICIENTS), u, w).alias("poly"), C.harmonic(0, F.atan2(w, u)).alias("harmonic_0"), C.harmonic(2, F.atan2(w, u)).alias("harmonic_2"),
        C.radial_value(fixed(PROFILE), F.hypot(F.col("x") - 3.5, F.col("y") - 3.5), 1.1).alias("radial"),
        C.full_radius(cx, cy, 8.0, 8.0).alias("full_radius"), C.corner_radius(cx, cy, 8.0, 8.0).alias("corner_radius"),
    )
    return rounded(out, "poly", "harmonic_2", "radial", "full_radius", "corner_radius")


RAMP = "least(greatest(({0} - {1}) / ({2} - {1}), 0), 1)"
DAWN = RAMP.format("level * 4", "1.5", "2.3")
DAMP = RAMP.format("cloud / greatest(level, 1e-9)", "0.25", "1.0")


@query("catalog", f"""s AS (SELECT *, {RAMP.format('level', '0.1', '0.4')} AS t, {DAWN} * {DAWN} * (3 - 2 * {DAWN}) AS d FROM catalog)
SELECT frame_idx, round(t * t * (3 - 2 * t), 6) AS ramp, round(CASE WHEN d * d < 0.02 THEN 0 ELSE d * d END, 6) AS dawn,
  round(frame_idx * 10.0 / 2 * (2 * 3.141592653589793 / 86164) * 0.25 * 7000, 6) AS motion FROM s""")
def sky_ramps(spark, sf_dir):
    level = F.col("level")
    out = V.catalog(spark, sf_dir).select("frame_idx", C.smoothstep(level, 0.1, 0.4).alias("ramp"), C.dawn_weight(level * 4).alias("dawn"), C.sidereal_motion(F.col("frame_idx") * 10.0, 7000.0).alias("motion"))
    return rounded(out, "ramp", "dawn", "motion")


@query("catalog", f"""r AS (SELECT *, CASE WHEN level * 3 - 0.3 > 0 THEN level * 3 - 0.3 ELSE 1 END AS k, {DAMP} AS t FROM catalog),
b AS (SELECT *, greatest(least(k, 1) * 0.85, 0.3) AS low FROM r)
SELECT frame_idx, round(low, 6) AS low, round(greatest(least(greatest(k, 1) * 1.15, 3), low), 6) AS high, round(1 - t * t * (3 - 2 * t), 6) + 0.0 AS kept FROM b""")
def dome_and_damping(spark, sf_dir):
    low, high = C.dome_bounds(F.col("level") * 3 - 0.3)
    out = V.catalog(spark, sf_dir).select("frame_idx", low.alias("low"), high.alias("high"), C.anomaly_damping(F.col("cloud"), F.col("level")).alias("kept"))
    return rounded(out, "low", "high", "kept")


@query("catalog", """SELECT frame_idx, round(1 / (1 - least(0.4 * greatest(fg - 0.2, 0) / greatest(level, 1e-9), 0.5)), 6) AS gain,
  round((1 - least(greatest(cloud * 1.3, 0.15), 1)) * level * fg, 6) + 0.0 AS deficit,
  round(CASE WHEN fg - cloud > 1e-9 THEN (level - cloud) / (fg - cloud) ELSE 0 END, 6) + 0.0 AS background FROM catalog""")
def contrast_terms(spark, sf_dir):
    level, fg, cloud = F.col("level"), F.col("fg"), F.col("cloud")
    out = V.catalog(spark, sf_dir).select("frame_idx", C.contrast_gain(fg - 0.2, level, 0.4).alias("gain"), C.flat_deficit(cloud * 1.3, level, fg).alias("deficit"), C.background_level(level, cloud, fg).alias("background"))
    return rounded(out, "gain", "deficit", "background")


# ------------------------------------------------------------- cells and masks


@query("pixels", """SELECT frame_idx, y, x, CAST(least(x // 3, 1) AS INT) AS gx, CAST(least(y // 3, 1) AS INT) AS gy, CAST(least(x // 3, 1) * 3 + 1.5 AS DOUBLE) AS centre_x, CAST(least(y // 3, 1) * 3 + 1.5 AS DOUBLE) AS centre_y FROM pixels""")
def cell_lookup(spark, sf_dir):
    p = V.pixels(spark, sf_dir)
    gx, gy = B.cell_of(F.col("x"), F.col("y"), 3, 2, 2)
    cx, cy = B.cell_centre(gx, gy, 3)
    return p.select("frame_idx", "y", "x", gx.alias("gx"), gy.alias("gy"), cx.alias("centre_x"), cy.alias("centre_y"))


NEAR = """pl AS (SELECT frame_idx, greatest(least(tx * 0.7 - 0.3, 2.999), 0) AS fx, greatest(least(ty * 0.9 - 0.2, 1.999), 0) AS fy FROM catalog),
ij AS (SELECT *, CAST(floor(fx) AS INT) AS i, CAST(floor(fy) AS INT) AS j FROM pl)"""


def _places(spark, sf_dir):
    return V.catalog(spark, sf_dir).select("frame_idx", (F.col("tx") * 0.7 - 0.3).alias("fx"), (F.col("ty") * 0.9 - 0.2).alias("fy"))


@query("samples catalog", f"""{BLOCKS}, {TEMPORAL}, {NEAR}
SELECT frame_idx, round(sum(t.v * (1 - abs(fx - t.gx)) * (1 - abs(fy - t.gy))), 6) AS v FROM ij JOIN t ON t.gx BETWEEN i AND i + 1 AND t.gy BETWEEN j AND j + 1 GROUP BY frame_idx""")
def bilinear_lookup(spark, sf_dir):
    grid = B.temporal_median(maps(spark, sf_dir), masked=F.expr(MASKED))
    out = B.bilinear(grid, _places(spark, sf_dir), F.col("fx"), F.col("fy"), 4, 3)
    return rounded(out, "v").select("frame_idx", "v")


@query("samples catalog", f"""{BLOCKS}, mk AS (SELECT gx, gy, count_if(bg > 55) > count(*) // 2 AS masked FROM maps GROUP BY gx, gy), {NEAR}
SELECT frame_idx, round(sum(CASE WHEN masked THEN 0 ELSE 1 END * (1 - abs(fx - gx)) * (1 - abs(fy - gy))), 6) AS weight FROM ij JOIN mk ON gx BETWEEN i AND i + 1 AND gy BETWEEN j AND j + 1 GROUP BY frame_idx""")
def sky_weight(spark, sf_dir):
    masks = B.consensus_mask(maps(spark, sf_dir).withColumn("masked", F.col("bg") > 55))
    out = B.sky_weight(masks, _places(spark, sf_dir), F.col("fx"), F.col("fy"), 4, 3)
    return rounded(out, "weight").select("frame_idx", "weight")


@query("pixels", """m AS (SELECT frame_idx, v > 0.1 AS a, CASE WHEN x % 3 > 0 THEN v < -0.1 END AS b FROM pixels)
SELECT frame_idx, CAST(count_if(coalesce(a, false) OR coalesce(b, false)) AS BIGINT) AS n_union, round(avg(CAST(a AS INT)), 6) AS share, bool_or(a) AS touched, CAST(count_if(coalesce(b, true)) AS BIGINT) AS n_valid FROM m GROUP BY frame_idx""")
def mask_algebra(spark, sf_dir):
    p = V.pixels(spark, sf_dir).select("frame_idx", (F.col("v") > 0.1).alias("a"), F.when(F.col("x") % 3 > 0, F.col("v") < -0.1).alias("b"))
    a, b = F.col("a"), F.col("b")
    out = p.groupBy("frame_idx").agg(F.count_if(B.mask_union(a, b)).alias("n_union"), B.mask_fraction(a).alias("share"), F.bool_or(a).alias("touched"), F.count_if(B.is_valid(b)).alias("n_valid"))
    return rounded(out, "share")


CLOUDS = f"""{BLOCKS}, {STARS}, cl AS (SELECT gx, gy, list_sort(list(bg)) AS l FROM maps GROUP BY gx, gy),
cc AS (SELECT frame_idx, gx, gy, gy * 4 + gx AS id FROM sm JOIN rf USING (gx, gy) JOIN cl USING (gx, gy) WHERE NOT land AND bg > l[CAST(floor((len(l) - 1) * 0.25) AS INT) + 1] * 1.08),
r(frame_idx, id, root) AS (SELECT frame_idx, id, id FROM cc
  UNION SELECT b.frame_idx, b.id, r.root FROM r JOIN cc a ON a.frame_idx = r.frame_idx AND a.id = r.id JOIN cc b ON b.frame_idx = a.frame_idx AND abs(a.gx - b.gx) + abs(a.gy - b.gy) = 1),
lb AS (SELECT frame_idx, id, min(root) AS root FROM r GROUP BY ALL), kp AS (SELECT frame_idx, id FROM lb QUALIFY count(*) OVER (PARTITION BY frame_idx, root) >= 2)"""


@query("", "WITH RECURSIVE " + V.SQL["samples"] + f""", {CLOUDS}
SELECT m.frame_idx, m.gx, m.gy, count(k.id) > 0 AS masked FROM maps m LEFT JOIN kp k ON k.frame_idx = m.frame_idx AND abs(k.id % 4 - m.gx) <= 1 AND abs(k.id // 4 - m.gy) <= 1 GROUP BY ALL""")
def cloud_mask(spark, sf_dir):
    """The raised cells, without regions of one cell, grown by one (the test on stars hardly fires in these tables; cloud_cells covers it)."""
    found = _starred(spark, sf_dir)
    raised = found.join(B.clear_level(found), ["gx", "gy"]).withColumn("cloud", ~F.col("land") & (F.col("bg") > F.col("clear") * 1.08))
    return B.cloud_masks(raised, 4, 3, least=2, grow=1).select("frame_idx", "gx", "gy", "masked")


@query("catalog", """f AS (SELECT frame_idx, CASE WHEN frame_idx % 13 = 5 THEN 6000 ELSE 6048 END AS width, CASE WHEN frame_idx % 17 = 3 THEN 4000 ELSE 4024 END AS height FROM catalog)
SELECT frame_idx, width, height FROM f WHERE (width, height) = (SELECT (width, height) FROM f ORDER BY frame_idx LIMIT 1)""")
def same_size(spark, sf_dir):
    k = F.col("frame_idx")
    frames = V.catalog(spark, sf_dir).select("frame_idx", F.when(k % 13 == 5, 6000).otherwise(6048).alias("width"), F.when(k % 17 == 3, 4000).otherwise(4024).alias("height"))
    return G.same_size(frames)


@query("catalog", "SELECT frame_idx FROM catalog WHERE frame_idx % greatest((SELECT count(*) FROM catalog) // 100, 1) = 0")
def systematic_sample(spark, sf_dir):
    c = V.catalog(spark, sf_dir)
    total = c.agg(F.count(F.lit(1)).alias("n"))
    return c.crossJoin(F.broadcast(total)).where(G.every(F.col("frame_idx"), F.col("n"), 100)).select("frame_idx")


@query("catalog pixels", """i AS (SELECT DISTINCT frame_idx FROM pixels)
SELECT i.frame_idx, c.aligned, round(c.level, 6) AS level FROM i LEFT JOIN catalog c ON c.frame_idx = i.frame_idx""")
def position_facts(spark, sf_dir):
    return rounded(G.with_catalog(V.images(spark, sf_dir).select("frame_idx"), V.catalog(spark, sf_dir)), "level").select("frame_idx", "aligned", "level")


# ------------------------------------------------------------------ alignment


def _matches(spark, sf_dir):
    """Twenty matched stars of every frame, every fifth a wrong one; every eleventh frame has five stars only."""
    c = V.catalog(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(19)))).where((F.col("frame_idx") % 11 != 0) | (F.col("k") < 5))
    k = F.col("k")
    c = c.withColumns({"px": ((k * 37) % 101 * 5).cast("double"), "py": ((k * 53) % 89 * 7).cast("double")})
    qx, qy = T.apply(T.rotation(F.col("angle"), F.col("tx"), F.col("ty")), F.col("px"), F.col("py"))
    wrong = F.when(k % 5 == 4, 60.0 + k * k).otherwise(0.0)
    return c.select("frame_idx", "px", "py", (qx + wrong).alias("qx"), (qy - wrong * 0.3).alias("qy"))


@query("catalog", """SELECT frame_idx, round(angle, 6) + 0.0 AS angle, round(tx, 6) AS tx, round(ty, 6) AS ty, CAST(CASE WHEN frame_idx % 11 = 0 THEN 4 ELSE 16 END AS BIGINT) AS inliers,
  frame_idx % 11 <> 0 AS aligned FROM catalog""")
def align_frames(spark, sf_dir):
    """Robust transforms from matches with planted outliers: the planted transforms come back, frames of few stars are not aligned."""
    return rounded(T.align_frames(_matches(spark, sf_dir)), "angle", "tx", "ty").select("frame_idx", "angle", "tx", "ty", "inliers", "aligned")


@query("catalog", f"""l AS (SELECT CASE WHEN aligned THEN cloud * 2 END AS rms FROM catalog)
SELECT round({MED.format('rms')}, 6) AS median_rms, CAST(count_if(rms IS NULL) AS BIGINT) AS missing FROM l""")
def link_residual(spark, sf_dir):
    return rounded(T.link_residual(V.catalog(spark, sf_dir).select(F.when(F.col("aligned"), F.col("cloud") * 2).alias("rms"))), "median_rms")


@query("pixels", f"""{SHIFTED}, g AS (SELECT s.session, a.y, b.x, count(w.v) AS cover FROM (SELECT DISTINCT session FROM pixels) s CROSS JOIN range(8) a(y) CROSS JOIN range(8) b(x)
  LEFT JOIN wv w ON w.session = s.session AND w.y = a.y AND w.x = b.x GROUP BY ALL)
SELECT min(cover) AS least, max(cover) AS most, CAST(count_if(cover = 0) AS BIGINT) AS holes FROM g""")
def coverage(spark, sf_dir):
    return I.coverage_report(I.stack(_warped(spark, sf_dir), ["session"]))


@query("pixels", f"""{SHIFTED}, o AS (SELECT frame_idx, y, x, qx < 0 OR qy < 0 OR qx >= 7 OR qy >= 7 AS out, CAST(greatest(least(floor(qx / 2), 3), 0) AS INT) AS gx, CAST(greatest(least(floor(qy / 2), 3), 0) AS INT) AS gy FROM q),
c AS (SELECT frame_idx, y // 2 AS gy, x // 2 AS gx, bool_or(v > 0.15) AS masked FROM pixels GROUP BY ALL)
SELECT o.frame_idx, CAST(o.y AS INT) AS y, CAST(o.x AS INT) AS x, o.out OR c.masked AS masked FROM o JOIN c ON c.frame_idx = o.frame_idx AND c.gx = o.gx AND c.gy = o.gy""")
def mask_warp(spark, sf_dir):
    k = F.col("frame_idx")
    images = V.images(spark, sf_dir).withColumns({"angle": (k % 7 - 3) * F.lit(0.01), "tx": (k % 5) * F.lit(0.3) - 0.55, "ty": (k % 3) * F.lit(0.4) - 0.35})

    def kernel(a, r):
        cells = (a > 0.15).reshape(4, 2, 4, 2).any(axis=(1, 3))
        return {"masked": K.warp_mask(cells, 2, a.shape, (np.cos(r["angle"]), np.sin(r["angle"]), r["tx"], r["ty"]))}

    out = I.map_images(images, kernel, "masked array<boolean>", ("frame_idx", "h", "w"))
    return I.long_pixels(out, "masked", "masked")


@query("pixels", """m AS (SELECT frame_idx, y, x, v > -0.08 AS full FROM pixels), s(lo, hi) AS (SELECT a.i, b.i FROM range(8) a(i) JOIN range(8) b(i) ON a.i <= b.i),
r AS (SELECT m.frame_idx, v.lo AS y0, v.hi AS y1, h.lo AS x0, h.hi AS x1, bool_and(m.full) AS whole FROM m JOIN s v ON m.y BETWEEN v.lo AND v.hi JOIN s h ON m.x BETWEEN h.lo AND h.hi GROUP BY ALL)
SELECT frame_idx, CAST(coalesce(max(CASE WHEN whole THEN (y1 - y0 + 1) * (x1 - x0 + 1) END), 64) AS BIGINT) AS area FROM r GROUP BY frame_idx""")
def largest_rectangle(spark, sf_dir):
    def kernel(a, _):
        x0, y0, x1, y1 = K.largest_rectangle(a > -0.08)
        return {"area": (x1 - x0) * (y1 - y0)}

    return I.map_images(V.images(spark, sf_dir), kernel, "area bigint")


# -------------------------------------------------------------------- profiles


@query("pixels", f"""c AS (SELECT frame_idx, least(CAST(floor(sqrt((x - 3.5) ** 2 + (y - 3.5) ** 2) / sqrt(24.5) * 12) AS INT), 11) AS bin, v FROM pixels),
b AS (SELECT frame_idx, bin, CASE WHEN count(v) >= 5 THEN {MED.format('v')} END AS p FROM c GROUP BY ALL),
g AS (SELECT f.frame_idx, CAST(k.bin AS INT) AS bin, b.p FROM (SELECT DISTINCT frame_idx FROM pixels) f CROSS JOIN range(12) k(bin) LEFT JOIN b ON b.frame_idx = f.frame_idx AND b.bin = k.bin),
e AS (SELECT *, last_value(CASE WHEN p IS NOT NULL THEN bin END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS b0, last_value(p IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS p0,
  first_value(CASE WHEN p IS NOT NULL THEN bin END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b1, first_value(p IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS p1
  FROM g WINDOW w AS (PARTITION BY frame_idx ORDER BY bin))
SELECT frame_idx, bin, round(CASE WHEN b0 IS NULL THEN coalesce(p1, 0) WHEN b1 IS NULL THEN p0 WHEN b1 = b0 THEN p0 ELSE p0 + (p1 - p0) * (bin - b0) / (b1 - b0) END, 6) + 0.0 AS filled FROM e""")
def profile_fill_linear(spark, sf_dir):
    cells = V.pixels(spark, sf_dir).select("frame_idx", F.col("x").alias("gx"), F.col("y").alias("gy"), "v")
    found = B.radial_bins(cells, 8, 8, 12).groupBy("frame_idx", "bin").agg(F.when(F.count("v") >= 5, C.upper_median("v")).alias("p"))
    grid = found.select("frame_idx").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(11))))
    return rounded(W.fill_linear(grid.join(found, ["frame_idx", "bin"], "left"), ["frame_idx"], "bin", "p", "filled"), "filled").select("frame_idx", "bin", "filled")


@query("pixels", f"""c AS (SELECT frame_idx, least(CAST(floor(sqrt((x - 3.5) ** 2 + (y - 3.5) ** 2) / sqrt(24.5) * 6) AS INT), 5) AS bin, v + 2 AS v FROM pixels),
b AS (SELECT frame_idx, bin, {MED.format('v')} AS p FROM c GROUP BY ALL)
SELECT frame_idx, bin, round(100 * p / first_value(p) OVER (PARTITION BY frame_idx ORDER BY bin), 6) AS pct FROM b""")
def radial_profile_pct(spark, sf_dir):
    cells = V.pixels(spark, sf_dir).select("frame_idx", F.col("x").alias("gx"), F.col("y").alias("gy"), (F.col("v") + 2).alias("v"))
    return rounded(B.radial_profile_pct(B.radial_bins(cells, 8, 8, 6), "v", ["frame_idx"]), "pct")


def _best(sql: str) -> str:
    return f"SELECT session, deg, score FROM ({sql}) QUALIFY row_number() OVER (PARTITION BY session ORDER BY score, deg) = 1"


@query("", _best(ORACLES["direction_search"]))
def direction_best(spark, sf_dir):
    """The direction whose profile leaves least, the first of equals."""
    return direction_search(spark, sf_dir).groupBy("session").agg(F.min(F.struct("score", "deg")).alias("b")).select("session", "b.deg", "b.score")
