"""Registered queries of the session operators, each with its SQL for DuckDB.

Every computed column is rounded on both sides, as sums are taken in another order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import kernels as K
from ..operators import background as B
from ..operators import catalog as G
from ..operators import field as L
from ..operators import geometry as T
from ..operators import images as I
from ..operators import models as M
from ..operators import solvers as S
from ..operators import windows as W
from . import views as V
from .session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(views: str = "", sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(ship(spark), sf_dir)
        if sql:
            ORACLES[f.__name__] = V.with_views(views, sql) if views else sql
        return f

    return register


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), places) + F.lit(0.0) for n in names})


#: Upper median, and the clipped background of a block, in DuckDB.
MED = "percentile_disc(0.5) WITHIN GROUP (ORDER BY {} DESC)"
BLOCKS = f"""m AS (SELECT frame_idx, gx, gy, {MED.format('v')} AS med, count(*) AS n FROM samples GROUP BY ALL),
d AS (SELECT s.frame_idx, s.gx, s.gy, {MED.format('abs(s.v - m.med)')} AS mad FROM samples s JOIN m USING (frame_idx, gx, gy) GROUP BY ALL),
k AS (SELECT s.frame_idx, s.gx, s.gy, count(*) AS kept, {MED.format('s.v')} AS clipped
  FROM samples s JOIN m USING (frame_idx, gx, gy) JOIN d USING (frame_idx, gx, gy) WHERE s.v <= m.med + 3 * d.mad GROUP BY ALL),
bg AS (SELECT m.frame_idx, m.gx, m.gy, m.n, CASE WHEN d.mad <= 0 OR k.kept < m.n // 2 THEN m.med ELSE k.clipped END AS bg
  FROM m JOIN d USING (frame_idx, gx, gy) LEFT JOIN k USING (frame_idx, gx, gy)),
sp AS (SELECT s.frame_idx, s.gx, s.gy, {MED.format('abs(s.v - b.bg)')} AS noise FROM samples s JOIN bg b USING (frame_idx, gx, gy) GROUP BY ALL),
maps AS (SELECT b.frame_idx, b.gx, b.gy, b.bg, sp.noise, b.n,
    (SELECT count(*) FROM samples s WHERE s.frame_idx = b.frame_idx AND s.gx = b.gx AND s.gy = b.gy AND s.v > b.bg + 4 * sp.noise) / b.n - 0.0035 AS star
  FROM bg b JOIN sp USING (frame_idx, gx, gy))"""

#: Cells that the session queries treat as masked or land: a fixed pattern.
MASKED = "(frame_idx + gx + gy) % 5 = 0"


def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.block_background(V.samples(spark, sf_dir))


@query("samples", f"{BLOCKS} SELECT frame_idx, gx, gy, round(bg, 6) AS bg, round(noise, 6) AS noise, n FROM maps")
def block_background(spark, sf_dir):
    return rounded(maps(spark, sf_dir), "bg", "noise").select("frame_idx", "gx", "gy", "bg", "noise", F.col("n").cast("long").alias("n"))


@query("samples", f"{BLOCKS} SELECT frame_idx, gx, gy, round(star, 6) AS star FROM maps")
def star_fraction(spark, sf_dir):
    return rounded(maps(spark, sf_dir), "star").select("frame_idx", "gx", "gy", "star")


@query("samples", f"{BLOCKS} SELECT frame_idx, round(coalesce({MED.format(f'CASE WHEN NOT ({MASKED}) THEN bg END')}, 0), 6) AS level FROM maps GROUP BY frame_idx")
def sky_level(spark, sf_dir):
    return rounded(B.sky_level(maps(spark, sf_dir), masked=F.expr(MASKED)), "level")


TEMPORAL = f"""t AS (SELECT gx, gy, {MED.format(f'CASE WHEN NOT ({MASKED}) THEN bg END')} AS v,
  count(CASE WHEN NOT ({MASKED}) THEN bg END) AS n FROM maps GROUP BY gx, gy)"""


@query("samples", f"{BLOCKS}, {TEMPORAL} SELECT gx, gy, round(v, 6) AS v, n, n >= 5 AS valid FROM t")
def masked_temporal_median(spark, sf_dir):
    return rounded(B.temporal_median(maps(spark, sf_dir), masked=F.expr(MASKED)), "v")


@query(
    "samples",
    f"""{BLOCKS}, {TEMPORAL}, u AS (SELECT gx, gy, v, (gx + gy) % 3 <> 0 AS valid FROM t)
SELECT a.gx, a.gy, round(CASE WHEN a.valid THEN a.v ELSE avg(b.v) END, 6) AS v, NOT a.valid AND avg(b.v) IS NOT NULL AS filled
FROM u a LEFT JOIN u b ON b.valid AND abs(a.gx - b.gx) <= 1 AND abs(a.gy - b.gy) <= 1 AND (a.gx <> b.gx OR a.gy <> b.gy)
GROUP BY a.gx, a.gy, a.v, a.valid""",
)
def neighbour_fill(spark, sf_dir):
    cells = B.temporal_median(maps(spark, sf_dir), masked=F.expr(MASKED)).withColumn("valid", F.expr("(gx + gy) % 3 <> 0"))
    return rounded(B.fill_neighbours(cells), "v").select("gx", "gy", "v", "filled")


@query(
    "samples",
    f"""{BLOCKS}, {TEMPORAL},
lv AS (SELECT frame_idx, coalesce({MED.format('bg')}, 0) AS level FROM maps GROUP BY frame_idx),
md AS (SELECT {MED.format('CASE WHEN level > 0 THEN level END')} AS med FROM lv),
kept AS (SELECT frame_idx FROM lv, md WHERE level <= med * 1.6 AND level >= med / 1.6)
SELECT frame_idx, gx, gy, round(bg - v, 6) AS anomaly FROM maps JOIN kept USING (frame_idx) JOIN t USING (gx, gy) WHERE t.n >= 5""",
)
def session_background(spark, sf_dir):
    """The flagship: block backgrounds, sky levels, frames near the session's level, session map, anomalies."""
    found = maps(spark, sf_dir)
    levels = B.sky_level(found)
    frames = levels.withColumns({"aligned": F.lit(True), "fg": F.lit(0.0), "cloud": F.lit(0.0)})
    kept = G.stack_selection(frames).where("in_stack").select("frame_idx")
    session = B.temporal_median(found, masked=F.expr(MASKED))
    return rounded(B.anomaly(found.join(kept, "frame_idx"), session), "anomaly").select("frame_idx", "gx", "gy", "anomaly")


@query("samples", f"{BLOCKS} SELECT gx, gy, count_if(bg > 55) > count(*) // 2 AS masked FROM maps GROUP BY gx, gy")
def consensus_mask(spark, sf_dir):
    return B.consensus_mask(maps(spark, sf_dir).withColumn("masked", F.col("bg") > 55))


@query("samples", f"""{BLOCKS}, s AS (SELECT gx, gy, list_sort(list(bg)) AS l FROM maps GROUP BY gx, gy)
SELECT gx, gy, round(l[CAST(floor((len(l) - 1) * 0.25) AS INT) + 1], 6) AS clear FROM s""")
def clear_level(spark, sf_dir):
    return rounded(B.clear_level(maps(spark, sf_dir)), "clear")


STARS = f"""sm AS (SELECT a.frame_idx, a.gx, a.gy, a.bg, a.star, (SELECT avg(b.star) FROM maps b
    WHERE b.frame_idx = a.frame_idx AND abs(b.gx - a.gx) <= 2 AND abs(b.gy - a.gy) <= 2) AS smooth, a.gx = 0 AND a.gy = 2 AS land FROM maps a),
pc AS (SELECT gx, gy, {MED.format('smooth')} AS s FROM sm WHERE NOT land GROUP BY gx, gy),
rd AS (SELECT gx, gy, hypot_ AS radius, least(CAST(floor(hypot_ * 4) AS INT), 3) AS bin
  FROM (SELECT gx, gy, sqrt((gx - 1.5) ** 2 + (gy - 1.0) ** 2) / sqrt(1.5 ** 2 + 1.0) AS hypot_ FROM (SELECT DISTINCT gx, gy FROM maps))),
pr AS (SELECT b.bin, (SELECT CASE WHEN count(*) >= 2 THEN {MED.format('pc.s')} END FROM pc JOIN rd USING (gx, gy) WHERE rd.bin = b.bin) AS p FROM range(4) b(bin)),
pf AS (SELECT bin, coalesce(last_value(p IGNORE NULLS) OVER (ORDER BY bin ROWS UNBOUNDED PRECEDING),
  first_value(p IGNORE NULLS) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p FROM pr),
rf AS (SELECT gx, gy, a.p * (1 - t) + b.p * t AS reference FROM (SELECT gx, gy,
    greatest(least(CAST(floor(radius * 4 - 0.5) AS INT), 2), 0) AS j,
    greatest(least(radius * 4 - 0.5 - greatest(least(CAST(floor(radius * 4 - 0.5) AS INT), 2), 0), 1.0), 0.0) AS t FROM rd)
  JOIN pf a ON a.bin = j JOIN pf b ON b.bin = j + 1)"""


def _starred(spark, sf_dir):
    return maps(spark, sf_dir).withColumns({"land": F.expr("gx = 0 AND gy = 2"), "valid": F.lit(True)})


@query("samples", f"{BLOCKS}, {STARS} SELECT gx, gy, round(reference, 6) AS reference FROM rf")
def star_reference(spark, sf_dir):
    return rounded(B.star_reference(_starred(spark, sf_dir), 4, 3, bins=4, least=2), "reference")


@query(
    "samples",
    f"""{BLOCKS}, {STARS}, cl AS (SELECT gx, gy, list_sort(list(bg)) AS l FROM maps GROUP BY gx, gy)
SELECT frame_idx, gx, gy, coalesce(NOT land AND reference > 0 AND smooth < 0.35 * reference
  AND smooth < reference - 4 * sqrt(greatest(least(reference + 0.0035, 1 - 1e-6), 1e-6) * (1 - greatest(least(reference + 0.0035, 1 - 1e-6), 1e-6)) / 100.0)
  AND bg > l[CAST(floor((len(l) - 1) * 0.25) AS INT) + 1] * 1.08, false) AS cloud
FROM sm JOIN rf USING (gx, gy) JOIN cl USING (gx, gy)""",
)
def cloud_cells(spark, sf_dir):
    found = _starred(spark, sf_dir)
    out = B.cloud_cells(found, B.star_reference(found, 4, 3, bins=4, least=2), B.clear_level(found), block=2)
    return out.select("frame_idx", "gx", "gy", "cloud")


# ------------------------------------------------------------------ catalog

FACTS = f"""f AS (SELECT {MED.format('CASE WHEN level > 0 THEN level END')} AS med, count(*) AS n, count_if(aligned AND fg <= 0) AS clear FROM catalog),
sel AS (SELECT c.*, CASE WHEN NOT aligned THEN 'unaligned' WHEN fg > CASE WHEN clear < greatest(n // 5, 1) THEN 0.6 ELSE 0 END THEN 'foreground'
  WHEN cloud > 0.5 THEN 'cloud' WHEN med > 0 AND level > med * 1.6 THEN 'bright' WHEN med > 0 AND level < med / 1.6 THEN 'dark' END AS reject_reason,
  level < 0.85 AS export FROM catalog c, f)"""


@query("catalog", f"{FACTS} SELECT frame_idx, reject_reason, reject_reason IS NULL AS in_stack, export FROM sel")
def stack_selection(spark, sf_dir):
    return G.stack_selection(V.catalog(spark, sf_dir)).select("frame_idx", "reject_reason", "in_stack", "export")


@query(
    "catalog",
    f"""{FACTS} SELECT count(*) AS n_frames, CAST(count_if(reject_reason IS NULL) AS BIGINT) AS n_stack, CAST(count_if(NOT export) AS BIGINT) AS n_saturated,
  CAST(count_if(cloud > 0.05) AS BIGINT) AS n_clouded, CAST(count_if(fg > 0) AS BIGINT) AS n_with_foreground, CAST(count_if(reject_reason = 'unaligned') AS BIGINT) AS n_unaligned,
  CAST(count_if(reject_reason = 'foreground') AS BIGINT) AS n_foreground, CAST(count_if(reject_reason = 'cloud') AS BIGINT) AS n_cloud,
  CAST(count_if(reject_reason = 'bright') AS BIGINT) AS n_bright, CAST(count_if(reject_reason = 'dark') AS BIGINT) AS n_dark FROM sel""",
)
def selection_report(spark, sf_dir):
    return G.selection_report(G.stack_selection(V.catalog(spark, sf_dir)))


@query(
    "catalog",
    f"""{FACTS}, r AS (SELECT *, row_number() OVER (ORDER BY cloud, frame_idx) AS rk FROM sel WHERE reject_reason IS NULL),
c AS (SELECT count_if(reject_reason IS NULL AND cloud <= 0.02) AS clear, count_if(reject_reason IS NULL) AS stack FROM sel)
SELECT s.frame_idx, (s.reject_reason IS NULL AND s.cloud <= 0.02) OR (c.clear < least(5000, c.stack) AND coalesce(r.rk <= 5000, false)) AS in_model
FROM sel s CROSS JOIN c LEFT JOIN r USING (frame_idx)""",
)
def model_frames(spark, sf_dir):
    return G.model_frames(G.stack_selection(V.catalog(spark, sf_dir)), least=5000).select("frame_idx", "in_model")


@query(
    "catalog",
    f"""{FACTS}, m AS (SELECT {MED.format('level')} AS med FROM sel WHERE reject_reason IS NULL)
SELECT frame_idx, round(level, 6) AS level, round(abs(level - med), 6) AS distance FROM sel, m WHERE reject_reason IS NULL
ORDER BY abs(level - med), frame_idx LIMIT 1""",
)
def levels_reference(spark, sf_dir):
    return rounded(G.levels_reference(G.stack_selection(V.catalog(spark, sf_dir))), "level", "distance")


@query(
    "catalog",
    f"""{FACTS}, m AS (SELECT {MED.format('level')} AS med FROM sel WHERE level > 0)
SELECT frame_idx, row_number() OVER (ORDER BY frame_idx) - 1 AS position FROM sel, m
WHERE level < 0.85 AND NOT (level >= 0.7 AND med > 0 AND level / med >= 2.3)""",
)
def export_order(spark, sf_dir):
    return G.export_order(G.stack_selection(V.catalog(spark, sf_dir)), white=0.7, stabilise=True).select("frame_idx", "position")


PREDICT = """nb AS (SELECT c.*, list(CASE WHEN aligned THEN {'at': frame_idx, 'angle': angle, 'tx': tx, 'ty': ty} END) OVER b AS lb,
  list(CASE WHEN aligned THEN {'at': frame_idx, 'angle': angle, 'tx': tx, 'ty': ty} END) OVER a AS la FROM catalog c
  WINDOW b AS (ORDER BY frame_idx RANGE BETWEEN 6 PRECEDING AND 1 PRECEDING), a AS (ORDER BY frame_idx RANGE BETWEEN 1 FOLLOWING AND 6 FOLLOWING)),
nf AS (SELECT * EXCLUDE (lb, la), list_filter(coalesce(lb, []), lambda e: e IS NOT NULL) AS lb, list_filter(coalesce(la, []), lambda e: e IS NOT NULL) AS la FROM nb),
ends AS (SELECT *, CASE WHEN len(lb) > 0 AND len(la) > 0 THEN lb[-1] WHEN len(lb) > 1 THEN lb[-2] WHEN len(lb) = 1 THEN lb[-1] ELSE la[1] END AS p,
  CASE WHEN len(lb) > 0 AND len(la) > 0 THEN la[1] WHEN len(lb) > 0 THEN lb[-1] WHEN len(la) > 1 THEN la[2] ELSE la[1] END AS q FROM nf),
pt AS (SELECT *, CASE WHEN q.at = p.at THEN 0 ELSE (frame_idx - p.at) / (q.at - p.at) END AS share FROM ends),
pred AS (SELECT *, p.angle + (q.angle - p.angle) * share AS pa, p.tx + (q.tx - p.tx) * share AS px, p.ty + (q.ty - p.ty) * share AS py FROM pt)"""


@query("catalog", f"{PREDICT} SELECT frame_idx, round(pa, 6) AS angle, round(px, 6) AS tx, round(py, 6) AS ty FROM pred")
def predict_transform(spark, sf_dir):
    out = T.predict(V.catalog(spark, sf_dir)).select("frame_idx", "predicted.*")
    return rounded(out, "angle", "tx", "ty")


@query(
    "catalog",
    f"""{PREDICT}, dev AS (SELECT frame_idx, aligned, (SELECT max(sqrt((cos(angle) * x - sin(angle) * y + tx - cos(pa) * x + sin(pa) * y - px) ** 2
  + (sin(angle) * x + cos(angle) * y + ty - sin(pa) * x - cos(pa) * y - py) ** 2)) FROM (VALUES (0, 0), (600, 0), (0, 400), (600, 400)) c(x, y)) AS d FROM pred)
SELECT frame_idx, round(CASE WHEN aligned THEN d END, 6) AS deviation, coalesce(aligned AND d > 6, false) AS suspect FROM dev""",
)
def corner_deviation(spark, sf_dir):
    return rounded(T.implausible(V.catalog(spark, sf_dir), 600.0, 400.0), "deviation").select("frame_idx", "deviation", "suspect")


@query(
    "catalog",
    """l AS (SELECT frame_idx, angle AS a1, tx AS x1, ty AS y1, aligned AS g1, lead(angle) OVER w AS a2, lead(tx) OVER w AS x2, lead(ty) OVER w AS y2, lead(aligned) OVER w AS g2,
  lead(angle, 2) OVER w AS a3, lead(tx, 2) OVER w AS x3, lead(ty, 2) OVER w AS y3, lead(aligned, 2) OVER w AS g3 FROM catalog WINDOW w AS (ORDER BY frame_idx)),
m AS (SELECT *, cos(a2) * x1 - sin(a2) * y1 + x2 AS x12, sin(a2) * x1 + cos(a2) * y1 + y2 AS y12 FROM l),
r AS (SELECT frame_idx, g1 AND g2 AND g3 AS ok, a1 + a2 + a3 AS a, cos(a3) * x12 - sin(a3) * y12 + x3 AS x, sin(a3) * x12 + cos(a3) * y12 + y3 AS y FROM m)
SELECT frame_idx, round(CASE WHEN ok THEN degrees(atan2(sin(a), cos(a))) END, 6) AS angle, round(CASE WHEN ok THEN x END, 6) AS tx, round(CASE WHEN ok THEN y END, 6) AS ty FROM r""",
)
def sky_chain(spark, sf_dir):
    c = V.catalog(spark, sf_dir)
    links = c.select("frame_idx", F.when(F.col("aligned"), T.rotation(F.col("angle"), F.col("tx"), F.col("ty"))).alias("m"))
    out = T.chain(links, 3)
    return rounded(out.select("frame_idx", T.angle_degrees(F.col("chained")).alias("angle"), "chained.tx", "chained.ty"), "angle", "tx", "ty")


# --------------------------------------------------------------------- stars

TRIANGLES = """e AS (SELECT i.frame_idx, i.star_id AS i, j.star_id AS j, k.star_id AS k, list_sort([
    {'d': sqrt((i.x - j.x) ** 2 + (i.y - j.y) ** 2), 'r': 0, 'c': k.star_id},
    {'d': sqrt((j.x - k.x) ** 2 + (j.y - k.y) ** 2), 'r': 1, 'c': i.star_id},
    {'d': sqrt((i.x - k.x) ** 2 + (i.y - k.y) ** 2), 'r': 2, 'c': j.star_id}]) AS s
  FROM points i JOIN points j ON i.frame_idx = j.frame_idx AND i.star_id < j.star_id JOIN points k ON j.frame_idx = k.frame_idx AND j.star_id < k.star_id),
tri AS (SELECT frame_idx, s[1].c AS a, s[2].c AS b, s[3].c AS c, s[1].d / s[3].d AS inv0, s[2].d / s[3].d AS inv1 FROM e WHERE s[3].d >= 1e-3),
hits AS (SELECT p.frame_idx, p.a, p.b, p.c, q.a AS a2, q.b AS b2, q.c AS c2 FROM tri p JOIN tri q ON q.frame_idx = p.frame_idx + 1
  WHERE abs(p.inv0 - q.inv0) < 0.004 AND abs(p.inv1 - q.inv1) < 0.004),
votes AS (SELECT frame_idx, ref_star, cur_star, count(*) AS votes FROM (SELECT frame_idx, a AS ref_star, a2 AS cur_star FROM hits
  UNION ALL SELECT frame_idx, b, b2 FROM hits UNION ALL SELECT frame_idx, c, c2 FROM hits) GROUP BY ALL)"""


@query("points", f"{TRIANGLES} SELECT frame_idx, ref_star, cur_star, votes FROM votes")
def triangle_votes(spark, sf_dir):
    return T.triangle_votes(V.points(spark, sf_dir))


@query("points", f"""{TRIANGLES} SELECT frame_idx, ref_star, cur_star, votes FROM votes
QUALIFY row_number() OVER (PARTITION BY frame_idx, ref_star ORDER BY votes DESC, cur_star DESC) = 1""")
def star_matches(spark, sf_dir):
    return T.best_matches(T.triangle_votes(V.points(spark, sf_dir)), least=1)


@query("points", """g AS (SELECT p.frame_idx, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy FROM points p JOIN points q ON q.frame_idx = p.frame_idx + 1 AND q.star_id = p.star_id),
s AS (SELECT frame_idx, count(*) AS n, avg(px) AS mpx, avg(py) AS mpy, avg(qx) AS mqx, avg(qy) AS mqy FROM g GROUP BY frame_idx HAVING count(*) >= 3),
t AS (SELECT g.frame_idx, s.n, mpx, mpy, mqx, mqy, atan2(sum((px - mpx) * (qy - mqy) - (py - mpy) * (qx - mqx)), sum((px - mpx) * (qx - mqx) + (py - mpy) * (qy - mqy))) AS a
  FROM g JOIN s USING (frame_idx) GROUP BY ALL)
SELECT frame_idx, n, round(a, 4) AS angle, round(mqx - (cos(a) * mpx - sin(a) * mpy), 2) AS tx, round(mqy - (sin(a) * mpx + cos(a) * mpy), 2) AS ty FROM t""")
def rigid_fit(spark, sf_dir):
    p = V.points(spark, sf_dir)
    q = p.select((F.col("frame_idx") - 1).alias("frame_idx"), "star_id", F.col("x").alias("qx"), F.col("y").alias("qy"))
    pairs = p.select("frame_idx", "star_id", F.col("x").alias("px"), F.col("y").alias("py")).join(q, ["frame_idx", "star_id"])
    out = T.rigid_fit(pairs, ["frame_idx"]).where("n >= 3")
    return rounded(rounded(out, "angle", places=4), "tx", "ty", places=2)


# ------------------------------------------------------------------- windows


@query(
    "samples",
    f"""{BLOCKS}, kk AS (SELECT frame_idx, gx, gy, bg, {MASKED} AS masked, CASE WHEN NOT ({MASKED}) THEN bg END AS v FROM maps),
a AS (SELECT *, sum(v) OVER w AS s, min(v) OVER w AS lo, max(v) OVER w AS hi, count(v) OVER w AS n_used FROM kk
  WINDOW w AS (PARTITION BY gx, gy ORDER BY frame_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
SELECT frame_idx, gx, gy, round(CASE WHEN masked THEN bg WHEN n_used >= 4 THEN (s - lo - hi) / (n_used - 2) WHEN n_used > 0 THEN s / n_used ELSE bg END, 6) AS combined, n_used FROM a""",
)
def trimmed_window(spark, sf_dir):
    out = W.trimmed_window(maps(spark, sf_dir), ["gx", "gy"], "frame_idx", "bg", F.expr(MASKED), 6)
    return rounded(out, "combined").select("frame_idx", "gx", "gy", "combined", "n_used")


@query(
    "samples",
    f"""{BLOCKS}, a AS (SELECT frame_idx, gx, gy, bg, list_sort(list(bg) OVER w) AS l FROM maps
  WINDOW w AS (PARTITION BY gx, gy ORDER BY frame_idx ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING))
SELECT frame_idx, gx, gy, round(bg - l[len(l) // 2 + 1], 6) + 0.0 AS fine FROM a""",
)
def highpass_median(spark, sf_dir):
    out = W.highpass_median(maps(spark, sf_dir), ["gx", "gy"], "frame_idx", "bg", 9)
    return rounded(out, "fine").select("frame_idx", "gx", "gy", "fine")


BLUR = """bh AS (SELECT frame_idx, y, x, v, avg(v) OVER (PARTITION BY frame_idx, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS h FROM pixels),
bl AS (SELECT frame_idx, y, x, v, avg(h) OVER (PARTITION BY frame_idx, x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS b FROM bh)"""


@query("pixels", f"{BLUR} SELECT frame_idx, y, x, round(b, 6) + 0.0 AS v FROM bl")
def box_blur(spark, sf_dir):
    return rounded(I.long_pixels(I.box_blur(V.images(spark, sf_dir), 2)), "v")


@query("pixels", f"{BLUR} SELECT frame_idx, y, x, round(v - b, 6) + 0.0 AS v FROM bl")
def highpass(spark, sf_dir):
    return rounded(I.long_pixels(I.highpass(V.images(spark, sf_dir), 2)), "v")


@query("pixels", "SELECT frame_idx, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, round(avg(v), 6) + 0.0 AS v FROM pixels GROUP BY ALL")
def downsample(spark, sf_dir):
    return rounded(I.long_pixels(I.downsample(V.images(spark, sf_dir), 2)), "v")


@query(
    "pixels",
    """SELECT a.frame_idx, a.x AS gx, a.y AS gy, round(avg(b.v), 6) + 0.0 AS mean, count(*) AS n FROM pixels a JOIN pixels b
ON a.frame_idx = b.frame_idx AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 GROUP BY ALL""",
)
def window_means(spark, sf_dir):
    cells = V.pixels(spark, sf_dir).select("frame_idx", F.col("x").alias("gx"), F.col("y").alias("gy"), "v")
    return rounded(W.window_means(cells, ["frame_idx"], 2, "v"), "mean").select("frame_idx", "gx", "gy", "mean", "n")


RADIAL = f"""c AS (SELECT frame_idx, least(CAST(floor(sqrt((x - 3.5) ** 2 + (y - 3.5) ** 2) / sqrt(24.5) * 12) AS INT), 11) AS bin, v FROM pixels),
b AS (SELECT frame_idx, bin, CASE WHEN count(v) >= 4 THEN {MED.format('v')} END AS p FROM c GROUP BY ALL),
g AS (SELECT f.frame_idx, CAST(k.bin AS INT) AS bin, b.p FROM (SELECT DISTINCT frame_idx FROM pixels) f CROSS JOIN range(12) k(bin) LEFT JOIN b ON b.frame_idx = f.frame_idx AND b.bin = k.bin),
pf AS (SELECT frame_idx, bin, coalesce(last_value(p IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING),
  first_value(p IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p FROM g WINDOW w AS (PARTITION BY frame_idx ORDER BY bin))"""


def _radial(spark, sf_dir):
    cells = V.pixels(spark, sf_dir).select("frame_idx", F.col("x").alias("gx"), F.col("y").alias("gy"), "v")
    return B.radial_profile(B.radial_bins(cells, 8, 8, 12), "v", 12, 4, ["frame_idx"])


@query("pixels", f"{RADIAL} SELECT frame_idx, bin, round(p, 6) + 0.0 AS p FROM pf")
def radial_profile_fill(spark, sf_dir):
    return rounded(_radial(spark, sf_dir), "p")


@query("pixels", f"{RADIAL} SELECT frame_idx, bin, round(min(p) OVER (PARTITION BY frame_idx ORDER BY bin), 6) + 0.0 AS least FROM pf")
def running_min_profile(spark, sf_dir):
    return rounded(W.running_min(_radial(spark, sf_dir), ["frame_idx"], "bin", "p", "least"), "least").select("frame_idx", "bin", "least")


@query("pixels", """m AS (SELECT frame_idx, y, x, v > 0.15 AS masked FROM pixels)
SELECT a.frame_idx, a.y AS gy, a.x AS gx, bool_or(b.masked) AS grown FROM m a JOIN m b ON a.frame_idx = b.frame_idx AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL""")
def mask_dilate(spark, sf_dir):
    cells = V.pixels(spark, sf_dir).select("frame_idx", F.col("x").alias("gx"), F.col("y").alias("gy"), (F.col("v") > 0.15).alias("masked"))
    return B.dilate_cells(cells, 1, ["frame_idx"]).select("frame_idx", "gy", "gx", "grown")


@query(
    "",
    "WITH RECURSIVE " + V.SQL["pixels"] + """,
m AS (SELECT frame_idx, y, x, y * 8 + x AS id FROM pixels WHERE v > 0.02),
r(frame_idx, id, root) AS (SELECT frame_idx, id, id FROM m
  UNION SELECT b.frame_idx, b.id, r.root FROM r JOIN m a ON a.frame_idx = r.frame_idx AND a.id = r.id JOIN m b ON b.frame_idx = a.frame_idx AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
l AS (SELECT frame_idx, id, min(root) AS root FROM r GROUP BY ALL)
SELECT frame_idx, CAST(root AS BIGINT) AS region, count(*) AS cells, count(*) >= 3 AS kept FROM l GROUP BY ALL""",
)
def components(spark, sf_dir):
    found = I.map_images(V.images(spark, sf_dir), lambda a, _: {"labels": K.label(a > 0.02)}, "labels array<bigint>")
    cells = found.select("frame_idx", F.explode("labels").alias("region")).where("region >= 0")
    return cells.groupBy("frame_idx", "region").agg(F.count(F.lit(1)).alias("cells")).withColumn("kept", F.col("cells") >= 3)


# --------------------------------------------------------------- regressions

SLOPES = f"""{BLOCKS}, lv AS (SELECT frame_idx, {MED.format('bg')} AS level FROM maps GROUP BY frame_idx),
p0 AS (SELECT gx, gy, level AS x, bg AS y FROM maps JOIN lv USING (frame_idx) WHERE level > 0),
f1 AS (SELECT gx, gy, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM p0 GROUP BY gx, gy),
r1 AS (SELECT p0.*, abs(y - a - b * x) AS r FROM p0 JOIN f1 USING (gx, gy)),
d1 AS (SELECT gx, gy, greatest({MED.format('r')}, 1e-9) AS mad FROM r1 GROUP BY gx, gy),
f2 AS (SELECT gx, gy, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM r1 JOIN d1 USING (gx, gy) WHERE r <= 2.5 * mad GROUP BY gx, gy),
r2 AS (SELECT p0.*, abs(y - a - b * x) AS r FROM p0 JOIN f2 USING (gx, gy)),
d2 AS (SELECT gx, gy, greatest({MED.format('r')}, 1e-9) AS mad FROM r2 GROUP BY gx, gy),
f3 AS (SELECT gx, gy, regr_slope(y, x) AS b FROM r2 JOIN d2 USING (gx, gy) WHERE r <= 2.5 * mad GROUP BY gx, gy)"""


@query("samples", f"{SLOPES} SELECT gx, gy, round(CASE WHEN f3.b > 0 AND f1.n >= 12 THEN f3.b END, 5) AS slope, f1.n FROM f1 JOIN f3 USING (gx, gy)")
def robust_slope(spark, sf_dir):
    found = maps(spark, sf_dir)
    cells = found.join(B.sky_level(found), "frame_idx")
    return rounded(L.robust_slope(cells, ["gx", "gy"], "level", "bg"), "slope", places=5).select("gx", "gy", "slope", "n")


GRID = f"t AS (SELECT session, y AS gy, x AS gx, frame_idx % 2 AS half, {MED.format('v')} AS v FROM pixels GROUP BY ALL)"


def _grid(spark, sf_dir, by=("session",)):
    p = V.pixels(spark, sf_dir).withColumn("half", F.col("frame_idx") % 2)
    return p.groupBy(*by, F.col("y").alias("gy"), F.col("x").alias("gx")).agg(C.upper_median("v").alias("v"))


@query(
    "pixels",
    f"""{GRID}, l AS (SELECT session, half, {MED.format('v')} AS level FROM t GROUP BY ALL),
c AS (SELECT session, gx, gy, half, v - level AS v FROM t JOIN l USING (session, half)),
j AS (SELECT a.session, a.gx, a.gy, a.v AS a, b.v AS b FROM c a JOIN c b ON a.session = b.session AND a.gx = b.gx AND a.gy = b.gy WHERE a.half = 0 AND b.half = 1)
SELECT session, gx, gy, round(CASE WHEN a * b > 0 THEN sign(a) * least(abs(a), abs(b)) ELSE 0 END, 6) + 0.0 AS v FROM j""",
)
def agreed_grid(spark, sf_dir):
    halves = _grid(spark, sf_dir, ("session", "half"))
    level = halves.groupBy("session", "half").agg(C.upper_median("v").alias("level"))
    about = halves.join(level, ["session", "half"]).select("session", "half", "gx", "gy", (F.col("v") - F.col("level")).alias("v"))
    one, two = (about.where(F.col("half") == k).select("session", "gx", "gy", F.col("v").alias(n)) for k, n in ((0, "a"), (1, "b")))
    return rounded(one.join(two, ["session", "gx", "gy"]).select("session", "gx", "gy", C.same_sign_least(F.col("a"), F.col("b")).alias("v")), "v")


RESID = f"""t AS (SELECT session, y AS gy, x AS gx, {MED.format('v')} AS v FROM pixels GROUP BY ALL),
lv AS (SELECT session, {MED.format('v')} AS level FROM t GROUP BY session), rs AS (SELECT session, gx, gy, v - level AS r FROM t JOIN lv USING (session)),
md AS (SELECT session, greatest({MED.format('abs(r)')}, 1e-9) AS mad FROM rs GROUP BY session)"""


def _resid(spark, sf_dir):
    grid = _grid(spark, sf_dir)
    level = grid.groupBy("session").agg(C.upper_median("v").alias("level"))
    return grid.join(level, "session").select("session", "gx", "gy", (F.col("v") - F.col("level")).alias("r"))


@query(
    "pixels",
    f"""{RESID}, rw AS (SELECT session, gy, CASE WHEN count_if(abs(r) <= 3 * mad) >= 2 THEN {MED.format('CASE WHEN abs(r) <= 3 * mad THEN r END')} END AS v
  FROM rs JOIN md USING (session) GROUP BY session, gy),
wl AS (SELECT session, gy, v, list_sort(list_filter(list(v) OVER (PARTITION BY session ORDER BY gy ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), lambda e: e IS NOT NULL)) AS l FROM rw)
SELECT session, gy, round(coalesce(v - l[len(l) // 2 + 1], 0), 6) + 0.0 AS band FROM wl""",
)
def row_bands(spark, sf_dir):
    ok = W.deviation_band(_resid(spark, sf_dir), ["session"], "r", 3.0).withColumn("k", F.when(F.col("ok"), F.col("r")))
    rows = ok.groupBy("session", "gy").agg(F.when(F.count("k") >= 2, C.upper_median("k")).alias("v"))
    return rounded(W.highpass_median(rows, ["session"], "gy", "v", 9).select("session", "gy", F.col("fine").alias("band")), "band")


@query(
    "pixels",
    f"""{RESID}, a AS (SELECT session, least(CAST(floor(((degrees(atan2(gy - 3.4, gx - 3.3)) + 360) % 360) / 30) AS INT), 11) AS bin, r FROM rs JOIN md USING (session) WHERE abs(r) <= 3 * mad),
b AS (SELECT session, bin, CASE WHEN count(*) >= 3 THEN {MED.format('r')} END AS v FROM a GROUP BY ALL),
g AS (SELECT s.session, CAST(k.bin AS INT) AS bin, b.v FROM (SELECT DISTINCT session FROM rs) s CROSS JOIN range(12) k(bin) LEFT JOIN b ON b.session = s.session AND b.bin = k.bin),
w AS (SELECT g.session, g.bin, g.v, list_sort(list(n.v)) AS l FROM g LEFT JOIN g n ON n.session = g.session AND n.v IS NOT NULL AND least(abs(n.bin - g.bin), 12 - abs(n.bin - g.bin)) <= 2 GROUP BY g.session, g.bin, g.v)
SELECT session, bin, round(coalesce(v - l[len(l) // 2 + 1], 0), 6) + 0.0 AS spoke FROM w""",
)
def angle_spokes(spark, sf_dir):
    ok = W.deviation_band(_resid(spark, sf_dir), ["session"], "r", 3.0).where("ok")
    deg = (F.degrees(F.atan2(F.col("gy") - 3.4, F.col("gx") - 3.3)) + 360) % 360
    bins = ok.withColumn("bin", F.least(F.floor(deg / 30), F.lit(11)).cast("int")).groupBy("session", "bin").agg(F.when(F.count("r") >= 3, C.upper_median("r")).alias("v"))
    grid = _resid(spark, sf_dir).select("session").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(11))))
    out = W.highpass_median_round(grid.join(bins, ["session", "bin"], "left"), ["session"], "bin", "v", 5, 12)
    return rounded(out.select("session", "bin", F.col("fine").alias("spoke")), "spoke")


@query(
    "pixels",
    f"""{RESID}, dr AS (SELECT d * 15 AS deg FROM range(24) r(d)),
pj AS (SELECT session, deg, CAST(floor(((gx - 3.3) * cos(radians(deg)) + (gy - 3.4) * sin(radians(deg)) + 7.013) / 2.1) AS INT) AS bin, r
  FROM rs JOIN md USING (session) CROSS JOIN dr WHERE r <= 2 * mad AND r >= -5 * mad),
pb AS (SELECT session, deg, bin, CASE WHEN count(*) >= 3 THEN {MED.format('r')} ELSE 0 END AS p FROM pj GROUP BY ALL),
sc AS (SELECT session, deg, {MED.format('abs(r - p)')} AS score FROM pj JOIN pb USING (session, deg, bin) GROUP BY ALL)
SELECT session, deg, round(score, 6) + 0.0 AS score FROM sc""",
)
def direction_search(spark, sf_dir):
    mad = _resid(spark, sf_dir).groupBy("session").agg(F.greatest(C.upper_median("abs(r)"), F.lit(1e-9)).alias("mad"))
    kept = _resid(spark, sf_dir).join(mad, "session").where((F.col("r") <= 2 * F.col("mad")) & (F.col("r") >= -5 * F.col("mad")))
    turned = kept.withColumn("deg", F.explode(F.sequence(F.lit(0), F.lit(345), F.lit(15))))
    d = (F.col("gx") - 3.3) * F.cos(F.radians("deg")) + (F.col("gy") - 3.4) * F.sin(F.radians("deg"))
    placed = turned.withColumn("bin", F.floor((d + 7.013) / 2.1).cast("int"))
    profile = placed.groupBy("session", "deg", "bin").agg(F.when(F.count("r") >= 3, C.upper_median("r")).otherwise(0.0).alias("p"))
    scored = placed.join(profile, ["session", "deg", "bin"]).groupBy("session", "deg").agg(C.upper_median("abs(r - p)").alias("score"))
    return rounded(scored.withColumn("deg", F.col("deg").cast("long")), "score")


# -------------------------------------------------------------------- images

DETECT = f"""s AS (SELECT frame_idx, {MED.format('v')} AS med FROM pixels GROUP BY frame_idx),
q AS (SELECT p.frame_idx, s.med, 1.4826 * greatest({MED.format('abs(p.v - s.med)')}, 1e-6) AS noise FROM pixels p JOIN s USING (frame_idx) GROUP BY ALL),
n AS (SELECT a.frame_idx, a.x, a.y, a.v, q.med, bool_and(b.v < a.v OR (b.v = a.v AND (b.y, b.x) >= (a.y, a.x))) AS peak, sum(greatest(b.v - q.med, 0)) AS flux, q.noise
  FROM pixels a JOIN q USING (frame_idx) JOIN pixels b ON a.frame_idx = b.frame_idx AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2
  WHERE a.x BETWEEN 2 AND 5 AND a.y BETWEEN 2 AND 5 GROUP BY ALL),
k AS (SELECT frame_idx, x, y, flux, row_number() OVER (PARTITION BY frame_idx ORDER BY flux DESC, y, x) - 1 AS star_id FROM n WHERE peak AND v >= med + 1.5 * noise)"""


def _parabola(axis: str) -> str:
    other = "y" if axis == "x" else "x"
    get = lambda d: f"(SELECT v FROM pixels p WHERE p.frame_idx = k.frame_idx AND p.{other} = k.{other} AND p.{axis} = k.{axis} + {d})"
    den = f"({get(-1)} - 2 * {get(0)} + {get(1)})"
    return f"k.{axis} + CASE WHEN abs{den} < 1e-12 THEN 0 ELSE greatest(least(0.5 * ({get(-1)} - {get(1)}) / {den}, 1), -1) END"


@query("pixels", f"{DETECT} SELECT frame_idx, CAST(star_id AS INT) AS star_id, round({_parabola('x')}, 6) AS x, round({_parabola('y')}, 6) AS y, round(flux, 6) AS flux FROM k WHERE star_id < 3")
def star_detect_topn(spark, sf_dir):
    return rounded(I.detect_stars(V.images(spark, sf_dir), 3, stride=1, sigma=1.5), "x", "y", "flux")


@query(
    "pixels",
    """c AS (SELECT *, CASE WHEN x % 2 = 0 AND y % 2 = 0 THEN 'r' WHEN x % 2 = 1 AND y % 2 = 1 THEN 'b' ELSE 'g' END AS ch FROM pixels)
SELECT a.frame_idx, a.y, a.x, round(avg(CASE WHEN b.ch = 'r' THEN b.v END), 6) + 0.0 AS r, round(avg(CASE WHEN b.ch = 'g' THEN b.v END), 6) + 0.0 AS g,
  round(avg(CASE WHEN b.ch = 'b' THEN b.v END), 6) + 0.0 AS b FROM c a JOIN c b ON a.frame_idx = b.frame_idx AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL""",
)
def demosaic(spark, sf_dir):
    rgb = I.demosaic(V.images(spark, sf_dir), "RGGB")
    flat = rgb.select("frame_idx", "w", F.posexplode(F.arrays_zip("r", "g", "b")).alias("pos", "p"))
    return rounded(flat.select("frame_idx", F.floor(F.col("pos") / F.col("w")).cast("int").alias("y"), (F.col("pos") % F.col("w")).cast("int").alias("x"), "p.r", "p.g", "p.b"), "r", "g", "b")


SHIFTED = """tr AS (SELECT DISTINCT frame_idx, session, (frame_idx % 7 - 3) * 0.01 AS a, (frame_idx % 5) * 0.3 - 0.55 AS tx, (frame_idx % 3) * 0.4 - 0.35 AS ty FROM pixels),
q AS (SELECT frame_idx, session, yy.y, xx.x, cos(a) * xx.x - sin(a) * yy.y + tx AS qx, sin(a) * xx.x + cos(a) * yy.y + ty AS qy FROM tr CROSS JOIN range(8) yy(y) CROSS JOIN range(8) xx(x)),
i AS (SELECT *, CAST(floor(qx) AS INT) AS x0, CAST(floor(qy) AS INT) AS y0 FROM q WHERE qx >= 0 AND qy >= 0 AND qx < 7 AND qy < 7),
wv AS (SELECT i.frame_idx, i.session, i.y, i.x, sum(p.v * (1 - abs(i.qx - p.x)) * (1 - abs(i.qy - p.y))) AS v FROM i JOIN pixels p
  ON p.frame_idx = i.frame_idx AND p.x BETWEEN i.x0 AND i.x0 + 1 AND p.y BETWEEN i.y0 AND i.y0 + 1 GROUP BY ALL)"""


def _warped(spark, sf_dir):
    k = F.col("frame_idx")
    images = V.images(spark, sf_dir).withColumns({"angle": (k % 7 - 3) * F.lit(0.01), "tx": (k % 5) * F.lit(0.3) - 0.55, "ty": (k % 3) * F.lit(0.4) - 0.35})
    moved = I.map_images(images, lambda a, r: dict(zip(("data", "cover"), (lambda v: (v[0], v[1].astype(int)))(K.warp(a, (np.cos(r["angle"]), np.sin(r["angle"]), r["tx"], r["ty"]))), strict=True)), "data array<double>, cover array<bigint>", ("frame_idx", "session", "h", "w"))
    return moved


@query("pixels", f"{SHIFTED} SELECT session, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(sum(v), 5) + 0.0 AS total, count(*) AS cover, round(greatest(sum(v) / count(*), 0), 6) AS v FROM wv GROUP BY session, y, x")
def warp_stack(spark, sf_dir):
    out = I.finalise(I.stack(_warped(spark, sf_dir), ["session"])).where("cover > 0")
    return rounded(rounded(out, "total", places=5), "v").select("session", "y", "x", "total", "cover", "v")


#: Mosaics of 25 images, so that a blur reaches past its own image; a tenth of each is dark.
NORMAL = f"""mz AS (SELECT frame_idx // 25 AS frame_idx, CAST(frame_idx % 25 // 5 * 8 + y AS INT) AS y, CAST(frame_idx % 5 * 8 + x AS INT) AS x, (v + 1) * CASE WHEN frame_idx % 5 = 4 AND x >= 4 THEN 0.02 ELSE 1 END AS v FROM pixels),
nh AS (SELECT frame_idx, y, x, v, avg(v) OVER (PARTITION BY frame_idx, y ORDER BY x ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS h FROM mz),
lo AS (SELECT frame_idx, y, x, v, avg(h) OVER (PARTITION BY frame_idx, x ORDER BY y ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS b FROM nh),
dk AS (SELECT frame_idx, 0.6 * {MED.format('b')} AS dark FROM lo GROUP BY frame_idx),
l AS (SELECT frame_idx, list_sort(list(b)) AS s, list_sort(list(v - b)) AS f FROM lo JOIN dk USING (frame_idx) WHERE b >= dark GROUP BY frame_idx),
k AS (SELECT frame_idx, s[least(CAST(floor(len(s) * CAST(0.2 AS DOUBLE)) AS INT), len(s) - 1) + 1] AS level, f[least(CAST(floor(len(f) * CAST(0.999 AS DOUBLE)) AS INT), len(f) - 1) + 1] AS top FROM l),
st AS (SELECT frame_idx, level, level + greatest(top, 0) AS high FROM k),
rf AS (SELECT {MED.format('level')} AS level, {MED.format('high')} AS high FROM st)"""


@query("pixels", f"""{NORMAL} SELECT p.frame_idx, p.y, p.x, round(greatest((p.v - st.level) * greatest(least((rf.high - rf.level) / greatest(st.high - st.level, 1e-6), 4.0), 0.25) + rf.level, 0), 5) AS v
FROM mz p JOIN st USING (frame_idx) CROSS JOIN rf""")
def level_normalise(spark, sf_dir):
    k, x, y = F.col("frame_idx"), F.col("x"), F.col("y")
    dark = F.when((k % 5 == 4) & (x >= 4), 0.02).otherwise(1.0)
    wide = V.pixels(spark, sf_dir).select(F.floor(k / 25).alias("frame_idx"), (F.floor(k % 25 / 5) * 8 + y).cast("int").alias("y"), (k % 5 * 8 + x).cast("int").alias("x"), ((F.col("v") + 1) * dark).alias("v"))
    stats = I.level_stats_at(wide)  # the last mosaic may be in part
    ref = stats.agg(C.upper_median("level").alias("level"), C.upper_median("high").alias("high")).first()  # one row
    return rounded(I.normalise(wide, stats, {"level": ref.level, "high": ref.high}), "v", places=5).select("frame_idx", "y", "x", "v")


STRETCH = f"""o AS (SELECT session, v FROM pixels WHERE v > 0), m AS (SELECT session, {MED.format('v')} AS med, list_sort(list(v)) AS s FROM o GROUP BY session),
d AS (SELECT o.session, med, s, {MED.format('abs(o.v - med)')} AS mad FROM o JOIN m USING (session) GROUP BY ALL),
w AS (SELECT session, med, mad, s[least(CAST(floor(len(s) * 0.999) AS INT), len(s) - 1) + 1] AS white FROM d),
sp AS (SELECT least(coalesce(max(CASE WHEN white - med > 1e-9 THEN 3 * mad / (white - med) END), 0), 1) AS span FROM w),
b AS (SELECT session, med, white, greatest(med - span * (white - med), 0) AS black FROM w, sp)"""


@query("pixels", f"""{STRETCH} SELECT frame_idx, y, x, CAST(floor(greatest(least((v - black) * 65535.0 / greatest(white - black, 1e-6), 65535), 0) + 0.5) AS INT) AS q FROM pixels JOIN b USING (session)""")
def stretch_quantise(spark, sf_dir):
    p = V.pixels(spark, sf_dir)
    levels = I.shared_blacks(I.stretch(p, ["session"], F.col("frame_idx") * 64 + F.col("y") * 8 + F.col("x")), [])  # a row per channel
    out = p.join(F.broadcast(levels), "session")
    return out.select("frame_idx", "y", "x", C.quantise(F.col("v"), F.col("black"), F.col("white")).alias("q"))


@query(
    "pixels",
    """r AS (SELECT y, x, v FROM pixels WHERE frame_idx = 0), s AS (SELECT i - 2 AS dx, j - 2 AS dy FROM range(5) a(i) CROSS JOIN range(5) b(j)),
c AS (SELECT p.frame_idx, dx, dy, sum(r.v * p.v) / sqrt(sum(r.v * r.v) * sum(p.v * p.v)) AS ncc FROM r CROSS JOIN s JOIN pixels p ON p.x = r.x + dx AND p.y = r.y + dy GROUP BY ALL),
t AS (SELECT frame_idx, dx, dy, ncc FROM c QUALIFY row_number() OVER (PARTITION BY frame_idx ORDER BY ncc DESC, dy DESC, dx DESC) = 1),
e AS (SELECT t.*, max(CASE WHEN c.dx = t.dx - 1 AND c.dy = t.dy THEN c.ncc END) AS xl, max(CASE WHEN c.dx = t.dx + 1 AND c.dy = t.dy THEN c.ncc END) AS xr,
  max(CASE WHEN c.dy = t.dy - 1 AND c.dx = t.dx THEN c.ncc END) AS yl, max(CASE WHEN c.dy = t.dy + 1 AND c.dx = t.dx THEN c.ncc END) AS yr FROM t JOIN c USING (frame_idx) GROUP BY ALL)
SELECT frame_idx, round(ncc, 6) AS ncc,
  round(dx + CASE WHEN xl IS NULL OR xr IS NULL OR abs(2 * ncc - xl - xr) < 5e-13 THEN 0 ELSE greatest(least((xr - xl) / (2 * (2 * ncc - xl - xr)), 1), -1) END, 5) + 0.0 AS dx,
  round(dy + CASE WHEN yl IS NULL OR yr IS NULL OR abs(2 * ncc - yl - yr) < 5e-13 THEN 0 ELSE greatest(least((yr - yl) / (2 * (2 * ncc - yl - yr)), 1), -1) END, 5) + 0.0 AS dy FROM e""",
)
def ncc_shift(spark, sf_dir):
    images = V.images(spark, sf_dir)
    first = images.where("frame_idx = 0").first()
    reference = np.array(first.data).reshape(8, 8)  # the session's one reference frame

    return rounded(rounded(I.ncc_shift(images, reference, 2), "ncc"), "dx", "dy", places=5).select("frame_idx", "ncc", "dx", "dy")



# ------------------------------------------------- fits that SQL can't express


def _cells(spark, sf_dir):
    """Each session's median image as a grid."""
    return _grid(spark, sf_dir)


@query()
def poly_radial_fit(spark, sf_dir):
    return rounded(M.smooth_models(_cells(spark, sf_dir), ["session"], 8, 8, 32), "fitted", "resid")


@query()
def surface_fit(spark, sf_dir):
    return rounded(M.surfaces(_cells(spark, sf_dir), ["session"], 8, 8, 32, 2, 2.0), "fitted")


@query()
def foreground_mask(spark, sf_dir):
    p = V.pixels(spark, sf_dir).select("frame_idx", F.col("x").alias("gx"), F.col("y").alias("gy"), (F.col("v") + 1.0).alias("v"))
    return M.foreground_masks(p, 8, 8, 32)


@query()
def frame_anomaly(spark, sf_dir):
    p = V.pixels(spark, sf_dir).select("frame_idx", F.col("x").alias("gx"), F.col("y").alias("gy"), (F.col("v") + 1.0).alias("v"))
    cells = p.groupBy("gx", "gy").agg(C.upper_median("v").alias("v")).collect()  # the session's map: a row per cell
    session = np.zeros((8, 8))
    for c in cells:
        session[c.gy, c.gx] = c.v
    model = S.fit_glare(session, 32, centre=(128.0, 128.0), with_surface=False)
    return rounded(M.frame_anomalies(p, session, model), "gain", "dome", "pedestal", "spread", "level_ratio")
