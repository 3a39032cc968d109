"""Registered queries whose input holds a known truth, made from the tables' rows: files, fits, motion, cleaning.

The SQL states the truth, or the same arithmetic; the operators have to find it again.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import geometry as T
from ..operators import images as I
from ..operators import models as M
from ..operators import solvers as S
from ..sources import frames as R
from ..sources import sinks, tags
from . import views as V
from .measures import ORACLES, QUERIES
from .queries import query, rounded

__all__ = ["ORACLES", "QUERIES"]

# ---------------------------------------------------------------------- files


def _tagged(spark, sf_dir) -> DataFrame:
    """(path, content): a small DNG for every order, with tags of the order's columns embedded."""
    o = V.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss").alias("at"))

    def run(batches):
        picture = sinks.dng(np.zeros((1, 2, 3)), "Cam")
        for pdf in batches:
            made = []
            for k, model, lens, at in pdf.itertuples(index=False):
                text = lambda v: [v.encode() + b"\0"]
                second = [(33434, 5, [(1, k % 500 + 1)]), (34855, 3, [100 * (k % 8 + 1)]), (36867, 2, text(at)), (42036, 2, text(lens))]
                made.append((str(k), tags.embed(picture, {"first": [(272, 2, text(model))], "second": second})))
            yield pd.DataFrame(made, columns=["path", "content"])

    return o.mapInPandas(run, "path string, content binary")


@query("", """WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS path, o_orderkey AS k, o_orderpriority AS model, o_orderstatus AS lens, strftime(o_orderdate, '%Y:%m:%d %H:%M:%S') AS shot FROM orders)
SELECT path, 'first' AS directory, 272 AS tag, 2 AS type, CAST(length(model) + 1 AS INT) AS n, model AS value FROM o
UNION ALL SELECT path, 'second', 33434, 5, 1, '1/' || (k % 500 + 1) FROM o
UNION ALL SELECT path, 'second', 34855, 3, 1, CAST(100 * (k % 8 + 1) AS VARCHAR) FROM o
UNION ALL SELECT path, 'second', 36867, 2, 20, shot FROM o
UNION ALL SELECT path, 'second', 42036, 2, CAST(length(lens) + 1 AS INT), lens FROM o""")
def tag_rows(spark, sf_dir):
    return tags.tag_rows(_tagged(spark, sf_dir))


@query("", """SELECT CAST(o_orderkey AS VARCHAR) AS path, o_orderpriority || ' + ' || o_orderstatus AS source, CAST(epoch(o_orderdate) AS BIGINT) AS capture_s FROM orders""")
def file_facts(spark, sf_dir):
    return tags.file_facts(_tagged(spark, sf_dir))


@query("pixels", """q AS (SELECT frame_idx, floor(greatest(least(v * 65535.0, 65535), 0) + 0.5) + floor(greatest(least(v * 0.5 * 65535.0, 65535), 0) + 0.5) + floor(greatest(least(-v * 65535.0, 65535), 0) + 0.5) AS q FROM pixels)
SELECT frame_idx, 8 AS width, 8 AS height, 384 AS strip_bytes, 1 AS compression, 34892 AS photometric, 3 AS samples, CAST(sum(q) AS BIGINT) AS total FROM q GROUP BY frame_idx""")
def dng_entries(spark, sf_dir):
    """What a reader finds in the written pictures: entries of the directory and the sum of all samples."""

    def kernel(a, _):
        data = sinks.dng(np.stack([a, a * 0.5, -a], axis=-1))
        found = {t: struct.unpack_from("<I" if kind == 4 else "<H", data, at)[0] for t, kind, n, at in tags.directory(data, struct.unpack_from("<I", data, 4)[0], "<") if n == 1 and kind in (3, 4)}
        strip = np.frombuffer(data, "<u2", found[279] // 2, found[273])
        return {"width": found[256], "height": found[257], "strip_bytes": found[279], "compression": found[259], "photometric": found[262], "samples": found[277], "total": int(strip.sum())}

    return I.map_images(V.images(spark, sf_dir), kernel, "width int, height int, strip_bytes int, compression int, photometric int, samples int, total bigint")


@query("pixels", "SELECT frame_idx, 'P5 8 8 255' AS head, CAST(sum(floor(greatest(least(v * 5, 1), 0) * 255)) AS BIGINT) AS total, CAST(CASE WHEN max(v) > 0.3 THEN 255 ELSE 0 END AS BIGINT) AS masked FROM pixels GROUP BY frame_idx")
def grey_pictures(spark, sf_dir):
    def kernel(a, _):
        picture, mask = sinks.pgm(a * 5), sinks.mask_pgm(a > 0.3)
        return {"head": " ".join(picture[:11].decode().split()), "total": int(np.frombuffer(picture[11:], np.uint8).sum()), "masked": mask[-1]}

    return I.map_images(V.images(spark, sf_dir), kernel, "head string, total bigint, masked bigint")


@query("pixels", """m AS (SELECT *, CASE WHEN x % 2 = y % 2 THEN x % 2 ELSE 2 END AS ch, greatest(least((least(greatest(floor((v + 1) * 20000), 0), 65535) - 512) / (40000.0 - 512), 1), 0) AS n FROM pixels)
SELECT a.frame_idx, a.y, a.x, round(avg(b.n), 6) + 0.0 AS v, round((1 + a.frame_idx % 3) / 2.0, 6) AS wb_r, CAST(1.5 AS DOUBLE) AS wb_b
FROM m a JOIN m b ON a.frame_idx = b.frame_idx AND a.ch = b.ch AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL""")
def raw_frames(spark, sf_dir):
    """Mosaics packed, decoded and developed: every pixel's own colour is the mean of the normalised samples of that colour around it; the balance is over green."""
    colour = [0, 1, 1, 2]

    def packed(a, row):
        raw = R.Raw(np.floor((a + 1) * 20000), "RGGB", [512.0] * 4, [40000.0] * 4, [1.0 + row["frame_idx"] % 3, 2.0, 3.0])
        return {"content": R.pack(raw)}

    files = I.map_images(V.images(spark, sf_dir), packed, "content binary").select(F.col("frame_idx").cast("string").alias("path"), "content")
    out = I.long_pixels(R.decode(files).select(F.col("path").cast("long").alias("frame_idx"), (F.col("w") * 3).alias("w"), "data", "wb"), keep=("frame_idx", "wb"))
    x, y, own = F.floor(F.col("x") / 3).cast("int"), F.col("y"), F.array(*(F.lit(c) for c in colour))
    out = out.where(F.col("x") % 3 == F.get(own, (y % 2) * 2 + x % 2))
    return rounded(out.select("frame_idx", "y", x.alias("x"), "v", F.get("wb", F.lit(0)).alias("wb_r"), F.get("wb", F.lit(2)).alias("wb_b")), "v", "wb_r", "wb_b")


# --------------------------------------------------------------------- motion


@query("catalog", """k AS (SELECT frame_idx, frame_idx // 50 AS session, frame_idx % 50 AS k FROM catalog)
SELECT session, frame_idx, k % 10 <> 4 AND NOT (k % 10 = 8 AND k < 45) AS aligned, CAST(k * 0.0005 AS DOUBLE) AS angle, CAST(2 * k AS DOUBLE) AS tx, CAST(session % 7 - 0.5 * k AS DOUBLE) AS ty,
  CASE WHEN k % 10 = 4 THEN 'predicted' WHEN k % 10 = 8 AND k < 45 THEN 'replaced' ELSE 'stars' END AS source FROM k""")
def transform_recovery(spark, sf_dir):
    """Sessions that move steadily, with unaligned frames and frames thrown off: both get the motion's transform."""
    f = V.catalog(spark, sf_dir).select(F.floor(F.col("frame_idx") / 50).alias("session"), "frame_idx", (F.col("frame_idx") % 50).alias("k"))
    k = F.col("k")
    off = F.when((k % 10 == 8) & (k < 45), 10.0).otherwise(0.0)
    f = f.select("session", "frame_idx", (k % 10 != 4).alias("aligned"), (k * 0.0005).alias("angle"), (k * 2.0 + off).alias("tx"), (F.col("session") % 7 - k * 0.5).alias("ty"))
    f = f.withColumns({n: F.when(F.col("aligned"), F.col(n)).otherwise(0.0) for n in ("angle", "tx", "ty")})
    return rounded(T.recovered_sessions(f, ["session"], 600.0, 400.0), "angle", "tx", "ty")


@query("", "SELECT CAST(n_nationkey AS BIGINT) AS frame_idx, CAST(n_nationkey % 5 - 2 AS DOUBLE) * 3 AS dx, CAST(n_regionkey - 2 AS DOUBLE) * 2 AS dy, true AS sure FROM nation")
def landscape_drift(spark, sf_dir):
    """A landscape that moved by whole pixels: the shift found in two scales, to the pixel."""
    big = K.box_blur(np.random.default_rng(5).random((512, 512)), 3)

    def run(batches):
        for pdf in batches:
            for k, region in pdf.itertuples(index=False):
                yield pd.DataFrame({"frame_idx": [k], "h": [512], "w": [512], "data": [np.roll(big, ((region - 2) * 2, (k % 5 - 2) * 3), (0, 1)).ravel()]})

    images = V.table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").mapInPandas(run, "frame_idx long, h int, w int, data array<double>")
    found = I.drift(images, big, np.ones((16, 16), dtype=bool), 32, 24)
    return found.select("frame_idx", (F.round("dx") + 0.0).alias("dx"), (F.round("dy") + 0.0).alias("dy"), (F.col("ncc") > 0.8).alias("sure"))


# ------------------------------------------------------------- clean sequence


@query("pixels", """m AS (SELECT frame_idx, y, x, v, (frame_idx + y + x) % 5 = 0 AS masked, x = 7 OR y = 7 AS edge FROM pixels),
a AS (SELECT *, sum(u) OVER w AS s, min(u) OVER w AS lo, max(u) OVER w AS hi, count(u) OVER w AS n FROM (SELECT *, CASE WHEN NOT masked THEN v END AS u FROM m)
  WINDOW w AS (PARTITION BY y, x ORDER BY frame_idx RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING))
SELECT frame_idx, y, x, round(CASE WHEN masked OR edge THEN v WHEN n >= 4 THEN (s - lo - hi) / (n - 2) ELSE s / n END, 6) + 0.0 AS v, CASE WHEN masked OR edge THEN 1 ELSE n END AS used FROM a""")
def window_combine(spark, sf_dir):
    """Each image with its neighbours in time; standing still, so that only the last row and column (outside after a warp) are the image's own."""
    i = V.images(spark, sf_dir)
    place = F.sequence(F.lit(0), F.lit(63))
    mask = F.transform(place, lambda p: (F.col("frame_idx") + F.floor(p / 8) + p % 8) % 5 == 0)
    still = {n: F.lit(0.0) for n in ("angle", "tx", "ty")}
    out = I.window_frames(i.withColumns({"position": F.col("frame_idx").cast("int"), "mask": mask, **still}).select("position", "frame_idx", "h", "w", "data", "mask", *still), 7, channels=1)
    both = out.select("frame_idx", "w", F.arrays_zip("data", "used").alias("both"))
    return rounded(I.long_pixels(both, "both", "b").select("frame_idx", "y", "x", F.col("b.data").alias("v"), F.col("b.used").alias("used")), "v")


CLEAN = "(0.2 * u - 0.1 * t + 0.3 * u * u + 0.05 * u * t * t) * c + 0.4 - 0.45"


@query("pixels", f"""p AS (SELECT frame_idx, y, x, c, (x + 0.5) / 4 - 1 AS u, (y + 0.5) / 4 - 1 AS t, (v + c) * (1 + c * 0.25) AS v FROM pixels, range(1, 4) r(c)),
k AS (SELECT *, {CLEAN} AS k FROM p)
SELECT frame_idx, y, x, CAST(c AS INT) AS c, round(greatest(0.45 + (v - k - 0.45) / (1 - least(0.6 * greatest(k, 0) / 0.45, 0.5)), 0), 5) AS v FROM k""")
def clean_frames(spark, sf_dir):
    """The model's correction subtracted about its pedestal, with balance and contrast."""
    flat = np.zeros((len(S.HARMONICS), 4))
    model = [S.Glare(S.Smooth(np.array([0.4, 0.2 * c, -0.1 * c, 0.3 * c, 0, 0, 0, 0, 0.05 * c, 0]), flat, 4.0, 4.0, 2.0, 8.0, 8.0, 0.0), 1, pedestal=0.45) for c in (1, 2, 3)]
    rgb = F.flatten(F.transform("data", lambda v: F.array(v + 1, v + 2, v + 3)))
    images = V.images(spark, sf_dir).withColumns({"data": rgb, "wb": F.array(F.lit(1.25), F.lit(1.5), F.lit(1.75))})
    out = I.long_pixels(I.clean(images, model, contrast=0.6).withColumn("w", F.col("w") * 3))
    return rounded(out.select("frame_idx", "y", F.floor(F.col("x") / 3).cast("int").alias("x"), (F.col("x") % 3 + 1).cast("int").alias("c"), "v"), "v", places=5)


@query("", "SELECT CAST(n_nationkey AS BIGINT) AS frame_idx, n_nationkey % 2 = 1 AS trail FROM nation")
def trail_kept(spark, sf_dir):
    """Frames with a long thin streak that their neighbours don't show keep it; the others keep nothing."""

    def run(batches):
        for pdf in batches:
            for (k,) in pdf.itertuples(index=False):
                rng = np.random.default_rng(k)
                combined = 0.2 + rng.normal(0, 0.002, (128, 160, 3))
                current = combined + rng.normal(0, 0.002, combined.shape)
                if k % 2:
                    current[20 + 3 * k, 30:100] += 0.05
                yield pd.DataFrame({"frame_idx": [k], "h": [128], "w": [160], "data": [combined.ravel()], "current": [current.ravel()], "used": [np.full(128 * 160, 7)]})

    images = V.table(spark, sf_dir, "nation").select("n_nationkey").mapInPandas(run, "frame_idx long, h int, w int, data array<double>, current array<double>, used array<bigint>")
    return I.keep_transients(images).select("frame_idx", (F.col("kept") >= 60).alias("trail"))


# ----------------------------------------------------------------------- fits


def _grid_rows(spark, sf_dir, table: str, key: str, gw: int, gh: int) -> DataFrame:
    """(key, gx, gy, u, t): a grid of cells for every row of a table; u and t run from -1 to 1."""
    k = V.table(spark, sf_dir, table).select(F.col(key).cast("long").alias("key")).withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(gw * gh - 1))))
    k = k.select("key", (F.col("at") % gw).cast("int").alias("gx"), F.floor(F.col("at") / gw).cast("int").alias("gy"))
    return k.withColumns({"u": (F.col("gx") + 0.5) / gw * 2 - 1, "t": (F.col("gy") + 0.5) / gh * 2 - 1})


def _cells(gw: int, gh: int, table: str, key: str) -> str:
    return f"c AS (SELECT CAST({key} AS BIGINT) AS key, CAST(a.i AS INT) AS gx, CAST(b.i AS INT) AS gy FROM {table}, range({gw}) a(i), range({gh}) b(i))"


@query("", f"WITH {_cells(24, 16, 'nation', 'n_nationkey')} SELECT key, gx, gy, CAST(CASE WHEN (gx + 5 * gy + key) % 29 = 0 THEN 0.5 ELSE 0 END AS DOUBLE) AS resid FROM c")
def cubic_fit(spark, sf_dir):
    """A cubic with clouds on some cells: what the fit leaves is the clouds."""
    u, t, k = F.col("u"), F.col("t"), F.col("key")
    cubic = 1 + 0.02 * k * u - 0.1 * t + 0.2 * u * u - 0.05 * u * t + 0.1 * t * t + 0.03 * u * u * u - 0.04 * t * t * t
    cloud = F.when((F.col("gx") + 5 * F.col("gy") + k) % 29 == 0, 0.5).otherwise(0.0)
    cells = _grid_rows(spark, sf_dir, "nation", "n_nationkey", 24, 16).withColumn("v", cubic + cloud)
    return rounded(M.smooth_models(cells, ["key"], 24, 16, 32), "resid", places=3).select("key", "gx", "gy", "resid")


@query("", f"WITH {_cells(24, 16, 'nation', 'n_nationkey')} SELECT key, gx, gy, CAST(0 AS DOUBLE) AS off FROM c")
def plane_surface(spark, sf_dir):
    """A plane with spikes: the surface's nodes carry the plane to every cell."""
    plane = 0.5 + 0.01 * F.col("key") * F.col("gx") / 24 - 0.2 * F.col("gy") / 16
    spike = F.when((F.col("gx") + 5 * F.col("gy") + F.col("key")) % 29 == 0, 1.0).otherwise(0.0)
    cells = _grid_rows(spark, sf_dir, "nation", "n_nationkey", 24, 16).withColumn("v", plane + spike)
    found = M.surfaces(cells, ["key"], 24, 16, 32, 2, 2.0)
    return rounded(found.withColumn("off", F.col("fitted") - plane), "off", places=3).select("key", "gx", "gy", "off")


@query("", """SELECT CAST(s_suppkey AS BIGINT) AS frame_idx, CAST(1 AS DOUBLE) AS gain, CAST(1 AS DOUBLE) AS dome, CAST((s_suppkey % 20 - 10) * 0.01 AS DOUBLE) AS pedestal, CAST(0 AS DOUBLE) AS spread,
  round((0.5 + (s_suppkey % 20 - 10) * 0.01) / 0.5, 4) AS level_ratio FROM supplier""")
def offset_anomaly(spark, sf_dir):
    """Frames a constant above or below a flat session: the constant is the anomaly's pedestal, and nothing else is found."""
    cells = _grid_rows(spark, sf_dir, "supplier", "s_suppkey", 16, 12).withColumn("v", 0.5 + (F.col("key") % 20 - 10) * 0.01).withColumnRenamed("key", "frame_idx")
    session = np.full((12, 16), 0.5)
    model = S.fit_glare(session, 32, centre=(256.0, 192.0), with_surface=False)
    return rounded(M.frame_anomalies(cells, session, model), "gain", "dome", "pedestal", "spread", "level_ratio", places=4)


@query("", f"""WITH {_cells(40, 28, 'nation', 'n_nationkey')} SELECT key AS frame_idx, gx, gy, gy >= 21 AND gx BETWEEN 9 + key % 5 AND 20 + key % 5 AS masked FROM c""")
def silhouette_mask(spark, sf_dir):
    """A dark block at the lower edge of a tilted sky, and one dark cell alone: the block is masked and grown by one, the cell is not."""
    left = 10 + F.col("key") % 5
    dark = ((F.col("gy") >= 22) & F.col("gx").between(left, left + 9)) | ((F.col("gx") == 30) & (F.col("gy") == 5))
    cells = _grid_rows(spark, sf_dir, "nation", "n_nationkey", 40, 28).withColumn("v", F.when(dark, 0.05).otherwise(0.6 + 0.05 * F.col("u"))).withColumnRenamed("key", "frame_idx")
    return M.foreground_masks(cells, 40, 28, 32)


@query("pixels", """k AS (SELECT d, exp(-(d * d) / (2 * (150.0 / 64) * (150.0 / 64))) AS w FROM range(-8, 9) r(d)), kn AS (SELECT d, w / (SELECT sum(w) FROM k) AS w FROM k),
a AS (SELECT q.frame_idx, q.y, o.x, sum(w * v) AS v FROM pixels q JOIN range(8) o(x) ON true JOIN kn ON true WHERE q.x = greatest(least(o.x + d, 7), 0) GROUP BY ALL)
SELECT a.frame_idx, CAST(o.y AS INT) AS y, CAST(a.x AS INT) AS x, round(sum(w * v), 6) + 0.0 AS v FROM a JOIN range(8) o(y) ON true JOIN kn ON true WHERE a.y = greatest(least(o.y + d, 7), 0) GROUP BY ALL""")
def smooth_nodes(spark, sf_dir):
    out = I.map_images(V.images(spark, sf_dir), lambda a, _: {"data": S.smooth_nodes(S.Surface(a, 64.0)).nodes}, "data array<double>", ("frame_idx", "w"))
    return rounded(I.long_pixels(out), "v")
