"""A whole session: list, decode, measure, align, select, model, clean, stack, export.

Tables that several steps read (frames, maps, catalog) are written once to the work folder, which
driver and executors share.  What reaches the driver is the session's own small things: one grid of
cells per channel for the model, and the report.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
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
from ..sources import frames as R
from ..sources import sinks
from .config import Config
from .session import ship

BLOCK = 32


@dataclass
class Session:
    """What a run made: tables to read on, and its report lines."""

    frames: DataFrame
    maps: DataFrame
    catalog: DataFrame
    model: list[S.Glare] | None
    stack: DataFrame | None
    exported: DataFrame | None
    report: DataFrame


def kept(df: DataFrame, work: str, name: str) -> DataFrame:
    df.write.mode("overwrite").parquet(f"{work}/{name}")
    return df.sparkSession.read.parquet(f"{work}/{name}")


def decoded(spark: SparkSession, config: Config, decoder: Callable[[bytes], R.Raw] = R.unpack) -> tuple[DataFrame, DataFrame]:
    """Frames in path order that could be read and have the first one's size, and the paths that could not."""
    files = R.camera_files(spark, config.input, config.limit)
    numbers = G.list_frames(files.select("path"))
    frames = R.decode(files, decoder).join(numbers, "path")
    good = frames.where("error IS NULL").withColumnsRenamed({"w": "width", "h": "height"})
    same = G.same_size(good).withColumnsRenamed({"width": "w", "height": "h"}).drop("error")
    return same, frames.where("error IS NOT NULL").select("frame_idx", "path", "error")


def luminance(frames: DataFrame) -> DataFrame:
    return I.map_images(frames, lambda a, _: {"data": a @ np.array([0.299, 0.587, 0.114])}, "data array<double>", ("frame_idx", "h", "w"), channels=3)


def cell_maps(frames: DataFrame, block: int = BLOCK) -> DataFrame:
    """(frame_idx, gx, gy, r, g, b, star, noise): backgrounds of every block; whole blocks only."""

    def kernel(a, row):
        gains = np.asarray(row["wb"], dtype=float)
        made = [K.block_maps(a[..., c], block) for c in range(3)]
        out = {name: made[c][0].ravel() * gains[c] for c, name in enumerate("rgb")}
        return out | {"star": made[1][1].ravel(), "noise": made[1][2].ravel()}

    names = ("r", "g", "b", "star", "noise")
    cells = I.map_images(frames, kernel, ", ".join(f"{n} array<double>" for n in names), ("frame_idx", "w"), channels=3)
    wide = F.floor(F.col("w") / block).cast("int")
    flat = cells.select("frame_idx", wide.alias("gw"), F.posexplode(F.arrays_zip(*names)).alias("at", "c"))
    return flat.select("frame_idx", (F.col("at") % F.col("gw")).cast("int").alias("gx"), F.floor(F.col("at") / F.col("gw")).cast("int").alias("gy"), "c.*")


def aligned(frames: DataFrame, config: Config) -> DataFrame:
    """(frame_idx, angle, tx, ty, aligned, inliers): each frame against the first, by matched triangles of its brightest stars."""
    stars = I.detect_stars(luminance(frames), config.max_stars).withColumn("frame_idx", F.col("frame_idx").cast("long"))
    first = stars.agg(F.min("frame_idx").alias("first"))
    fixed = stars.join(F.broadcast(first), F.col("frame_idx") == F.col("first")).drop("first", "frame_idx")  # one frame's stars
    others = stars.select("frame_idx").distinct()
    reference = others.crossJoin(F.broadcast(fixed))
    votes = T.votes_between(reference, stars)
    best = T.best_matches(votes, least=3)
    ref = fixed.select(F.col("star_id").cast("long").alias("ref_star"), F.col("x").alias("px"), F.col("y").alias("py"))
    cur = stars.select("frame_idx", F.col("star_id").cast("long").alias("cur_star"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    fits = T.align_frames(best.join(F.broadcast(ref), "ref_star").join(cur, ["frame_idx", "cur_star"]).select("frame_idx", "px", "py", "qx", "qy"))
    return frames.select(F.col("frame_idx").cast("long").alias("frame_idx")).join(fits, "frame_idx", "left").withColumn("aligned", F.coalesce("aligned", F.lit(False)))


def standing(frames: DataFrame) -> DataFrame:
    """The same for a fixed tripod: every frame stands where the first does."""
    zero = {k: F.lit(0.0) for k in ("angle", "tx", "ty", "rms")}
    return frames.select(F.col("frame_idx").cast("long").alias("frame_idx")).withColumns({**zero, "inliers": F.lit(0).cast("long"), "aligned": F.lit(True)})


def cloudiness(maps: DataFrame, gw: int, gh: int, block: int = BLOCK) -> DataFrame:
    """(frame_idx, cloud): share of a frame's cells that the cloud mask covers; 0 where the session's stars don't clear the noise."""
    cells = maps.select("frame_idx", "gx", "gy", F.col("g").alias("bg"), "star").withColumns({"land": F.lit(False), "valid": F.lit(True)})
    reference = B.star_reference(cells, gw, gh)
    marked = B.cloud_cells(cells, reference, B.clear_level(cells), block).crossJoin(F.broadcast(reference.agg(B.measurable(reference).alias("ok"))))
    masks = B.cloud_masks(marked, gw, gh, least=4, grow=1, measured=F.col("ok"))
    return masks.groupBy("frame_idx").agg(B.mask_fraction(F.col("masked")).alias("cloud"))


def session_model(maps: DataFrame, chosen: DataFrame, gw: int, gh: int, block: int = BLOCK) -> tuple[list[S.Glare], list[np.ndarray]]:
    """Additive model of each channel, and the model frames' median map that it is of (one grid of cells per channel)."""
    picked = maps.join(chosen.where("in_model").select("frame_idx"), "frame_idx")
    model, grids, centre = [], [], None
    for name in "grb":  # green finds the centre for all
        cells = B.temporal_median(picked, name, least=1).toPandas()  # a row per cell
        grid = np.full((gh, gw), np.nan)
        grid[cells.gy, cells.gx] = cells.v
        centre = centre or S.find_centre(grid, block)
        grids.append(grid)
        model.append(S.fit_glare(grid, block, centre=centre, with_surface=min(gw, gh) >= 8))
    return [model[1], model[0], model[2]], [grids[1], grids[0], grids[2]]


def report_lines(facts: DataFrame, bad: DataFrame) -> DataFrame:
    """(stage, line, warning): counters of the selection, and a line for each file that could not be read."""
    one = lambda stage, *parts: F.struct(F.lit(stage).alias("stage"), F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)).alias("line"))
    c = F.col
    lines = F.array(
        one("align", c("n_unaligned"), " of ", c("n_frames"), " frames without alignment"),
        one("select", c("n_stack"), " frames stacked; out: ", c("n_foreground"), " foreground, ", c("n_cloud"), " cloud, ", c("n_bright"), " bright, ", c("n_dark"), " dark"),
        one("select", F.when(c("n_saturated") > 0, F.lit("WARNING: ")).otherwise(F.lit("")), c("n_saturated"), " saturated frames are not exported"),
    )
    said = facts.select(F.explode(lines).alias("l")).select("l.*")
    failed = bad.select(F.lit("load").alias("stage"), F.concat("path", F.lit(": LOAD FAILED: "), "error").alias("line"))
    return said.unionByName(failed).withColumn("warning", G.is_warning(F.col("line")))


def run(spark: SparkSession, config: Config, work: str, block: int = BLOCK, decoder: Callable[[bytes], R.Raw] = R.unpack) -> Session:
    """Everything that the options ask for."""
    config.checked()
    ship(spark)
    good, bad = decoded(spark, config, decoder)
    frames = kept(good, work, "frames")
    size = frames.select("w", "h").first()
    if size is None:
        raise ValueError("no frame could be read")
    gw, gh = size.w // block, size.h // block
    maps = kept(cell_maps(frames, block), work, "maps")

    found = standing(frames) if config.fixed_tripod else aligned(frames, config)
    if not config.fixed_tripod:
        found = T.recovered_sessions(found.withColumn("session", F.lit(0)), ["session"], float(size.w), float(size.h)).drop("session")
        found = found.where("source <> 'none'")  # replaced and predicted frames are exported, and stay out of the stack
    levels = B.sky_level(maps, "g")
    facts = found.join(levels, "frame_idx", "left").join(cloudiness(maps, gw, gh, block), "frame_idx", "left")
    facts = facts.withColumns({"fg": F.lit(0.0), "cloud": F.coalesce("cloud", F.lit(0.0)), "level": F.coalesce("level", F.lit(0.0))})
    chosen = G.model_frames(G.stack_selection(facts, config.sky_tolerance, config.max_foreground, config.fixed_tripod))
    catalog = kept(chosen, work, "catalog")
    report = kept(report_lines(G.selection_report(catalog), bad), work, "report")

    model, images = None, frames
    if not config.no_correction:
        raw, flat = frames, None
        if config.fixed_tripod:  # only where the sky moves over the sensor can the lens be told from the sky
            lit, flat, ratios = L.lifted(maps, catalog.select("frame_idx", "level"), catalog.where("in_model"), gw, gh)
            report = report.unionByName(spark.createDataFrame([("model", flat.report(), False)], report.schema))
            if flat.usable:
                maps = kept(lit, work, "lifted")
                catalog = kept(catalog.drop("level").join(B.sky_level(maps, "g"), "frame_idx", "left").withColumn("level", F.coalesce("level", F.lit(0.0))), work, "relevelled")
            raw = frames.join(ratios, "frame_idx")
        model, grids = session_model(maps, catalog, gw, gh, block)
        if config.anomaly != "none":  # each frame's own, fitted where its cells are
            raw = raw.join(M.packed_anomalies(maps, grids, model, config.anomaly), "frame_idx", "left")
        images = frames.drop("data").join(I.clean(raw, model, contrast=config.contrast, flat=flat).select("frame_idx", "data"), "frame_idx")
    stack = exported = None
    if not config.no_stack:
        stack = kept(stacked(images, catalog), work, "stack")
        # the model has applied the balance; without it the stack stays as the camera has it
        sinks.write_dngs(stack.select(F.lit(0).cast("long").alias("frame_idx"), F.lit("stack.dng").alias("name"), "h", "w", "data", F.lit("").alias("camera")), config.output).count()
    if config.export:
        exported = kept(sinks.write_dngs(sequence(images, catalog, config), config.export), work, "exported")
    return Session(frames, maps, catalog, model, stack, exported, report)


def stacked(images: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row (h, w, data, cover): the mean of the stacked frames in the first one's place; added up in the tasks before anything moves."""
    chosen = images.select("frame_idx", "h", "w", "data").join(catalog.where("in_stack").select("frame_idx", "angle", "tx", "ty"), "frame_idx")

    def kernel(a, row):
        v, inside = K.warp(a, (np.cos(row["angle"]), np.sin(row["angle"]), row["tx"], row["ty"]))
        return {"data": v, "cover": np.repeat(inside.ravel(), 3).astype(float)}

    warped = I.map_images(chosen, kernel, "data array<double>, cover array<double>", ("h", "w"), channels=3)
    total = I.stack_tiles(warped, [])
    mean = F.zip_with("total", "cover", lambda t, c: F.when(c > 0, F.greatest(t / c, F.lit(0.0))).otherwise(0.0))
    return total.select("h", "w", mean.alias("data"), "cover")


def evened(images: DataFrame, catalog: DataFrame, guard: bool) -> DataFrame:
    """(frame_idx, data): images at the levels of the stacked frame nearest the session's; guarded, contrast is never raised.

    Without a stacked frame there is no reference, and images stay as they are.
    """
    levels = I.frame_levels(images)
    reference = levels.join(F.broadcast(G.levels_reference(catalog).select("frame_idx")), "frame_idx").select(F.col("levels").alias("reference"))  # one row
    rows = images.select("frame_idx", "h", "w", "data").join(levels, "frame_idx").join(F.broadcast(reference), how="left")
    return I.deflicker(rows.withColumns({"reference": F.coalesce("reference", "levels"), "guard": F.lit(guard)})).select("frame_idx", "data")


def sequence(images: DataFrame, catalog: DataFrame, config: Config) -> DataFrame:
    """The clean sequence: every exported frame combined with its neighbours in time, transients of its own kept."""
    order = G.export_order(catalog, white=1.0, stabilise=not config.fixed_tripod).select("frame_idx", "position", "angle", "tx", "ty")
    if config.deflicker:
        images = images.drop("data").join(evened(images, catalog, config.cloud_guard), "frame_idx")
    shown = images.join(order, "frame_idx").withColumn("mask", F.array_repeat(F.lit(False), (F.col("h") * F.col("w")).cast("int")))
    combined = I.window_frames(shown.select("frame_idx", "position", "h", "w", "data", "mask", "angle", "tx", "ty"), config.export_window)
    guarded = config.cloud_guard and config.export_window > 1
    if guarded or config.keep_transients:
        own = shown.select(F.col("frame_idx").cast("long").alias("frame_idx"), F.col("data").alias("current"))
        combined = combined.join(own, "frame_idx")
    if guarded:  # before transients: where a cloud covers the frame, nothing is left for them to find
        combined = I.keep_occlusions(combined, keep=("frame_idx", "h", "w", "current", "used"))
    if config.keep_transients:
        combined = I.keep_transients(combined)
    names = shown.select(F.col("frame_idx").cast("long").alias("frame_idx"), sinks.export_name(F.col("path")).alias("name"), "camera")
    return combined.join(names, "frame_idx")
