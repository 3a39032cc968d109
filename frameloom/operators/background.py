"""Background maps of cells, their session medians, and masks of cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import array_upper_median, col, upper_median

CELL = ["frame_idx", "gx", "gy"]

#: Share of a starless block over four deviations; least samples of a session median.
STAR_NOISE = 0.0035
LEAST_SAMPLES = 5


def _sorted_by(block: np.ndarray, values: np.ndarray) -> np.ndarray:
    return values[np.lexsort((values, block))]


def _block_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Clipped median, share of bright samples and spread of each block's samples (column s), all blocks of a batch at once."""
    for batch in batches:
        lists = batch.column("s")
        off = lists.offsets.to_numpy()
        off, values = off - off[0], lists.flatten().to_numpy(zero_copy_only=False)
        n = np.diff(off)
        block, first = np.repeat(np.arange(len(n)), n), off[:-1]
        ranked = _sorted_by(block, values)
        med = ranked[first + n // 2]
        mad = _sorted_by(block, np.abs(values - med[block]))[first + n // 2]
        kept = np.add.reduceat((ranked <= (med + 3 * mad)[block]).astype(np.int64), first) if len(n) else n  # the least of a block
        bg = np.where((mad <= 0) | (kept < n // 2), med, ranked[first + kept // 2])
        spread = _sorted_by(block, np.abs(values - bg[block]))[first + n // 2]
        over = np.add.reduceat((values > (bg + 4 * spread)[block]).astype(np.int64), first) if len(n) else n
        keys = [k for k in batch.schema.names if k != "s"]
        facts = [pa.array(bg), pa.array(over / n - STAR_NOISE), pa.array(spread), pa.array(n.astype(np.int32))]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *facts], [*keys, "bg", "star", "noise", "n"])


def block_background(samples: DataFrame, keys: list[str] = CELL, value: str = "v", gain: Column | float = 1.0) -> DataFrame:
    """One row per block: bg (clipped median), star (signed), noise, n.

    A block holds a fixed number of pixels, so its values travel as one array, the whole statistic is
    one exchange, and its sorts are one kernel over many blocks.
    """
    kinds = dict(samples.dtypes)
    blocks = samples.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.collect_list(F.col(value).cast("double")).alias("s"))
    found = blocks.mapInArrow(_block_facts, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "bg double, star double, noise double, n int"]))
    g = col(gain)
    return found.withColumns({"bg": F.col("bg") * g, "noise": F.col("noise") * g})


def pixel_blocks(pixels: DataFrame, block: int, width: int, height: int) -> DataFrame:
    """Cell of each pixel; the partial blocks at the right and bottom edge are dropped."""
    gx, gy = F.floor(F.col("x") / block).cast("int"), F.floor(F.col("y") / block).cast("int")
    return pixels.withColumns({"gx": gx, "gy": gy}).where((F.col("gx") < width // block) & (F.col("gy") < height // block))


def sky_level(maps: DataFrame, value: str = "bg", masked: Column | None = None) -> DataFrame:
    """Per frame, the median of its unmasked cells, 0 if there are none."""
    v = F.when(masked, None).otherwise(F.col(value)) if masked is not None else F.col(value)
    return maps.select("frame_idx", v.alias("__v")).groupBy("frame_idx").agg(F.coalesce(upper_median("__v"), F.lit(0.0)).alias("level"))


def temporal_median(maps: DataFrame, value: str = "bg", masked: Column | None = None, least: int = LEAST_SAMPLES) -> DataFrame:
    """Per cell over the session: v (median of unmasked values), n, valid (enough samples)."""
    v = F.when(masked, None).otherwise(F.col(value)) if masked is not None else F.col(value)
    out = maps.select("gx", "gy", v.alias("__v")).groupBy("gx", "gy").agg(upper_median("__v").alias("v"), F.count("__v").alias("n"))
    return out.withColumn("valid", F.col("n") >= least)


def fill_neighbours(cells: DataFrame, value: str = "v", known: str = "valid") -> DataFrame:
    """One sweep: an unknown cell takes the mean of its known neighbours (eight), if any.

    Adds ``filled``; ``known`` keeps telling which cells were measured.
    """
    seen = cells.where(F.col(known)).select("gx", "gy", F.col(value).alias("__v"))
    steps = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy))
    shared = seen.select("__v", "gx", "gy", F.explode(steps).alias("d")).groupBy((F.col("gx") + F.col("d.dx")).alias("gx"), (F.col("gy") + F.col("d.dy")).alias("gy")).agg(F.avg("__v").alias("__near"))
    out = cells.join(shared, ["gx", "gy"], "left")
    take = ~F.col(known) & F.col("__near").isNotNull()
    return out.withColumn("filled", take).withColumn(value, F.when(take, F.col("__near")).when(F.col(known), F.col(value))).drop("__near")


def fill_all(cells: DataFrame, sweeps: int, value: str = "v") -> DataFrame:
    """Sweeps until all cells are filled or ``sweeps`` are done; what is never reached is 0."""
    out = cells.withColumn("__known", F.col("valid"))
    for _ in range(sweeps):
        out = fill_neighbours(out, value, "__known").withColumn("__known", F.col("__known") | F.col("filled")).drop("filled")
        if not out.where(~F.col("__known")).limit(1).count():
            break
    return out.withColumn(value, F.when(F.col("__known"), F.col(value)).otherwise(0.0)).drop("__known")


def anomaly(maps: DataFrame, session: DataFrame, value: str = "bg") -> DataFrame:
    """Each frame's cells less the session's: the session map has a row per cell and joins on cells."""
    ref = session.where("valid").select("gx", "gy", F.col("v").alias("__ref"))
    return maps.join(ref, ["gx", "gy"]).withColumn("anomaly", F.col(value) - F.col("__ref")).drop("__ref")


def consensus_mask(masks: DataFrame, masked: str = "masked") -> DataFrame:
    """Cells masked in more than half of the frames."""
    return masks.groupBy("gx", "gy").agg((F.count_if(F.col(masked)) > F.floor(F.count(F.lit(1)) / 2)).alias("masked"))


def box_mean_cells(maps: DataFrame, r: int, value: str, by: list[str]) -> DataFrame:
    """Mean over the square of 2 r + 1 cells, by a window along each axis (values and their number)."""
    row = Window.partitionBy(*by, "gy").orderBy("gx").rangeBetween(-r, r)
    column = Window.partitionBy(*by, "gx").orderBy("gy").rangeBetween(-r, r)
    out = maps.withColumn("__s", F.sum(value).over(row)).withColumn("__n", F.count(value).over(row))
    total, n = F.sum("__s").over(column), F.sum("__n").over(column)
    return out.withColumn("smooth", F.when(n > 0, total / n)).drop("__s", "__n")


def clear_level(maps: DataFrame, value: str = "bg", share: float = 0.25) -> DataFrame:
    """A low value of each cell over the session: place floor((n - 1) * share)."""
    cells = maps.where(F.col(value).isNotNull()).groupBy("gx", "gy").agg(F.sort_array(F.collect_list(value)).alias("s"))
    return cells.select("gx", "gy", F.get("s", F.floor((F.size("s") - 1) * F.lit(share)).cast("int")).alias("clear"))


def radial_bins(cells: DataFrame, width: Column | int, height: Column | int, bins: int) -> DataFrame:
    """Radius of each cell about the grid's middle, over the corner's, and its bin."""
    cx, cy = (col(width) - 1) * 0.5, (col(height) - 1) * 0.5
    r = F.hypot(F.col("gx") - cx, F.col("gy") - cy) / F.greatest(F.hypot(cx, cy), F.lit(1.0))
    return cells.withColumn("radius", r).withColumn("bin", F.least(F.floor(r * bins), F.lit(bins - 1)).cast("int"))


def radial_profile(cells: DataFrame, value: str, bins: int, least: int, by: list[str]) -> DataFrame:
    """Median of each bin with enough cells; the others take the last one inward, then the next outward."""
    found = cells.groupBy(*by, "bin").agg(F.when(F.count(value) >= least, upper_median(value)).alias("p"))
    grid = found.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = grid.join(found, [*by, "bin"], "left")
    order = Window.partitionBy(*by).orderBy("bin")
    back = F.last("p", True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("p", True).over(order.rowsBetween(0, Window.unboundedFollowing))
    return full.select(*by, "bin", F.coalesce(back, ahead).alias("p"))


def star_reference(maps: DataFrame, width: int, height: int, bins: int = 24, least: int = 8) -> DataFrame:
    """(gx, gy, reference): the star signal that the sky shows at each cell's radius.

    ``maps`` has a row per frame and cell: star, land, valid.
    """
    smooth = box_mean_cells(maps, 2, "star", ["frame_idx"])
    per_cell = smooth.where(~F.col("land") & F.col("valid")).groupBy("gx", "gy").agg(upper_median("smooth").alias("s"))
    profile = _profile_one(radial_bins(per_cell, width, height, bins), bins, least)
    cells = radial_bins(maps.select("gx", "gy").distinct(), width, height, bins)
    at = F.col("radius") * bins - 0.5
    j = F.greatest(F.least(F.floor(at), F.lit(bins - 2)), F.lit(0)).cast("int")
    t = F.greatest(F.least(at - j, F.lit(1.0)), F.lit(0.0))
    one = profile.agg(F.array_sort(F.collect_list(F.struct("bin", "p"))).alias("prof"))  # one row of ``bins`` values
    return cells.crossJoin(F.broadcast(one)).select("gx", "gy", (F.get("prof", j)["p"] * (1 - t) + F.get("prof", j + 1)["p"] * t).alias("reference"))


def _profile_one(cells: DataFrame, bins: int, least: int) -> DataFrame:
    keyed = cells.withColumn("__one", F.lit(0))
    return radial_profile(keyed, "s", bins, least, ["__one"]).drop("__one")


def cloud_cells(maps: DataFrame, reference: DataFrame, clear: DataFrame, block: int) -> DataFrame:
    """Cells whose stars are missing and whose background is raised (before regions are cleaned).

    ``maps``: frame_idx, gx, gy, bg, star, land, valid.
    """
    smooth = box_mean_cells(maps, 2, "star", ["frame_idx"])
    joined = smooth.join(reference, ["gx", "gy"]).join(clear, ["gx", "gy"])
    ref, star = F.col("reference"), F.col("smooth")
    p = F.greatest(F.least(ref + STAR_NOISE, F.lit(1 - 1e-6)), F.lit(1e-6))
    sigma = F.sqrt(p * (1 - p) / F.lit(float(25 * block * block)))
    test = ~F.col("land") & F.col("valid") & (ref > 0) & (star < 0.35 * ref) & (star < ref - 4.0 * sigma) & (F.col("bg") > F.col("clear") * 1.08)
    return joined.withColumn("cloud", F.coalesce(test, F.lit(False)))


def measurable(reference: DataFrame, least: float = 0.006) -> Column:
    """Aggregate over a reference: whether the session's stars clear the noise at all."""
    return upper_median("reference") >= least


def dilate_cells(masks: DataFrame, r: int, by: list[str], masked: str = "masked") -> DataFrame:
    """The mask grown by r cells each way: an OR along rows, then along columns."""
    row = Window.partitionBy(*by, "gy").orderBy("gx").rangeBetween(-r, r)
    column = Window.partitionBy(*by, "gx").orderBy("gy").rangeBetween(-r, r)
    return masks.withColumn("__m", F.max(F.col(masked)).over(row)).withColumn("grown", F.max("__m").over(column)).drop("__m")


def mask_fraction(masked: Column) -> Column:
    return F.avg(masked.cast("int"))


def mask_union(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))


def is_valid(valid: Column) -> Column:
    """A cell without a validity mark is valid."""
    return F.coalesce(valid, F.lit(True))


def cell_of(x: Column, y: Column, block: int, width: int, height: int) -> tuple[Column, Column]:
    """Cell of a pixel; pixels past the last whole block belong to the last cell."""
    return (F.greatest(F.least(F.floor(v / block), F.lit(n - 1)), F.lit(0)).cast("int") for v, n in ((x, width), (y, height)))


def cell_centre(gx: Column, gy: Column, block: int) -> tuple[Column, Column]:
    return gx * block + block / 2.0, gy * block + block / 2.0


def bilinear(grid: DataFrame, at: DataFrame, fx: Column, fy: Column, width: int, height: int, value: str = "v") -> DataFrame:
    """Add ``value`` of a grid (gx, gy) at fractional places: four weighted neighbours, joined on cells."""
    lim = lambda f, n: F.greatest(F.least(f, F.lit(n - 1 - 1e-3)), F.lit(0.0))
    keyed = at.withColumns({"__id": F.monotonically_increasing_id(), "__x": lim(fx, width), "__y": lim(fy, height)})
    i, j = F.floor("__x").cast("int"), F.floor("__y").cast("int")
    tx, ty = F.col("__x") - i, F.col("__y") - j
    corner = lambda dx, dy, wgt: F.struct((i + dx).alias("gx"), (j + dy).alias("gy"), wgt.alias("w"))
    four = F.array(corner(0, 0, (1 - tx) * (1 - ty)), corner(1, 0, tx * (1 - ty)), corner(0, 1, (1 - tx) * ty), corner(1, 1, tx * ty))
    wide = keyed.select("__id", *at.columns, F.explode(four).alias("c"))
    joined = wide.join(grid.select(F.col("gx").alias("__gx"), F.col("gy").alias("__gy"), F.col(value).alias("__v")), (F.col("c.gx") == F.col("__gx")) & (F.col("c.gy") == F.col("__gy")))
    return joined.groupBy("__id", *at.columns).agg(F.sum(F.col("c.w") * F.col("__v")).alias(value)).drop("__id")


def sky_weight(masks: DataFrame, at: DataFrame, fx: Column, fy: Column, width: int, height: int) -> DataFrame:
    """Add weight: how much sky (1) or masked land (0) there is at fractional places of the grid."""
    sky = masks.select("gx", "gy", F.when(F.coalesce("masked", F.lit(False)), 0.0).otherwise(1.0).alias("weight"))
    return bilinear(sky, at, fx, fy, width, height, "weight")


def cloud_masks(cells: DataFrame, width: int, height: int, least: int, grow: int, measured: Column | None = None) -> DataFrame:
    """(frame_idx, gx, gy, masked): cloudy cells without regions under ``least`` cells, grown by ``grow``.

    ``measured`` false (the session's stars don't clear the noise) masks nothing.  A frame's grid is one row.
    """
    from ..functions.kernels import dilate, drop_small
    from .images import map_images

    on = F.coalesce("cloud", F.lit(False)) & (measured if measured is not None else F.lit(True))
    here = F.array_sort(F.collect_list(F.when(on, F.col("gy") * width + F.col("gx"))))
    grids = cells.groupBy("frame_idx").agg(here.alias("on"))
    flat = F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda k: F.array_contains("on", k).cast("double"))
    images = grids.select("frame_idx", F.lit(height).alias("h"), F.lit(width).alias("w"), flat.alias("data"))
    made = map_images(images, lambda a, _: {"masked": dilate(drop_small(a > 0, least), grow)}, "masked array<boolean>")
    out = made.select("frame_idx", F.posexplode("masked").alias("at", "masked"))
    grown = out.select("frame_idx", (F.col("at") % width).cast("int").alias("gx"), F.floor(F.col("at") / width).cast("int").alias("gy"), "masked")
    return cells.select("frame_idx", "gx", "gy").join(grown, ["frame_idx", "gx", "gy"])


def radial_profile_pct(cells: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Median of each bin as a percentage of the innermost one's."""
    profile = cells.groupBy(*by, "bin").agg(upper_median(value).alias("p"))
    first = F.first("p").over(Window.partitionBy(*by).orderBy("bin"))
    return profile.select(*by, "bin", (100 * F.col("p") / first).alias("pct"))
