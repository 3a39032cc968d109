"""Operators on images: one row is an image (or a tile with its halo) and its samples are one array.

Kernels run where the rows are, a batch at a time; nothing is shuffled but what is
aggregated across frames, and that is aggregated by row of the result, as arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K

#: Images of one Arrow batch handled at once are bounded by Spark's batch size; images stay rows.
Kernel = Callable[[np.ndarray, dict], dict[str, np.ndarray]]


def _arrow(schema: str) -> pa.Schema:
    """Arrow's types of a schema string (parsed on the driver)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _listed(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """Flat arrays as one list column, by their buffers."""
    off = np.concatenate([[0], np.cumsum([x.size for x in arrays])]).astype(np.int32)
    flat = np.concatenate([x.ravel() for x in arrays]) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat).cast(kind.value_type))


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    off, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]


def _rows(batch: pa.RecordBatch | pa.Table) -> list[dict]:
    """Rows whose lists are numpy views of the batch."""
    if isinstance(batch, pa.Table):
        batch = batch.combine_chunks().to_batches()[0] if batch.num_rows else pa.RecordBatch.from_pylist([], batch.schema)
    cols = [_arrays(c) if pa.types.is_list(c.type) else c.to_pylist() for c in batch.columns]
    return [dict(zip(batch.schema.names, r, strict=True)) for r in zip(*cols, strict=True)]


def _run(kernel: Kernel, keep: list[str], made: list[str], channels: int, data: str, kinds: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = []
            for row in _rows(batch):
                shape = (row["h"], row["w"]) + ((channels,) if channels > 1 else ())
                rows.append(kernel(row.pop(data).reshape(shape), row))
            cols = [batch.column(k) for k in keep]
            for name in made:
                kind, values = kinds.field(name).type, [r[name] for r in rows]
                cols.append(_listed([np.asarray(v) for v in values], kind) if pa.types.is_list(kind) else pa.array([v.item() if isinstance(v, np.generic) else v for v in values], kind))
            yield pa.RecordBatch.from_arrays(cols, [*keep, *made])

    return run


def map_images(images: DataFrame, kernel: Kernel, made: str, keep: tuple[str, ...] = ("frame_idx",), channels: int = 1, data: str = "data") -> DataFrame:
    """Run a kernel on every image.  ``made`` is the schema of what it returns (scalars and flat arrays)."""
    kinds = dict(images.dtypes)
    names = [x.split()[0] for x in made.split(", ")]
    out = ", ".join([*(f"{k} {kinds[k]}" for k in keep), made])
    return images.mapInArrow(_run(kernel, list(keep), names, channels, data, _arrow(out)), out)


def long_pixels(images: DataFrame, data: str = "data", value: str = "v", keep: tuple[str, ...] = ("frame_idx",)) -> DataFrame:
    """A row per sample: y, x and the value."""
    return images.select(*keep, "w", F.posexplode(data).alias("pos", value)).select(*keep, F.floor(F.col("pos") / F.col("w")).cast("int").alias("y"), (F.col("pos") % F.col("w")).cast("int").alias("x"), value)


def box_blur(images: DataFrame, r: int) -> DataFrame:
    return map_images(images, lambda a, _: {"data": K.box_blur(a, r)}, "data array<double>", ("frame_idx", "h", "w"))


def highpass(images: DataFrame, r: int = 4) -> DataFrame:
    return map_images(images, lambda a, _: {"data": K.highpass(a, r)}, "data array<double>", ("frame_idx", "h", "w"))


def downsample(images: DataFrame, d: int) -> DataFrame:
    def kernel(a, _):
        out = K.downsample(a, d)
        return {"sh": out.shape[0], "sw": out.shape[1], "data": out}

    small = map_images(images, kernel, "sh long, sw long, data array<double>")
    return small.select("frame_idx", F.col("sh").alias("h"), F.col("sw").alias("w"), "data")


def demosaic(images: DataFrame, pattern: str) -> DataFrame:
    """Mosaics to r, g, b arrays."""

    def kernel(a, _):
        rgb = K.demosaic(a, pattern)
        return {c: rgb[..., k] for k, c in enumerate("rgb")}

    return map_images(images, kernel, "r array<double>, g array<double>, b array<double>", ("frame_idx", "h", "w"))


def detect_stars(images: DataFrame, most: int, stride: int = 991, sigma: float = 5.0) -> DataFrame:
    """(frame_idx, star_id, x, y, flux): the brightest peaks of every image."""

    def kernel(a, _):
        s = K.detect_stars(a, most, stride, sigma)
        return {"x": s[:, 0], "y": s[:, 1], "flux": s[:, 2]}

    found = map_images(images, kernel, "x array<double>, y array<double>, flux array<double>")
    return found.select("frame_idx", F.posexplode(F.arrays_zip("x", "y", "flux")).alias("star_id", "s")).select("frame_idx", "star_id", "s.x", "s.y", "s.flux")


def global_background(images: DataFrame, stride: int = 991) -> DataFrame:
    def kernel(a, _):
        m, noise = K.background(a, stride)
        return {"median": m, "noise": noise}

    return map_images(images, kernel, "median double, noise double")


def warp(images: DataFrame) -> DataFrame:
    """Images in reference coordinates by their transform (angle, tx, ty): data and cover (0 or 1)."""

    def kernel(a, row):
        v, inside = K.warp(a, (np.cos(row["angle"]), np.sin(row["angle"]), row["tx"], row["ty"]))
        return {"data": v, "cover": inside.astype(int)}

    return map_images(images, kernel, "data array<double>, cover array<bigint>", ("frame_idx", "h", "w"))


def stack(warped: DataFrame, by: list[str], weight: str | None = None) -> DataFrame:
    """Weighted sum, weight and coverage per pixel of the result, as rows (y, x); see stack_tiles for whole frames."""
    rows = warped.select(*by, "w", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"), "data", "cover", *([weight] if weight else []))
    cut = lambda c: F.slice(c, F.col("y") * F.col("w") + 1, F.col("w"))
    ones = F.transform(cut(F.col("cover")), lambda c: c.cast("double"))
    wgt = F.zip_with(cut(F.col(weight)), cut(F.col("cover")), lambda a, c: a * c) if weight else ones
    rows = rows.select(*by, "y", F.posexplode(F.arrays_zip(cut(F.col("data")).alias("v"), wgt.alias("k"), cut(F.col("cover")).alias("c"))).alias("x", "p"))
    v, k, c = F.col("p.v"), F.col("p.k"), F.col("p.c")
    return rows.groupBy(*by, "y", "x").agg(F.sum(v * k).alias("total"), F.sum(k).alias("weight"), F.sum(c).alias("cover"))


def stack_tiles(warped: DataFrame, by: list[str]) -> DataFrame:
    """The same by whole tiles: each task adds its images up before anything moves; one array row per task and key."""
    kinds, keys = dict(warped.dtypes), [*by, "h", "w"]
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "total array<double>, cover array<double>"])
    types = _arrow(schema)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}
        for batch in batches:
            for r in _rows(batch):
                key = tuple(r[k] for k in [*by, "h", "w"])
                data, cover = r["data"], r["cover"].astype(float)
                if key in held:
                    held[key][0] += data * cover
                    held[key][1] += cover
                else:
                    held[key] = [data * cover, cover.copy()]
        if held:
            cols = [pa.array(list(c), f.type) for c, f in zip(zip(*held, strict=True), types, strict=False)]
            cols += [_listed([v[j] for v in held.values()], types.field(n).type) for j, n in enumerate(("total", "cover"))]
            yield pa.RecordBatch.from_arrays(cols, types.names)

    part = warped.mapInArrow(partial, schema)
    add = lambda a, b: F.zip_with(a, b, lambda p, q: p + q)
    lists = part.groupBy(*keys).agg(F.collect_list(F.struct("total", "cover")).alias("l"))  # a row per task
    first = F.get("l", F.lit(0))
    rest = F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0)))
    total = F.aggregate(rest, first, lambda acc, x: F.struct(add(acc["total"], x["total"]).alias("total"), add(acc["cover"], x["cover"]).alias("cover")))
    return lists.select(*keys, total.alias("t")).select(*keys, "t.total", "t.cover")


def finalise(stacked: DataFrame, correction: Column | float = 0.0) -> DataFrame:
    """Mean less a correction, not under 0; 0 where nothing was added."""
    k = correction if isinstance(correction, Column) else F.lit(correction)
    return stacked.withColumn("v", F.when(F.col("weight") > 0, F.greatest(F.col("total") / F.col("weight") - k, F.lit(0.0))).otherwise(0.0))


def coverage_report(stacked: DataFrame) -> DataFrame:
    return stacked.agg(F.min("cover").alias("least"), F.max("cover").alias("most"), F.count_if(F.col("weight") <= 0).alias("holes"))


def full_coverage_bounds(cover: np.ndarray) -> tuple[int, int, int, int]:
    """Largest rectangle that every frame covers."""
    return K.largest_rectangle(cover == cover.max()) if cover.size and cover.max() > 0 else (0, 0, cover.shape[1], cover.shape[0])


def level_stats(images: DataFrame) -> DataFrame:
    """Level and high level of each one-channel image."""

    def kernel(a, _):
        s = K.level_stats(a[..., None])[0]
        return {"level": float(s[0]), "high": float(s[1])}

    return map_images(images, kernel, "level double, high double")


def level_stats_at(pixels: DataFrame) -> DataFrame:
    """The same of images given by their pixels (frame_idx, y, x, v), of which any may be missing; an image's pixels travel as one array."""
    kinds = dict(pixels.dtypes)
    schema = f"frame_idx {kinds['frame_idx']}, level double, high double"
    types = _arrow(schema)
    lists = pixels.groupBy("frame_idx").agg(F.collect_list(F.struct(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("v").cast("double").alias("v"))).alias("p"))
    lists = lists.select("frame_idx", *(F.col(f"p.{c}").alias(c) for c in "yxv"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [K.level_stats_at(r["y"], r["x"], r["v"]) for r in _rows(batch)]
            cols = [batch.column("frame_idx"), *(pa.array([f[k] for f in found], pa.float64()) for k in range(2))]
            yield pa.RecordBatch.from_arrays(cols, types.names)

    return lists.mapInArrow(run, schema)


def frame_levels(images: DataFrame) -> DataFrame:
    """(frame_idx, levels): level and high level of each channel of three-channel images, in turn."""
    return map_images(images, lambda a, _: {"levels": K.level_stats(a).ravel()}, "levels array<double>", channels=3)


def deflicker(images: DataFrame) -> DataFrame:
    """Images brought to a reference's levels: ``levels`` the frame's, ``reference`` the reference's, ``guard`` keeps contrast from being raised."""

    def kernel(a, row):
        own, ref = row["levels"].reshape(3, 2), row["reference"].reshape(3, 2)
        gain = np.clip((ref[:, 1] - ref[:, 0]) / np.maximum(own[:, 1] - own[:, 0], 1e-6), 0.25, 1.0 if row["guard"] else 4.0)
        return {"data": np.maximum((a - own[:, 0]) * gain + ref[:, 0], 0.0)}

    return map_images(images, kernel, "data array<double>", ("frame_idx", "h", "w"), channels=3)


def normalise(pixels: DataFrame, stats: DataFrame, reference: dict[str, float], guard: Column | None = None) -> DataFrame:
    """Pixels brought to the reference's level and contrast; a guarded frame's contrast is not raised."""
    most = F.when(guard, 1.0).otherwise(4.0) if guard is not None else F.lit(4.0)
    gain = F.least(F.greatest((F.lit(reference["high"]) - F.lit(reference["level"])) / F.greatest(F.col("high") - F.col("level"), F.lit(1e-6)), F.lit(0.25)), most)
    out = pixels.join(stats, "frame_idx").withColumn("gain", gain)
    return out.withColumn("v", F.greatest((F.col("v") - F.col("level")) * F.col("gain") + reference["level"], F.lit(0.0)))


#: Samples that a stretch looks at, about.
STRETCH_SAMPLES = 1_000_000


def stretch(pixels: DataFrame, by: list[str], place: Column | None = None, most: int = STRETCH_SAMPLES) -> DataFrame:
    """Per channel (in ``by``): median, mad, white (99.9 %) of positive finite samples; n.

    With ``place`` (a pixel's place in its channel), every k-th place is looked at, so that a channel
    has about ``most`` samples however many frames there are.
    """
    from .catalog import every

    if place is not None:
        totals = pixels.groupBy(*by).agg(F.count(F.lit(1)).alias("__total"))  # a row per channel
        pixels = pixels.join(F.broadcast(totals), by).where(every(place, F.col("__total"), most))
    ok = pixels.where((F.col("v") > 0) & ~F.isnan("v"))
    lists = ok.groupBy(*by).agg(F.sort_array(F.collect_list("v")).alias("s"))
    n = F.size("s")
    out = lists.withColumn("median", F.get("s", F.floor(n / 2).cast("int")))
    out = out.withColumn("mad", F.get(F.sort_array(F.transform("s", lambda x: F.abs(x - F.col("median")))), F.floor(n / 2).cast("int")))
    return out.select(*by, "median", "mad", F.get("s", F.least(F.floor(n * F.lit(0.999)).cast("int"), n - 1)).alias("white"), n.alias("n"))


def shared_blacks(stretched: DataFrame, by: list[str]) -> DataFrame:
    """Add black: each channel's median less the widest relative margin of any channel, not under 0."""
    above = F.col("white") - F.col("median")
    margin = F.when(above > 1e-9, 3.0 * F.col("mad") / above)
    span = stretched.groupBy(*by).agg(F.least(F.coalesce(F.max(margin), F.lit(0.0)), F.lit(1.0)).alias("__span"))
    out = stretched.join(span, by) if by else stretched.crossJoin(F.broadcast(span))
    return out.withColumn("black", F.greatest(F.col("median") - F.col("__span") * above, F.lit(0.0))).drop("__span")


def ncc_shift(images: DataFrame, reference: np.ndarray, radius: int) -> DataFrame:
    """(frame_idx, dx, dy, ncc): shift of each image against a reference, all pixels as template."""
    places = np.arange(reference.size)

    def kernel(a, _):
        got = K.ncc_peak(reference, a, places, 0, 0, radius)
        dx, dy, ncc = got if got else (None, None, None)
        return {"dx": dx, "dy": dy, "ncc": ncc}

    return map_images(images, kernel, "dx double, dy double, ncc double")


def combine_warped(frames: dict[int, np.ndarray], masks: dict[int, np.ndarray], transforms: dict[int, tuple], current: int) -> tuple[np.ndarray, np.ndarray]:
    """Trimmed mean of a frame and its warped neighbours, and how many samples each pixel had."""
    own, masked = frames[current], masks[current]
    values, ok = [], []
    for k, image in frames.items():
        if k == current:
            values.append(image)
            ok.append(np.ones(masked.shape, dtype=bool))
            continue
        v, inside = K.warp(image, transforms[k])
        y, x = np.mgrid[: masked.shape[0], : masked.shape[1]].astype(float)
        qx, qy = K.moved(transforms[k], x, y)
        iy, ix = np.clip(qy.astype(int), 0, masked.shape[0] - 1), np.clip(qx.astype(int), 0, masked.shape[1] - 1)
        values.append(v)
        ok.append(inside & ~masks[k][iy, ix])
    ok = np.stack(ok)
    wide = ok[..., None] if own.ndim == 3 else ok
    out = K.trimmed_mean(np.stack(values), np.broadcast_to(wide, (len(values), *own.shape)), own)
    hide = masked[..., None] if own.ndim == 3 else masked
    return np.where(hide, own, out), np.where(masked, 1, ok.sum(axis=0))


def window_frames(images: DataFrame, size: int, channels: int = 3) -> DataFrame:
    """Each frame with its neighbours warped onto it and combined: frame_idx, h, w, data, used.

    ``images``: position, frame_idx, h, w, data, mask (array<boolean>), angle, tx, ty (reference to
    frame), from the export order.  Every frame is sent to the positions that use it, and a group is
    one window of frames: a fixed number of images.
    """
    from .windows import half_window

    half = half_window(size)
    sent = images.withColumn("target", F.explode(F.sequence(F.col("position") - half, F.col("position") + half)))

    names = ["frame_idx", "h", "w", "data", "used"]

    def combine(table: pa.Table) -> pa.Table:
        rows = sorted(_rows(table), key=lambda r: r["position"])
        own = next((r for r in rows if r["position"] == r["target"]), None)
        shape = (own["h"], own["w"], channels)[: 3 if channels > 1 else 2] if own else None
        made = []
        if own:
            frames = {r["position"]: r["data"].astype(float).reshape(shape) for r in rows}
            masks = {r["position"]: r["mask"].reshape(shape[:2]) for r in rows}
            out, used = combine_warped(frames, masks, {r["position"]: _relative(r, own) for r in rows}, own["position"])
            made = [(own["frame_idx"], own["h"], own["w"], out, used)]
        ints = [pa.array([m[k] for m in made], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32()))]
        return pa.Table.from_arrays([*ints, _listed([m[3] for m in made], pa.list_(pa.float64())), _listed([m[4] for m in made], pa.list_(pa.int64()))], names)

    return sent.groupBy("target").applyInArrow(combine, "frame_idx long, h int, w int, data array<double>, used array<bigint>")


def _relative(other: dict, own: dict) -> tuple[float, float, float, float]:
    """Place in the other frame of a place in this one."""
    th = other["angle"] - own["angle"]
    c, s = np.cos(th), np.sin(th)
    return c, s, other["tx"] - (c * own["tx"] - s * own["ty"]), other["ty"] - (s * own["tx"] + c * own["ty"])


def clean(images: DataFrame, model, contrast: float = 0.0, clamp: bool = True, flat=None) -> DataFrame:
    """Three-channel images with the session's model (a list of three Glare) and the frame's anomaly subtracted.

    The model is a few kilobytes and travels with the kernel; a frame's anomaly comes with its row
    (column ``anomaly``, as packed_anomalies makes it).  A frame without one gets the session's model alone.
    With a usable FlatField, what the lens withheld is added first, at the frame's ``flat_ratio``.
    """
    from .field import FLOOR
    from .solvers import FrameAnomaly, Surface, full_radius

    def kernel(a, row):
        h, w = a.shape[:2]
        y, x = np.mgrid[:h, :w] + 0.5
        out = np.empty_like(a)
        packed = row.get("anomaly")
        found = [FrameAnomaly.unpacked(v) for v in np.split(packed, 3)] if packed is not None and len(packed) else None
        for c in range(3):
            m = model[c]
            k = m.correction(x, y)
            gain = 1 / (1 - np.minimum(contrast * np.maximum(k, 0) / max(m.pedestal, 1e-9), 0.5)) if contrast > 0 else 1.0
            if found:
                k = found[c].correction(k, x, y, m.smooth.cx, m.smooth.cy, full_radius(m.smooth.cx, m.smooth.cy, m.smooth.w, m.smooth.h))
            v = a[..., c] * row["wb"][c] - k
            if flat is not None and flat.usable:
                block = float(m.block)
                t = Surface(flat.t[c], block).at(x - block / 2, y - block / 2)
                v = v + (1 - np.clip(t, FLOOR, 1.0)) * flat.level[c] * row["flat_ratio"]
            v = m.pedestal + (v - m.pedestal) * gain
            out[..., c] = np.maximum(v, 0.0) if clamp else v
        return {"data": out}

    return map_images(images, kernel, "data array<double>", ("frame_idx", "h", "w"), channels=3)


def mean_correction(model, transforms: np.ndarray, w: int, h: int, step: int = 16) -> np.ndarray:
    """Mean of the model's correction over frames (rows cos, sin, tx, ty) on a grid of reference pixels."""
    y, x = np.mgrid[: h // step + 2, : w // step + 2] * float(step)
    return np.mean([model.correction(*K.moved(tuple(m), x, y)) for m in transforms], axis=0)


def removed_layer(grid: np.ndarray, pedestal: float, x0: int, y0: int, w: int, h: int, step: int = 16) -> np.ndarray:
    """What was removed, about the pedestal, for a crop of the stack."""
    from .solvers import Surface

    y, x = np.mgrid[y0 : y0 + h, x0 : x0 + w].astype(float)
    return np.maximum(Surface(grid, float(step)).at(x, y) + pedestal, 0.0)


def keep_occlusions(images: DataFrame, keep: tuple[str, ...] = ("frame_idx", "h", "w")) -> DataFrame:
    """Combined images (data) blended with the frame's own (current) where it hides stars; fg: masked pixels, optional."""

    def kernel(a, r):
        out, share = K.keep_occlusions(r["current"].reshape(a.shape), a, r["fg"].reshape(a.shape[:2]).astype(bool))
        return {"data": out, "share": share}

    return map_images(_with_mask(images), kernel, "data array<double>, share double", keep, channels=3)


def keep_transients(images: DataFrame) -> DataFrame:
    """Combined images (data, used) with the frame's own pixels (current) where it shows something long and thin."""

    def kernel(a, r):
        own = r["current"].reshape(a.shape)
        trail = K.transient_mask(own, a, r["fg"].reshape(a.shape[:2]).astype(bool), r["used"].reshape(a.shape[:2]) if r.get("used") is not None else None)
        return {"data": np.where(trail[..., None], own, a), "kept": int(trail.sum())}

    return map_images(_with_mask(images), kernel, "data array<double>, kept bigint", ("frame_idx", "h", "w"), channels=3)


def drift(images: DataFrame, reference: np.ndarray, cells: np.ndarray, block: int, search: int) -> DataFrame:
    """(frame_idx, dx, dy, ncc) of each luminance against the reference's on the masked cells, in two scales; null if not measurable.

    The reference is one image, sent with the kernel.
    """

    def kernel(a, _):
        return dict(zip(("dx", "dy", "ncc"), K.drift(reference, a, cells, block, search) or (None,) * 3, strict=True))

    return map_images(images, kernel, "dx double, dy double, ncc double")


def _with_mask(images: DataFrame) -> DataFrame:
    return images if "fg" in images.columns else images.withColumn("fg", F.array_repeat(F.lit(False), (F.col("h") * F.col("w")).cast("int")))
