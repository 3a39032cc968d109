"""The multiplicative field: what scales with the sky's level, cell by cell, and its reduction to the lens."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clamp, upper_median
from ..functions.kernels import upper_median as median_of
from ..functions.kernels import window_sum
from .solvers import solve

#: Least samples and passes of a slope, width of its band; least lever; transmission floor.
LEAST_SAMPLES, PASSES, BAND, LEAST_LEVER, FLOOR = 12, 3, 2.5, 1.25, 0.15
RADIAL_BINS, COLOUR_BINS, BIN_CELLS, SMOOTH_CELLS, MOST_DISAGREEMENT = 48, 12, 8, 6, 0.20


def robust_slope(cells: DataFrame, by: list[str], x: str, y: str, least: int = LEAST_SAMPLES) -> DataFrame:
    """Slope of y over x per group: three least-squares passes, each on what the last kept.

    Rows with x <= 0 or a null take no part; fewer than ``least`` rows or a flat x give null, and
    so does a slope that isn't positive.  Where x becomes flat in a later pass, the slope so far stays.  One exchange; a group (a value per frame) is one array,
    sorted once, and its medians are partitions in a kernel.
    """
    pair = F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    groups = cells.where((F.col(x) > 0) & F.col(y).isNotNull()).groupBy(*by).agg(F.sort_array(F.collect_list(pair)).alias("p"))
    kinds, kept = dict(cells.dtypes), list(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = batch.column("x"), batch.column("y")
            at, xv, yv = xs.offsets.to_numpy(), xs.values.to_numpy(zero_copy_only=False), ys.values.to_numpy(zero_copy_only=False)
            ends = list(zip(at[:-1], at[1:], strict=True))
            found = [_slopes(xv[a:b], yv[a:b, None], least)[0] for a, b in ends]
            columns = [pa.array([None if np.isnan(s) else s for s in found], pa.float64()), pa.array([b - a for a, b in ends], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *columns], [*kept, "slope", "n"])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in by), "slope double", "n bigint"])
    return groups.select(*by, F.col("p.x").alias("x"), F.col("p.y").alias("y")).mapInArrow(run, schema)


def relative_field(slopes: DataFrame, cells: int) -> DataFrame:
    """Slopes over their median, limited to 0.05..20; all null if too few cells have one."""
    med = slopes.agg(upper_median("slope").alias("__med"), F.count("slope").alias("__n"))
    out = slopes.crossJoin(F.broadcast(med))
    t = clamp(F.col("slope") / F.greatest("__med", F.lit(1e-9)), 0.05, 20.0)
    return out.withColumn("t", F.when(F.col("__n") >= cells // 4, t)).drop("__med", "__n")


def lever(levels: DataFrame) -> DataFrame:
    """One row: the greatest over the least positive level."""
    return levels.where("level > 0").agg((F.max("level") / F.greatest(F.min("level"), F.lit(1e-9))).alias("lever"), F.count(F.lit(1)).alias("n"))


def _radius(h: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y, x = np.mgrid[:h, :w].astype(float)
    x, y = x - (w - 1) / 2, y - (h - 1) / 2
    r_max = max(np.hypot((w - 1) / 2, (h - 1) / 2), 1.0)
    return x / r_max, y / r_max, np.hypot(x, y) / r_max


def _along(profile: np.ndarray, r: np.ndarray) -> np.ndarray:
    n = len(profile)
    at = r * n - 0.5
    j = np.clip(np.floor(at), 0, n - 2).astype(int)
    t = np.clip(at - j, 0, 1)
    return profile[j] * (1 - t) + profile[j + 1] * t


def lens_profile(field: np.ndarray, bins: int = RADIAL_BINS) -> np.ndarray:
    """A field reduced to what a lens can do: no tilt, falling outward, one on the axis; all ones if it can't be told."""
    h, w = field.shape
    u, v, r = _radius(h, w)
    ok = np.isfinite(field)
    if ok.sum() < field.size // 4:
        return np.ones_like(field)
    weight, coef = ok.copy(), np.zeros(3)
    terms = np.stack([np.ones(field.size), u.ravel(), v.ravel()], axis=1)
    values = np.where(ok, field, 0.0).ravel()
    for _ in range(PASSES):
        a = terms[weight.ravel()]
        found = solve(a.T @ a, a.T @ values[weight.ravel()])
        if found is None:
            break
        coef = found
        off = np.abs(field - (terms @ coef).reshape(h, w))
        weight = ok & (off <= BAND * max(median_of(off[ok]), 1e-9))
    level = field - coef[1] * u - coef[2] * v
    which = np.minimum((r * bins).astype(int), bins - 1)
    profile = np.array([median_of(level[ok & (which == b)]) if (ok & (which == b)).sum() >= BIN_CELLS else np.nan for b in range(bins)])
    known = np.isfinite(profile)
    last = np.maximum.accumulate(np.where(known, np.arange(bins), -1))
    profile = np.where(last >= 0, profile[np.maximum(last, 0)], np.nan)
    if not (np.isfinite(profile[0]) and profile[0] > 1e-6):
        return np.ones_like(field)
    profile = np.minimum.accumulate(profile)
    return _along(np.clip(profile / profile[0], FLOOR, 1.0), r)


def smooth_field(field: np.ndarray, r: int = SMOOTH_CELLS) -> np.ndarray:
    """Mean over the square around each cell, the edge repeated outward."""
    wide = np.pad(field, r, mode="edge")
    return window_sum(wide, r)[r:-r, r:-r] / (2 * r + 1) ** 2


def colour_radial(green: np.ndarray, other: np.ndarray, bins: int = COLOUR_BINS) -> np.ndarray:
    """Another channel's field as green times a radial ratio."""
    _, _, r = _radius(*green.shape)
    which = np.minimum((r * bins).astype(int), bins - 1)
    ok = np.abs(green) > 1e-6
    profile, last = np.ones(bins), 1.0
    for b in range(bins):
        here = ok & (which == b)
        if here.sum() >= BIN_CELLS:
            last = median_of(other[here] / green[here])
        profile[b] = last
    i = np.arange(bins)
    profile = (profile[np.maximum(i - 1, 0)] + profile + profile[np.minimum(i + 1, bins - 1)]) / 3
    return _along(profile, r) * green


def colour_spread(green: np.ndarray, other: np.ndarray) -> float:
    """Per cent by which a channel's ratio to green varies over the field."""
    ratio = np.where(np.abs(green) > 1e-6, other / np.where(np.abs(green) > 1e-6, green, 1.0), 1.0)
    mid = 0.5 * (ratio.min() + ratio.max())
    return float(100 * (ratio.max() - ratio.min()) / mid) if abs(mid) > 1e-6 else 0.0


@dataclass
class FlatField:
    t: np.ndarray
    level: np.ndarray
    lever: float
    spread: float
    disagreement: float
    usable: bool

    def report(self) -> str:
        state = "applied" if self.usable else "not applied"
        return f"flat field {state}: lever {self.lever:.2f}, spread {self.spread:.3f}, halves differ by {100 * self.disagreement:.0f} % of it"


def fit_flat_field(maps: pd.DataFrame, gw: int, gh: int) -> FlatField:
    """The field of a session's model frames.

    ``maps``: frame_idx, gx, gy, r, g, b (null where masked), level; a few frames' cells, on one machine.
    The slopes themselves come from robust_slope; this is the small grid's part: full fit, two
    interleaved halves, their agreement, smoothing.
    """
    frames = np.sort(maps.frame_idx.unique())
    levels = maps.groupby("frame_idx")["level"].first()
    positive = levels[levels > 0]
    ratio = float(positive.max() / max(positive.min(), 1e-9)) if len(positive) > 1 else 1.0
    if len(frames) < 2 * LEAST_SAMPLES or ratio < LEAST_LEVER:
        return _no_field(ratio, gw, gh)
    at = {f: k for k, f in enumerate(frames)}
    k = maps.frame_idx.map(at).to_numpy()
    cube = np.full((3, len(frames), gh, gw), np.nan)
    for c, name in enumerate("rgb"):
        cube[c, k, maps.gy.to_numpy(), maps.gx.to_numpy()] = maps[name].to_numpy(float)
    x = levels.loc[frames].to_numpy(float)
    parts = (slice(None), slice(0, None, 2), slice(1, None, 2))
    slopes = np.stack([[_slopes(x[p], cube[c, p].reshape(len(x[p]), -1)).reshape(gh, gw) for c in range(3)] for p in parts])
    level = np.array([median_of([median_of(f[np.isfinite(f)]) for f in cube[c] if np.isfinite(f).any()]) for c in range(3)])
    return _judged(slopes, level, ratio)


def _no_field(ratio: float, gw: int, gh: int) -> FlatField:
    return FlatField(np.ones((3, gh, gw)), np.zeros(3), ratio, 0.0, float("inf"), False)


def _judged(slopes: np.ndarray, level: np.ndarray, ratio: float) -> FlatField:
    """The field of slopes (all frames and two halves; channels; cells): usable if the halves agree."""

    def lens(s: np.ndarray) -> np.ndarray:
        known = s[np.isfinite(s)]
        enough = len(known) >= s.size // 4
        return lens_profile(np.clip(s / max(median_of(known), 1e-9), 0.05, 20) if enough else np.full_like(s, np.nan))

    full, one, two = (np.stack([lens(s) for s in part]) for part in slopes)
    spread = float(full[1].max() - full[1].min())
    disagreement = float("inf") if spread <= 1e-6 else median_of(np.abs(one[1] - two[1])) / spread
    usable = disagreement <= MOST_DISAGREEMENT
    if usable:
        full = np.stack([smooth_field(f) for f in full])
        full = np.stack([colour_radial(full[1], full[0]), full[1], colour_radial(full[1], full[2])])
    return FlatField(full, level, ratio, spread, disagreement, usable)


def flat_fields(maps: DataFrame, by: list[str], gw: int, gh: int) -> DataFrame:
    """The field of every session (``by``), a row per cell: t_r, t_g, t_b, and the session's facts.

    ``maps``: by, frame_idx, gx, gy, r, g, b (null where masked), level.  Slopes are robust_slope's, a
    group per cell, channel and half, spread over the cluster; what one task holds of a session is
    nine slopes a cell, however many frames there are.
    """
    frames = maps.groupBy(*by, "frame_idx").agg(F.first("level").alias("level"))
    w = Window.partitionBy(*by).orderBy("frame_idx")  # a session's frames, a number each
    half = frames.withColumn("__half", (1 + (F.row_number().over(w) - 1) % 2).cast("int")).drop("level")
    channels = F.array(*(F.struct(F.lit(k).alias("c"), F.col(n).alias("v")) for k, n in enumerate("rgb")))
    one = maps.select(*by, "frame_idx", "gx", "gy", "level", F.explode(channels).alias("e")).select(*by, "frame_idx", "gx", "gy", "level", "e.c", "e.v")
    parts = one.join(half, [*by, "frame_idx"]).withColumn("part", F.explode(F.array(F.lit(0), F.col("__half"))))
    slopes = robust_slope(parts, [*by, "c", "part", "gx", "gy"], "level", "v")

    medians = one.groupBy(*by, "c", "frame_idx").agg(upper_median("v").alias("m")).groupBy(*by, "c").agg(upper_median("m").alias("m"))
    levels = medians.groupBy(*by).agg(*(F.max(F.when(F.col("c") == k, F.col("m"))).alias(f"level_{n}") for k, n in enumerate("rgb")))
    positive = F.when(F.col("level") > 0, F.col("level"))
    ratio = F.when(F.count(positive) > 1, F.max(positive) / F.greatest(F.min(positive), F.lit(1e-9))).otherwise(1.0)
    facts = frames.groupBy(*by).agg(F.count(F.lit(1)).alias("n_frames"), ratio.alias("lever")).join(levels, by)
    kinds = dict(maps.dtypes)
    made = ["t_r", "t_g", "t_b", "level_r", "level_g", "level_b", "lever", "spread", "disagreement"]
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in by), "gx int, gy int", *(f"{n} double" for n in made), "usable boolean"])

    def fit(key, found: pd.DataFrame, about: pd.DataFrame) -> pd.DataFrame:
        if not len(about):
            return pd.DataFrame(columns=[*by, "gx", "gy", *made, "usable"])
        a = about.iloc[0]
        flat = _no_field(a.lever, gw, gh)
        if a.n_frames >= 2 * LEAST_SAMPLES and a.lever >= LEAST_LEVER:
            cube = np.full((3, 3, gh, gw), np.nan)
            cube[found.part.to_numpy(), found.c.to_numpy(), found.gy.to_numpy(), found.gx.to_numpy()] = found.slope.to_numpy(float)
            flat = _judged(cube, np.array([a.level_r, a.level_g, a.level_b], float), float(a.lever))
        y, x = (v.ravel() for v in np.mgrid[:gh, :gw])
        out = pd.DataFrame({"gx": x, "gy": y, **{f"t_{n}": flat.t[k].ravel() for k, n in enumerate("rgb")}})
        facts = {f"level_{n}": flat.level[k] for k, n in enumerate("rgb")} | {"lever": flat.lever, "spread": flat.spread, "disagreement": flat.disagreement, "usable": bool(flat.usable)}
        return out.assign(**dict(zip(by, key, strict=True)), **facts)[[*by, "gx", "gy", *made, "usable"]]

    return slopes.groupBy(*by).cogroup(facts.groupBy(*by)).applyInPandas(fit, schema)


def _slopes(x: np.ndarray, y: np.ndarray, least: int = LEAST_SAMPLES) -> np.ndarray:
    """Robust slope of every column of y over x, all columns side by side; NaN where there is none."""
    ok = np.isfinite(y) & (x > 0)[:, None]
    n, v, at = ok.sum(axis=0), np.where(ok, y, 0.0), x[:, None]
    keep, slope, live = ok, np.full(y.shape[1], np.nan), np.ones(y.shape[1], dtype=bool)
    with np.errstate(invalid="ignore", divide="ignore"):
        for k in range(PASSES):
            w = keep.astype(float)
            total = w.sum(axis=0)
            mx, my = (w * at).sum(axis=0) / total, (w * v).sum(axis=0) / total
            dx = w * (at - mx)
            sxx = (dx * dx).sum(axis=0)
            live &= sxx > 1e-12  # a flat x ends it, with the slope so far
            slope = np.where(live, (dx * (v - my)).sum(axis=0) / sxx, slope)
            off = np.where(ok, np.abs(v - (my + slope * (at - mx))), np.inf)
            if k + 1 < PASSES:
                mad = np.take_along_axis(np.sort(off, axis=0), np.minimum(n // 2, len(x) - 1)[None, :], axis=0)[0]
                keep = ok & (off <= BAND * np.maximum(mad, 1e-9))
        return np.where((n >= least) & (slope > 0), slope, np.nan)


def corrected(maps: DataFrame, field: DataFrame, level: float, value: str, frame_level: Column, over: float | None = None, t: str = "t") -> DataFrame:
    """Maps with the field's deficit added: what the lens withheld, in a channel of this level, at this frame's level.

    ``field``: gx, gy and the channel's transmission (a row per cell).  ``over``: the session's level
    that the frame's is held against (green's), the channel's own if not given.
    """
    over = level if over is None else over
    ratio = F.when(frame_level > 0, frame_level / F.lit(over)).otherwise(1.0) if over > 0 else F.lit(1.0)
    lens = field.select("gx", "gy", F.col(t).alias("__t"))
    deficit = (1 - clamp(F.col("__t"), FLOOR, 1.0)) * F.lit(level) * ratio
    return maps.join(lens, ["gx", "gy"]).withColumn(value, F.col(value) + deficit).drop("__t")


def lifted(maps: DataFrame, levels: DataFrame, chosen: DataFrame, gw: int, gh: int) -> tuple[DataFrame, FlatField, DataFrame]:
    """A session's maps (frame_idx, gx, gy, r, g, b) with its field's deficit added, the field, and (frame_idx, flat_ratio).

    ``levels``: frame_idx, level.  The field is of the ``chosen`` frames; one that can't be told leaves the maps as they are.
    """
    own = maps.join(chosen.select("frame_idx"), "frame_idx").join(levels, "frame_idx").withColumn("__one", F.lit(0))
    rows = flat_fields(own, ["__one"], gw, gh).drop("__one")
    found = rows.toPandas().sort_values(["gy", "gx"])  # a row per cell
    if not len(found) or not found.usable.iloc[0]:
        ratios = levels.select("frame_idx", F.lit(1.0).alias("flat_ratio"))
        return maps, _no_field(float(found.lever.iloc[0]) if len(found) else 1.0, gw, gh), ratios
    a = found.iloc[0]
    level = np.array([a.level_r, a.level_g, a.level_b], dtype=float)
    flat = FlatField(np.stack([found[f"t_{n}"].to_numpy().reshape(gh, gw) for n in "rgb"]), level, float(a.lever), float(a.spread), float(a.disagreement), True)
    ratio = F.when(F.col("level") > 0, F.col("level") / float(level[1])).otherwise(1.0) if level[1] > 0 else F.lit(1.0)
    ratios = levels.select("frame_idx", ratio.alias("flat_ratio"))
    lens = maps.sparkSession.createDataFrame(found[["gx", "gy", "t_r", "t_g", "t_b"]])
    out = maps.join(levels.select("frame_idx", F.col("level").alias("__level")), "frame_idx", "left").withColumn("__level", F.coalesce("__level", F.lit(0.0)))
    for n, scale in zip("rgb", level, strict=True):
        out = corrected(out, lens, float(scale), n, F.col("__level"), float(level[1]), f"t_{n}")
    return out.drop("__level"), flat, ratios
