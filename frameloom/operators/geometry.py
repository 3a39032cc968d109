"""Rigid transforms between frames: algebra, prediction from neighbours, star matching, fits and chains.

A transform takes reference to frame places: q = R p + t.  Columns: cos_t, sin_t, tx, ty.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import pi

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col, let, upper_median
from .ordering import owned, spread

REACH = 6
IMPLAUSIBLE_PX = 6.0
BAND = 0.004


def transform(cos_t, sin_t, tx, ty) -> Column:
    return F.struct(*(col(v).cast("double").alias(k) for k, v in (("cos_t", cos_t), ("sin_t", sin_t), ("tx", tx), ("ty", ty))))


def identity() -> Column:
    return transform(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))


def translation(tx, ty) -> Column:
    return transform(F.lit(1.0), F.lit(0.0), col(tx), col(ty))


def rotation(angle: Column, tx: Column, ty: Column) -> Column:
    return transform(F.cos(angle), F.sin(angle), tx, ty)


def apply(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return m["cos_t"] * x - m["sin_t"] * y + m["tx"], m["sin_t"] * x + m["cos_t"] * y + m["ty"]


def compose(second: Column, first: Column) -> Column:
    """The transform that does ``first``, then ``second``."""
    x, y = apply(second, first["tx"], first["ty"])
    c = second["cos_t"] * first["cos_t"] - second["sin_t"] * first["sin_t"]
    s = second["sin_t"] * first["cos_t"] + second["cos_t"] * first["sin_t"]
    return transform(c, s, x, y)


def inverse(m: Column) -> Column:
    c, s = m["cos_t"], m["sin_t"]
    return transform(c, -s, -(c * m["tx"] + s * m["ty"]), s * m["tx"] - c * m["ty"])


def angle_degrees(m: Column) -> Column:
    return F.degrees(F.atan2(m["sin_t"], m["cos_t"]))


def corner_deviation(a: Column, b: Column, w: float, h: float) -> Column:
    """Largest distance of a corner's images under two transforms."""
    far = []
    for x, y in ((0.0, 0.0), (w, 0.0), (0.0, h), (w, h)):
        (ax, ay), (bx, by) = (apply(m, F.lit(float(x)), F.lit(float(y))) for m in (a, b))
        far.append(F.hypot(ax - bx, ay - by))
    return F.greatest(*far)


def _between(a: Column, b: Column, t: Column) -> Column:
    """Angle (the short way round) and translation at a share of the way; shares beyond 0..1 extrapolate."""
    turn = b["angle"] - a["angle"]
    turn = F.when(turn > pi, turn - 2 * pi * F.ceil((turn - pi) / (2 * pi))).when(turn < -pi, turn + 2 * pi * F.ceil((-turn - pi) / (2 * pi))).otherwise(turn)
    return F.struct((a["angle"] + turn * t).alias("angle"), (a["tx"] + (b["tx"] - a["tx"]) * t).alias("tx"), (a["ty"] + (b["ty"] - a["ty"]) * t).alias("ty"))


def predict(catalog: DataFrame, reach: int = REACH) -> DataFrame:
    """Add predicted (angle, tx, ty), from the aligned frames within ``reach`` before and after; null if there are none.

    Both neighbours: interpolated.  One side only: through its nearest two, or its only one as it is.
    Windows run in blocks of frames, so a long session is many tasks.
    """
    near = F.when(F.col("aligned"), F.struct(F.col("frame_idx").alias("at"), "angle", "tx", "ty"))
    order = Window.partitionBy("__block").orderBy("frame_idx")
    blocks = spread(catalog, "frame_idx", reach)
    out = blocks.withColumn("__b", F.collect_list(near).over(order.rangeBetween(-reach, -1))).withColumn("__a", F.collect_list(near).over(order.rangeBetween(1, reach)))
    n_b = F.size("__b")
    p, pp, n, nn = F.get("__b", n_b - 1), F.get("__b", n_b - 2), F.get("__a", F.lit(0)), F.get("__a", F.lit(1))
    out = out.withColumns({"__p": p, "__pp": F.when(n_b > 1, pp), "__n": n, "__nn": nn})
    p, pp, n, nn, at = F.col("__p"), F.col("__pp"), F.col("__n"), F.col("__nn"), F.col("frame_idx")
    as_is = lambda m: F.struct(m["angle"].alias("angle"), m["tx"].alias("tx"), m["ty"].alias("ty"))
    share = lambda a, b: (at - a["at"]) / (b["at"] - a["at"])
    made = (
        F.when(p.isNotNull() & n.isNotNull(), _between(p, n, share(p, n)))
        .when(p.isNotNull() & pp.isNotNull(), _between(pp, p, share(pp, p)))
        .when(p.isNotNull(), as_is(p))
        .when(n.isNotNull() & nn.isNotNull(), _between(n, nn, share(n, nn)))
        .when(n.isNotNull(), as_is(n))
    )
    return owned(out.withColumn("predicted", made).drop("__b", "__a", "__p", "__pp", "__n", "__nn"))


def implausible(catalog: DataFrame, w: float, h: float, limit: float = IMPLAUSIBLE_PX) -> DataFrame:
    """Add deviation from the neighbours' prediction, and suspect."""
    out = predict(catalog)
    own = rotation(F.col("angle"), F.col("tx"), F.col("ty"))
    other = rotation(F.col("predicted.angle"), F.col("predicted.tx"), F.col("predicted.ty"))
    out = out.withColumn("deviation", F.when(F.col("aligned") & F.col("predicted").isNotNull(), corner_deviation(own, other, w, h)))
    return out.withColumn("suspect", F.coalesce(F.col("deviation") > limit, F.lit(False)))


def recovered(frames: pd.DataFrame, w: float, h: float, limit: float = IMPLAUSIBLE_PX, reach: int = REACH) -> pd.DataFrame:
    """Replace suspect transforms one after the other, then predict the unaligned.

    A replaced frame no longer supports others, so the order matters: this walks the session's
    small catalog.  Columns: frame_idx, aligned, angle, tx, ty; adds source.
    """
    f = frames.sort_values("frame_idx").reset_index(drop=True)
    at, m = f.frame_idx.to_numpy(), f[["angle", "tx", "ty"]].to_numpy(float)
    ok, source = f.aligned.to_numpy(bool).copy(), np.where(f.aligned, "stars", "none").astype(object)

    def guess(k: int, among: np.ndarray):
        """From the supporting frames next to k (``among``, in order), k itself left out."""
        lo, hi = np.searchsorted(at[among], [at[k], at[k] + 1])
        near = lambda rows: rows[np.abs(at[rows] - at[k]) <= reach]
        before, after = near(among[max(lo - 2, 0) : lo]), near(among[hi : hi + 2])
        if len(before) and len(after):
            a, b = before[-1], after[0]
        elif len(before) > 1 or len(after) > 1:
            a, b = before if len(before) > 1 else after
        elif len(before) or len(after):
            return m[(before if len(before) else after)[0]].copy()
        else:
            return None
        t = (at[k] - at[a]) / (at[b] - at[a])
        turn = (m[b, 0] - m[a, 0] + pi) % (2 * pi) - pi
        return np.array([m[a, 0] + turn * t, *(m[a, 1:] + (m[b, 1:] - m[a, 1:]) * t)])

    def far(one, two):
        x, y = np.array([0, w, 0, w]), np.array([0, 0, h, h])
        put = lambda v: (np.cos(v[0]) * x - np.sin(v[0]) * y + v[1], np.sin(v[0]) * x + np.cos(v[0]) * y + v[2])
        (ax, ay), (bx, by) = put(one), put(two)
        return np.hypot(ax - bx, ay - by).max()

    support = np.flatnonzero(ok)
    guesses = {k: guess(k, support) for k in support}
    for k in [k for k, made in guesses.items() if made is not None and far(made, m[k]) > limit]:
        made = guess(k, np.flatnonzero(ok))
        ok[k] = False
        if made is not None:
            m[k], source[k] = made, "replaced"
    support = np.flatnonzero(ok)
    for k in np.flatnonzero(~ok & (source != "replaced")):
        made = guess(k, support)
        if made is not None:
            m[k], source[k] = made, "predicted"
    f["aligned"], f["source"] = ok, source
    f[["angle", "tx", "ty"]] = m
    return f


def recovered_sessions(catalog: DataFrame, by: list[str], w: float, h: float, limit: float = IMPLAUSIBLE_PX, reach: int = REACH) -> DataFrame:
    """The same for every session (``by``) of a table; sessions are independent, a session's catalog is one small group."""
    kinds = dict(catalog.dtypes)
    names = [*by, "frame_idx", "aligned", "angle", "tx", "ty"]
    schema = ", ".join([*(f"{n} {kinds[n]}" for n in names), "source string"])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return recovered(pdf, w, h, limit, reach)[[*names, "source"]]

    return catalog.select(*names).groupBy(*by).applyInPandas(one, schema)


# ------------------------------------------------------------- star matching


TRIANGLES = "frame_idx long, a long, b long, c long, inv0 double, inv1 double"
VOTES = "frame_idx long, ref_star long, cur_star long, votes long"

#: Frames of a block (a power of two), rows that a task gathers before it works, and triangles and candidate pairs that it holds, about.
BLOCK_BITS, GATHERED, HELD, TRIED = 5, 20_000, 300_000, 1_000_000
NONE = np.iinfo(np.int64).min


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row and size of each run of equal keys."""
    n = len(keys[0])
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(first, append=n)


def _triples(first: np.ndarray, size: np.ndarray, ids: np.ndarray, x: np.ndarray, y: np.ndarray):
    """Every triple of lists (rows from ``first``, ``size`` of them): list, corners by rising opposite side, sides over the longest."""
    lists, at = [np.zeros(0, np.int64)], [np.zeros((0, 3), np.int64)]
    for n in np.unique(size[size >= 3]).tolist():
        of, triples = np.flatnonzero(size == n), np.array(list(combinations(range(n), 3)), dtype=np.int64)
        at.append((first[of][:, None, None] + triples).reshape(-1, 3))
        lists.append(np.repeat(of, len(triples)))
    lists, (i, j, k) = np.concatenate(lists), np.concatenate(at).T
    d = np.stack([np.sqrt((x[p] - x[q]) ** 2 + (y[p] - y[q]) ** 2) for p, q in ((i, j), (j, k), (i, k))], axis=1)
    rank = np.argsort(d, axis=1, kind="stable")
    d = np.take_along_axis(d, rank, axis=1)
    corner = np.take_along_axis(ids[np.stack([k, i, j], axis=1)], rank, axis=1)  # opposite each side
    ok = d[:, 2] >= 1e-3
    d = d[ok]
    return lists[ok], corner[ok], d[:, :2] / d[:, 2:]


def _triangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists, frames = batch.column("s"), batch.column("frame_idx")
        off = lists.offsets.to_numpy().astype(np.int64)
        ids, x, y = (lists.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        size = np.diff(off)
        group = np.cumsum(size * (size - 1) * (size - 2) // 6) // HELD
        for lo, n in zip(*_runs(group), strict=True):
            of, corner, inv = _triples(off[:-1][lo : lo + n], size[lo : lo + n], ids, x, y)
            yield pa.RecordBatch.from_arrays([frames.slice(lo, n).take(pa.array(of)), *map(pa.array, (*corner.T, *inv.T))], ["frame_idx", "a", "b", "c", "inv0", "inv1"])


def triangles(stars: DataFrame) -> DataFrame:
    """Every triple of a frame's stars: corners by rising opposite side, sides over the longest.

    Star lists are short by construction (the brightest few); a frame's list travels as one array
    and its triples are made at once.
    """
    star = F.struct(F.col("star_id").cast("long").alias("star_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    lists = stars.groupBy(F.col("frame_idx").cast("long").alias("frame_idx")).agg(F.sort_array(F.collect_list(star)).alias("s"))
    return lists.mapInArrow(_triangles, TRIANGLES)


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of rows that come by block, some whole blocks at a time; null is NONE."""

    def columns(table: pa.Table) -> dict[str, np.ndarray]:
        return {c: (table[c].fill_null(NONE) if pa.types.is_integer(table[c].type) else table[c]).to_numpy() for c in table.column_names}

    held, rows, enough = [], 0, GATHERED
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < enough:
            continue
        table = pa.Table.from_batches(held)
        cut = int(np.searchsorted(table["block"].to_numpy(), table["block"][-1].as_py()))
        if cut:
            yield columns(table.slice(0, cut))
            table = table.slice(cut).combine_chunks()
        held, rows = table.to_batches(), table.num_rows
        enough = max(GATHERED, 2 * rows)
    if rows:
        yield columns(pa.Table.from_batches(held))


def _tallied(ref: np.ndarray, cur: np.ndarray, ref_corner: np.ndarray, cur_corner: np.ndarray, ref_inv: np.ndarray, cur_inv: np.ndarray, band: float):
    """(frame, ref_star, cur_star, votes) of triangles whose sides agree within the band and whose frames (``ref``, ``cur``) are the same.

    Triangles to compare are those next to each other in the first ratio; they are met in slices, and votes added up.
    """
    frames, ids, seen = np.unique(ref), np.unique(ref_corner), np.unique(cur_corner)
    met = np.isin(cur, frames)
    cur, cur_corner, cur_inv = np.searchsorted(frames, cur[met]), np.searchsorted(seen, cur_corner[met]), cur_inv[met]
    ref, ref_corner = np.searchsorted(frames, ref), np.searchsorted(ids, ref_corner)
    apart = 2 * (1 + band)
    key = cur * apart + cur_inv[:, 0]
    order = np.argsort(key, kind="stable")
    key, cur_corner, cur_inv = key[order], cur_corner[order], cur_inv[order]
    at, near = ref * apart + ref_inv[:, 0], band + 1e-6  # a bit wide, as keys are rounded
    lo, hi = np.searchsorted(key, at - near), np.searchsorted(key, at + near, side="right")
    ends = np.cumsum(hi - lo)
    pairs, votes, k = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while k < len(ref):
        done = ends[k - 1] if k else 0
        stop = max(int(np.searchsorted(ends, done + TRIED, side="right")), k + 1)
        n = hi[k:stop] - lo[k:stop]
        one = np.repeat(np.arange(k, stop), n)
        two = np.arange(len(one)) + np.repeat(lo[k:stop] - (ends[k:stop] - n - done), n)
        hit = (np.abs(ref_inv[one] - cur_inv[two]) < band).all(axis=1)
        one, two = one[hit], two[hit]
        codes = ((ref[one] * len(ids))[:, None] + ref_corner[one]) * len(seen) + cur_corner[two]
        found, times = np.unique(codes.ravel(), return_counts=True)
        pairs.append(found)
        votes.append(times)
        k = stop
    found, of = np.unique(np.concatenate(pairs), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, of, np.concatenate(votes))
    rest, second = np.divmod(found, max(len(seen), 1))
    frame, first = np.divmod(rest, max(len(ids), 1))
    return frames[frame], ids[first], seen[second], total


def _voted(band: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_blocks(batches):
            if "inv0" in rows:
                weight = np.ones(len(rows["block"]))
            else:
                order = np.lexsort([rows[c] for c in ("y", "x", "star_id", "cur_of", "ref_of", "block")])
                rows = {c: v[order] for c, v in rows.items()}
                first, size = _runs(rows["block"], rows["ref_of"], rows["cur_of"])
                weight = np.repeat((size - 1) * (size - 2) / 6, size)
            begin, n = _runs(rows["block"])
            group = np.repeat((np.add.reduceat(weight, begin).cumsum() / HELD).astype(int), n)  # whole blocks
            for lo, n in zip(*_runs(group), strict=True):
                if "inv0" in rows:
                    of, corner, inv = np.arange(lo, lo + n), *(np.stack([rows[c][lo : lo + n] for c in names], axis=1) for names in (("a", "b", "c"), ("inv0", "inv1")))
                else:
                    mine = slice(*np.searchsorted(first, [lo, lo + n]))
                    of, corner, inv = _triples(first[mine], size[mine], rows["star_id"], rows["x"], rows["y"])
                    of = first[mine][of]
                ref, cur = rows["ref_of"][of], rows["cur_of"][of]
                r, c = ref != NONE, cur != NONE
                out = _tallied(ref[r], cur[c], corner[r], corner[c], inv[r], inv[c], band)
                if len(out[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], ["frame_idx", "ref_star", "cur_star", "votes"])

    return run


def _listed(df: DataFrame) -> DataFrame:
    """Stars (star_id, x, y), or triangles, of the frames that have a number."""
    longs, doubles = (("a", "b", "c"), ("inv0", "inv1")) if "inv0" in df.columns else (("star_id",), ("x", "y"))
    return df.where("frame_idx IS NOT NULL").select(F.col("frame_idx").cast("long").alias("frame_idx"), *(F.col(c).cast("long").alias(c) for c in longs), *(F.col(c).cast("double").alias(c) for c in doubles))


def _block(frame: Column) -> Column:
    return F.shiftright(frame, BLOCK_BITS).cast("long")


def _dealt(rows: DataFrame, band: float) -> DataFrame:
    return rows.drop("frame_idx").repartition("block").sortWithinPartitions("block").mapInArrow(_voted(band), VOTES)


def triangle_votes(stars: DataFrame, step: int = 1, band: float = BAND) -> DataFrame:
    """(frame_idx, ref_star, cur_star, votes) between each frame and the one ``step`` later.

    Takes star lists (frame_idx, star_id, x, y) or tables of triangles.  Frames go to tasks in blocks, a frame
    that another block's votes need goes there too; a task makes the triangles of star lists where
    it compares them, so what moves is a star once and no triangle.
    """
    frame = F.col("frame_idx")
    own, other = _block(frame), _block(frame - step)
    rows = _listed(stars).withColumn("block", F.explode(F.array_distinct(F.array(own, other))))
    return _dealt(rows.withColumns({"ref_of": F.when(own == F.col("block"), frame), "cur_of": F.when(other == F.col("block"), frame - step)}), band)


def votes_between(reference: DataFrame, stars: DataFrame, band: float = BAND) -> DataFrame:
    """The same of two tables of star lists (or two of triangles), frame by frame."""
    frame, none = F.col("frame_idx"), F.lit(None).cast("long")
    sides = [_listed(df).withColumns({"block": _block(frame), "ref_of": r, "cur_of": c}) for df, r, c in ((reference, frame, none), (stars, none, frame))]
    return _dealt(sides[0].unionByName(sides[1]), band)


def best_matches(votes: DataFrame, least: int = 3) -> DataFrame:
    """The star with most votes for each reference star, the last of equals."""
    top = F.max(F.struct("votes", "cur_star")).alias("t")
    return votes.groupBy("frame_idx", "ref_star").agg(top).where(F.col("t.votes") >= least).select("frame_idx", "ref_star", "t.cur_star", "t.votes")


def rigid_fit(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Least-squares rotation and translation of pairs (px, py) -> (qx, qy), in closed form over sums."""
    n = F.count(F.lit(1))
    m = {k: F.avg(k) for k in ("px", "py", "qx", "qy")}
    sums = pairs.groupBy(*by).agg(
        n.alias("n"), *(v.alias(f"m{k}") for k, v in m.items()),
        F.sum(F.col("px") * F.col("qx") + F.col("py") * F.col("qy")).alias("dot"),
        F.sum(F.col("px") * F.col("qy") - F.col("py") * F.col("qx")).alias("cross"),
    )
    mp, mq, k = (F.col("mpx"), F.col("mpy")), (F.col("mqx"), F.col("mqy")), F.col("n")
    dot = F.col("dot") - k * (mp[0] * mq[0] + mp[1] * mq[1])
    cross = F.col("cross") - k * (mp[0] * mq[1] - mp[1] * mq[0])
    out = sums.withColumn("angle", F.atan2(cross, dot))
    c, s = F.cos("angle"), F.sin("angle")
    return out.select(*by, "n", "angle", (mq[0] - (c * mp[0] - s * mp[1])).alias("tx"), (mq[1] - (s * mp[0] + c * mp[1])).alias("ty"))


#: Pairs of matches, and residuals, that are held at once, about.
PAIRS, RESIDUALS = 100_000, 1_000_000


def _most_inside(p: np.ndarray, q: np.ndarray, tolerance: float, i: np.ndarray, j: np.ndarray, lp: np.ndarray, lq: np.ndarray) -> np.ndarray:
    """A bound on the inliers of any rigid transform, by list.

    Two inliers change their distance by twice the tolerance at most, so n inliers need n matches
    that each agree with n - 1 others.
    """
    far, n = len(p), p.shape[1]
    places = np.concatenate([p, q], axis=2).reshape(far, -1)
    scale = np.where(np.isfinite(places), np.abs(places), 0.0).max(axis=1)  # for what is lost by rounding
    agree = np.abs(lp - lq) <= (2.000002 * tolerance + 1e-9 * scale)[:, None]
    met = np.zeros((far, n, n), dtype=bool)
    met[:, i, j] = met[:, j, i] = agree
    with_own = -np.sort(-(met.sum(axis=2) + 1), axis=1)
    return (with_own >= np.arange(1, n + 1)).sum(axis=1)


def ransac_lists(p: np.ndarray, q: np.ndarray, tolerance: float = 3.0, length_change: float = 0.05):
    """Rigid transforms of many lists of as many matches each (list, match, place): angle, tx, ty, inliers, RMS by list; no inliers, no transform.

    Pairs of a list's matches are tried in turn, the first best counts; a list is done when it has as many
    inliers as any transform could have.  The best is refined by least squares over its inliers.
    """
    far, n = p.shape[:2]
    i, j = np.triu_indices(n, 1)
    out = np.zeros((5, far))
    if n < 3:
        return out
    step = max(PAIRS // len(i), 1)
    if far > step:
        return np.concatenate([ransac_lists(p[k : k + step], q[k : k + step], tolerance, length_change) for k in range(0, far, step)], axis=1)
    dp, dq = p[:, j] - p[:, i], q[:, j] - q[:, i]
    lp, lq = (np.hypot(d[..., 0], d[..., 1]) for d in (dp, dq))
    ok = (lp > 1e-3) & (np.abs(lq / np.maximum(lp, 1e-9) - 1) <= length_change)
    turn = np.cumsum(ok, axis=1) - 1
    most, pairs = _most_inside(p, q, tolerance, i, j, lp, lq), ok.sum(axis=1)
    best, chosen, open_ = np.zeros(far, np.int64), np.zeros((far, 4)), np.flatnonzero(pairs)
    tried, width = 0, 1
    while len(open_):
        width = max(min(width, RESIDUALS // (n * len(open_))), 1)
        f, h = np.nonzero(ok[open_] & (turn[open_] >= tried) & (turn[open_] < tried + width))
        f = open_[f]
        th = np.arctan2(dq[f, h, 1], dq[f, h, 0]) - np.arctan2(dp[f, h, 1], dp[f, h, 0])
        c, s = np.cos(th), np.sin(th)
        (px, py), (qx, qy) = p[f, i[h]].T, q[f, i[h]].T
        made = np.stack([c, s, qx - (c * px - s * py), qy - (s * px + c * py)], axis=1)
        count = _inside(made, p[f], q[f], tolerance).sum(axis=1)
        first, size = _runs(f)
        top = np.maximum.reduceat(count, first)
        at = np.minimum.reduceat(np.where(count == np.repeat(top, size), np.arange(len(f)), len(f)), first)
        better = top > best[f[first]]
        best[f[at[better]]], chosen[f[at[better]]] = top[better], made[at[better]]
        tried, width = tried + width, width * 4
        open_ = open_[(best[open_] < most[open_]) & (pairs[open_] > tried)]
    found = np.flatnonzero(best >= 3)
    a, b = p[found], q[found]
    inside = _inside(chosen[found], a, b, tolerance)[..., None]
    mean = lambda v: np.where(inside, v, 0.0).sum(axis=1, keepdims=True) / best[found][:, None, None]
    ma, mb = mean(a), mean(b)
    a0, b0 = np.where(inside, a - ma, 0.0), np.where(inside, b - mb, 0.0)
    th = np.arctan2((a0[..., 0] * b0[..., 1] - a0[..., 1] * b0[..., 0]).sum(axis=1), (a0 * b0).sum(axis=(1, 2)))
    c, s = np.cos(th)[:, None], np.sin(th)[:, None]
    turned = lambda v: np.stack([c * v[..., 0] - s * v[..., 1], s * v[..., 0] + c * v[..., 1]], axis=-1)
    t = mb - turned(ma)
    off = np.where(inside, turned(a) + t - b, 0.0)
    out[:, found] = th, t[:, 0, 0], t[:, 0, 1], best[found], np.sqrt((off**2).sum(axis=(1, 2)) / best[found])
    return out


def _inside(made: np.ndarray, p: np.ndarray, q: np.ndarray, tolerance: float) -> np.ndarray:
    """Which matches a transform (cos, sin, tx, ty) of their list brings within the tolerance."""
    c, s, tx, ty = made.T[..., None]
    ex = c * p[..., 0] - s * p[..., 1] + tx - q[..., 0]
    ey = s * p[..., 0] + c * p[..., 1] + ty - q[..., 1]
    return np.hypot(ex, ey) < tolerance


def ransac(p: np.ndarray, q: np.ndarray, tolerance: float = 3.0, length_change: float = 0.05):
    """Rigid transform of matched points with outliers: (angle, tx, ty), inliers, RMS; None if there are fewer than three."""
    angle, tx, ty, n, rms = ransac_lists(p[None], q[None], tolerance, length_change)[:, 0].tolist()
    return ((angle, tx, ty), int(n), rms) if n else None


ALIGNED = "angle double, tx double, ty double, inliers long, rms double, aligned boolean"


def _align(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("m")
            off = lists.offsets.to_numpy().astype(np.int64)
            places = np.stack([lists.values.field(k).to_numpy(zero_copy_only=False) for k in range(4)], axis=1)
            size, made = np.diff(off), np.zeros((5, batch.num_rows))
            for n in np.unique(size).tolist():
                of = np.flatnonzero(size == n)
                m = places[off[of][:, None] + np.arange(n)]
                made[:, of] = ransac_lists(m[..., :2], m[..., 2:])
            n = made[3].astype(np.int64)
            angle, tx, ty, rms = (pa.array(made[k], pa.float64(), mask=n == 0) for k in (0, 1, 2, 4))
            yield pa.RecordBatch.from_arrays([batch.column("frame_idx"), angle, tx, ty, pa.array(n), rms, pa.array(n >= least)], ["frame_idx", *(x.split()[0] for x in ALIGNED.split(", "))])

    return run


def align_frames(matches: DataFrame, least: int = 6) -> DataFrame:
    """Robust transform per frame from matched stars (frame_idx, px, py, qx, qy): angle, tx, ty, inliers, rms, aligned.

    A frame's matches are a few dozen (its brightest stars) and travel as one array.
    """
    match = F.struct(*(F.col(c).cast("double").alias(c) for c in ("px", "py", "qx", "qy")))
    lists = matches.groupBy(F.col("frame_idx").cast("long").alias("frame_idx")).agg(F.sort_array(F.collect_list(match)).alias("m"))
    return lists.mapInArrow(_align(least), f"frame_idx long, {ALIGNED}")


def chain(links: DataFrame, length: int) -> DataFrame:
    """Transform from each frame to the one ``length`` later through consecutive links; null if a link is missing.

    ``links``: frame_idx, m (null where the fit failed).  Blocks of frames are independent tasks.
    """
    order = Window.partitionBy("__block").orderBy("frame_idx").rangeBetween(0, length - 1)
    blocks = spread(links, "frame_idx", length)
    out = blocks.withColumn("__l", F.collect_list(F.struct("frame_idx", "m")).over(order))
    ms = F.transform(F.array_sort("__l"), lambda e: e["m"])
    whole = (F.size("__l") == length) & ~F.exists("__l", lambda e: e["m"].isNull())
    made = F.aggregate(ms, identity(), lambda acc, m: compose(m, acc))
    return owned(out.withColumn("chained", F.when(whole, made)).drop("__l"))


def between_frames(forward: Column, first: Column, second: Column) -> Column:
    """A chain from the earlier to the later frame, turned round if the later one comes first."""
    return F.when(second > first, forward).when(second < first, inverse(forward)).otherwise(identity())


def link_residual(links: DataFrame) -> DataFrame:
    """One row: median residual of the links and how many are missing."""
    return links.agg(upper_median("rms").alias("median_rms"), F.count_if(F.col("rms").isNull()).alias("missing"))


def residual(m: Column, px: Column, py: Column, qx: Column, qy: Column) -> Column:
    return let(F.struct(*(v.alias(k) for k, v in zip(("x", "y"), apply(m, px, py), strict=True))), lambda e: F.hypot(e["x"] - qx, e["y"] - qy))

