"""Array kernels for images and cell grids: numpy in double precision, one image at a time."""

from __future__ import annotations

import numpy as np


def upper_median(v: np.ndarray) -> float:
    """Value at place n // 2 of the ascending order; 0 for nothing."""
    v = np.asarray(v).ravel()
    return float(np.partition(v, len(v) // 2)[len(v) // 2]) if len(v) else 0.0


def pick(v: np.ndarray, share: float) -> float:
    k = min(int(len(v) * share), len(v) - 1)
    return float(np.partition(v, k)[k])


def smoothstep(x, start, end):
    t = np.clip((x - start) / (end - start), 0.0, 1.0)
    return t * t * (3 - 2 * t)


def _mean_along(a: np.ndarray, r: int, axis: int) -> np.ndarray:
    """Mean over 2 r + 1 places along an axis, fewer at the ends."""
    n = a.shape[axis]
    run = np.concatenate([np.zeros_like(np.take(a, [0], axis)), np.cumsum(a, axis=axis)], axis=axis)
    i = np.arange(n)
    low, high = np.maximum(i - r, 0), np.minimum(i + r + 1, n)
    shape = [1] * a.ndim
    shape[axis] = n
    return (np.take(run, high, axis) - np.take(run, low, axis)) / (high - low).reshape(shape)


def box_blur(a: np.ndarray, r: int) -> np.ndarray:
    return _mean_along(_mean_along(a, r, 1), r, 0)


def _mean_in_runs(v: np.ndarray, key: np.ndarray, r: int) -> np.ndarray:
    """Mean over 2 r + 1 places of each run of equal keys, fewer at its ends."""
    first = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
    size = np.diff(first, append=len(key))
    run, i = np.concatenate([[0.0], np.cumsum(v)]), np.arange(len(v))
    low, high = np.maximum(i - r, np.repeat(first, size)), np.minimum(i + r + 1, np.repeat(first + size, size))
    return (run[high] - run[low]) / (high - low)


def blur_at(y: np.ndarray, x: np.ndarray, v: np.ndarray, r: int) -> np.ndarray:
    """Box blur of the places that there are: rows, then columns, close up over missing places."""
    across = np.lexsort((v, x, y))
    h = np.empty(len(v))
    h[across] = _mean_in_runs(v[across], y[across], r)
    down = np.lexsort((h, y, x))
    out = np.empty(len(v))
    out[down] = _mean_in_runs(h[down], x[down], r)
    return out


def blur_thrice(a: np.ndarray, r: int) -> np.ndarray:
    half = max(r // 2, 1)
    return box_blur(box_blur(box_blur(a, r), half), half)


def highpass(a: np.ndarray, r: int = 4) -> np.ndarray:
    return a - box_blur(a, r)


def downsample(a: np.ndarray, d: int) -> np.ndarray:
    h, w = a.shape[0] // d, a.shape[1] // d
    return a[: h * d, : w * d].reshape(h, d, w, d).mean(axis=(1, 3))


def window_sum(a: np.ndarray, r: int) -> np.ndarray:
    """Sum over the square of 2 r + 1 around each place, by two-dimensional prefix sums."""
    run = np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    h, w = a.shape
    y0, y1 = np.maximum(np.arange(h) - r, 0), np.minimum(np.arange(h) + r + 1, h)
    x0, x1 = np.maximum(np.arange(w) - r, 0), np.minimum(np.arange(w) + r + 1, w)
    return run[np.ix_(y1, x1)] - run[np.ix_(y0, x1)] - run[np.ix_(y1, x0)] + run[np.ix_(y0, x0)]


def box_mean(a: np.ndarray, r: int) -> np.ndarray:
    """Mean of the finite values around each place; NaN where there is none."""
    ok = np.isfinite(a)
    n = window_sum(ok.astype(float), r)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n > 0, window_sum(np.where(ok, a, 0.0), r) / n, np.nan)


def block_maps(a: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Clipped median, share of bright samples over the noise's own, and spread of each whole block of an image."""
    h, w = a.shape[0] // block, a.shape[1] // block
    n = block * block
    s = np.sort(a[: h * block, : w * block].reshape(h, block, w, block).swapaxes(1, 2).reshape(h, w, n), axis=2)
    mid = lambda v: np.sort(v, axis=2)[..., n // 2]
    med = s[..., n // 2]
    mad = mid(np.abs(s - med[..., None]))
    kept = (s <= (med + 3 * mad)[..., None]).sum(axis=2)
    bg = np.where((mad <= 0) | (kept < n // 2), med, np.take_along_axis(s, (kept // 2)[..., None], axis=2)[..., 0])
    spread = mid(np.abs(s - bg[..., None]))
    return bg, (s > (bg + 4 * spread)[..., None]).mean(axis=2) - 0.0035, spread


# ------------------------------------------------------------------ regions


def label(mask: np.ndarray) -> np.ndarray:
    """Number of each place's region (sides touch), -1 outside: the region's first place in raster order."""
    h, w = mask.shape
    here = np.where(mask, np.arange(h * w).reshape(h, w), h * w)
    while True:
        best = here.copy()
        for axis, step in ((0, 1), (0, -1), (1, 1), (1, -1)):
            moved = np.roll(here, step, axis)
            edge = [slice(None)] * 2
            edge[axis] = 0 if step == 1 else -1
            moved[tuple(edge)] = h * w
            best = np.minimum(best, moved)
        best = np.where(mask, best, h * w)
        flat = np.append(best.ravel(), h * w)
        best = np.where(mask, flat[best], h * w)  # follow the root, so long regions settle quickly
        if (best == here).all():
            return np.where(mask, here, -1)
        here = best


def drop_small(mask: np.ndarray, least: int) -> np.ndarray:
    ids = label(mask)
    size = np.bincount(ids[mask], minlength=mask.size)
    return mask & (size[np.maximum(ids, 0)] >= least)


def dilate(mask: np.ndarray, r: int) -> np.ndarray:
    return window_sum(mask.astype(np.int64), r) > 0


# -------------------------------------------------------------- raw to image

#: Column and row of red and of blue in each 2 x 2 pattern.
CFA = {"RGGB": ((0, 0), (1, 1)), "BGGR": ((1, 1), (0, 0)), "GRBG": ((1, 0), (0, 1)), "GBRG": ((0, 1), (1, 0))}


def cfa_masks(pattern: str, h: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if pattern not in CFA:
        raise ValueError(f"unsupported pattern {pattern}")
    y, x = np.mgrid[:h, :w] % 2
    red, blue = ((x == cx) & (y == cy) for cx, cy in CFA[pattern])
    return red, ~(red | blue), blue


def normalise_raw(values: np.ndarray, black: list[float], white: list[float]) -> np.ndarray:
    b = sum(black) / 4
    return np.clip((values - b) / max(sum(white) / 4 - b, 1.0), 0.0, 1.0)


def demosaic(mosaic: np.ndarray, pattern: str) -> np.ndarray:
    """(h, w, 3): mean of the samples of each colour in the 3 x 3 around a place, its own among them."""
    out = []
    for mask in cfa_masks(pattern, *mosaic.shape):
        n = window_sum(mask.astype(float), 1)
        out.append(np.where(n > 0, window_sum(np.where(mask, mosaic, 0.0), 1) / np.maximum(n, 1), 0.0))
    return np.stack(out, axis=-1)


# --------------------------------------------------------------------- stars


def background(a: np.ndarray, stride: int = 991) -> tuple[float, float]:
    """Median and noise of every 991st pixel."""
    s = a.ravel()[::stride]
    if not len(s):
        return 0.0, 1e-6
    m = upper_median(s)
    return m, 1.4826 * max(upper_median(np.abs(s - m)), 1e-6)


def parabola(left, mid, right):
    d = left - 2 * mid + right
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(np.abs(d) < 1e-12, 0.0, np.clip(0.5 * (left - right) / d, -1.0, 1.0))


def detect_stars(a: np.ndarray, most: int, stride: int = 991, sigma: float = 5.0) -> np.ndarray:
    """(x, y, flux) of the brightest strict peaks ``sigma`` over the background, brightest first."""
    h, w = a.shape
    if h < 5 or w < 5:
        return np.zeros((0, 3))
    median, noise = background(a, stride)
    core = a[2:-2, 2:-2]
    peak = core >= median + sigma * noise
    flux = np.zeros_like(core)
    for dy in range(-2, 3):
        for dx in range(-2, 3):
            v = a[2 + dy : h - 2 + dy, 2 + dx : w - 2 + dx]
            flux = flux + np.maximum(v - median, 0.0)
            if (dy, dx) < (0, 0):
                peak &= v < core
            elif (dy, dx) > (0, 0):
                peak &= v <= core
    y, x = np.nonzero(peak)
    yy, xx = y + 2, x + 2
    sx = xx + parabola(a[yy, xx - 1], a[yy, xx], a[yy, xx + 1])
    sy = yy + parabola(a[yy - 1, xx], a[yy, xx], a[yy + 1, xx])
    rank = np.argsort(-flux[y, x], kind="stable")[:most]
    return np.column_stack([sx, sy, flux[y, x]])[rank]


# ---------------------------------------------------------- warps and stacks


def moved(m: tuple[float, float, float, float], x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c, s, tx, ty = m
    return c * x - s * y + tx, s * x + c * y + ty


def sample(image: np.ndarray, qx: np.ndarray, qy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bilinear values at places, and which places lie inside."""
    h, w = image.shape[:2]
    inside = (qx >= 0) & (qy >= 0) & (qx < w - 1) & (qy < h - 1)
    x0 = np.clip(np.floor(qx), 0, max(w - 2, 0)).astype(int)
    y0 = np.clip(np.floor(qy), 0, max(h - 2, 0)).astype(int)
    fx, fy = qx - x0, qy - y0
    if image.ndim == 3:
        fx, fy = fx[..., None], fy[..., None]
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    v = (image[y0, x0] * (1 - fx) + image[y0, x1] * fx) * (1 - fy) + (image[y1, x0] * (1 - fx) + image[y1, x1] * fx) * fy
    return np.where(inside[..., None] if image.ndim == 3 else inside, v, 0.0), inside


def warp(image: np.ndarray, m, x0: int = 0, y0: int = 0, w: int | None = None, h: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The image drawn in reference coordinates, and its coverage."""
    h, w = h or image.shape[0], w or image.shape[1]
    y, x = np.mgrid[y0 : y0 + h, x0 : x0 + w].astype(float)
    return sample(image, *moved(m, x, y))


def warp_mask(cells: np.ndarray, block: int, shape: tuple[int, int], m, x0: int = 0, y0: int = 0, w: int | None = None, h: int | None = None) -> np.ndarray:
    """True where the reference pixel falls outside the frame or on a masked cell (nearest, clamped to the last cell)."""
    fh, fw = shape
    y, x = np.mgrid[y0 : y0 + (h or fh), x0 : x0 + (w or fw)].astype(float)
    qx, qy = moved(m, x, y)
    out = (qx < 0) | (qy < 0) | (qx >= fw - 1) | (qy >= fh - 1)
    gx = np.clip(qx // block, 0, cells.shape[1] - 1).astype(int)
    gy = np.clip(qy // block, 0, cells.shape[0] - 1).astype(int)
    return out | cells[gy, gx]


def largest_rectangle(full: np.ndarray) -> tuple[int, int, int, int]:
    """(x0, y0, x1, y1) of the largest rectangle of true cells; all of the grid if there is none."""
    h, w = full.shape
    best, found = 0, (0, 0, w, h)
    up = np.zeros(w, dtype=int)
    for y in range(h):
        up = np.where(full[y], up + 1, 0)
        open_: list[tuple[int, int]] = []
        for x in range(w + 1):
            now, start = (int(up[x]) if x < w else 0), x
            while open_ and open_[-1][1] > now:
                start, tall = open_.pop()
                if tall * (x - start) > best:
                    best, found = tall * (x - start), (start, y + 1 - tall, x, y + 1)
            if not open_ or open_[-1][1] < now:
                open_.append((start, now))
    return found


def trimmed_mean(stack: np.ndarray, ok: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Over the first axis: without one least and one greatest from four samples on, else the mean; ``own`` if there is none."""
    n = ok.sum(axis=0)
    total = np.where(ok, stack, 0.0).sum(axis=0)
    low, high = np.where(ok, stack, np.inf).min(axis=0), np.where(ok, stack, -np.inf).max(axis=0)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(n >= 4, (total - low - high) / np.maximum(n - 2, 1), np.where(n > 0, total / np.maximum(n, 1), own))


# ------------------------------------------------------------------ matching


def ncc_peak(a: np.ndarray, b: np.ndarray, places: np.ndarray, cx: int, cy: int, radius: int) -> tuple[float, float, float] | None:
    """Shift of b against a with the highest correlation over the template's places (the last of equals), sub-pixel."""
    h, w = a.shape
    px, py = places % w, places // w
    va = a.ravel()[places]
    size = 2 * radius + 1
    score = np.zeros((size, size))
    for j in range(size):
        for i in range(size):
            x, y = px + cx + i - radius, py + cy + j - radius
            ok = (x >= 0) & (y >= 0) & (x < w) & (y < h)
            p, q = va[ok], b[y[ok], x[ok]]
            den = np.sqrt((p * p).sum() * (q * q).sum())
            score[j, i] = (p * q).sum() / den if den > 0 else 0.0
    k = score.size - 1 - int(np.argmax(score.ravel()[::-1]))
    j, i = divmod(k, size)
    if not np.isfinite(score[j, i]):
        return None

    def vertex(left, right):
        d = 2 * (2 * score[j, i] - left - right)
        return 0.0 if abs(d) < 1e-12 else float(np.clip((right - left) / d, -1, 1))

    ox = vertex(score[j, i - 1], score[j, i + 1]) if 0 < i < size - 1 else 0.0
    oy = vertex(score[j - 1, i], score[j + 1, i]) if 0 < j < size - 1 else 0.0
    return cx + i - radius + ox, cy + j - radius + oy, float(score[j, i])


def pyramid(lum: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """High-passed luminance at an eighth and at half the size."""
    return highpass(downsample(lum, 8)), highpass(downsample(lum, 2))


def template_places(cells: np.ndarray, block: int, shape: tuple[int, int], d: int, most: int = 150_000) -> np.ndarray:
    """Places at a scale whose centre lies on a masked cell, thinned to ``most``."""
    h, w = shape[0] // d, shape[1] // d
    y, x = np.mgrid[:h, :w] * d + d // 2
    on = cells[np.minimum(y // block, cells.shape[0] - 1), np.minimum(x // block, cells.shape[1] - 1)]
    places = np.flatnonzero(on.ravel())
    return places[:: max(len(places) // most, 1)]


def drift(reference: np.ndarray, current: np.ndarray, cells: np.ndarray, block: int, search: int) -> tuple[float, float, float] | None:
    """Shift in pixels between two luminances on the masked cells, in two scales; None if it can't be measured."""
    coarse_at, fine_at = (template_places(cells, block, reference.shape, d) for d in (8, 2))
    if cells.mean() < 0.02 or len(coarse_at) < 64 or len(fine_at) < 64:
        return None
    (rc, rf), (cc, cf) = pyramid(reference), pyramid(current)
    first = ncc_peak(rc, cc, coarse_at, 0, 0, max(-(-search // 8), 1))
    if first is None:
        return None
    near = [int(np.floor(abs(v) * 4 + 0.5) * np.sign(v)) for v in first[:2]]
    second = ncc_peak(rf, cf, fine_at, *near, 5)
    return None if second is None or second[2] < 0.25 else (second[0] * 2, second[1] * 2, second[2])


# ------------------------------------------------------- clean-sequence parts


def occlusion_weight(current: np.ndarray, combined: np.ndarray, fg: np.ndarray) -> np.ndarray:
    """At a quarter of the size: how far the current frame hides stars that the combined one shows."""
    h, w = fg.shape
    sh, sw = max(h // 4, 1), max(w // 4, 1)

    def small(image):
        lum = image.mean(axis=2)
        return lum[: sh * 4, : sw * 4].reshape(sh, min(4, h), sw, min(4, w)).mean(axis=(1, 3))

    hp = [np.abs(s - blur_thrice(s, 2)) for s in (small(current), small(combined))]
    sigma = upper_median(hp[0]) * 1.4826
    star = [blur_thrice(np.maximum(x - 3 * sigma, 0.0), 12) for x in hp]
    eps = 0.5 * star[1].mean()
    ratio = (star[0] + eps) / np.maximum(star[1] + eps, 1e-9)
    raw = smoothstep(-ratio, -0.75, -0.40)
    valid = ~fg[: sh * 4, : sw * 4].reshape(sh, min(4, h), sw, min(4, w)).any(axis=(1, 3))
    num, den = blur_thrice(raw * valid, 32), blur_thrice(valid.astype(float), 32)
    return np.where(valid & (den > 1e-6), num / np.maximum(den, 1e-6), 0.0)


def enlarge(weight: np.ndarray, h: int, w: int, d: int = 4) -> np.ndarray:
    """A small grid at pixel centres, bilinear, constant at the edges."""
    fy, fx = ((np.arange(n) + 0.5) / d - 0.5 for n in (h, w))
    y0, x0 = (np.clip(np.floor(f), 0, n - 1).astype(int) for f, n in ((fy, weight.shape[0]), (fx, weight.shape[1])))
    y1, x1 = np.minimum(y0 + 1, weight.shape[0] - 1), np.minimum(x0 + 1, weight.shape[1] - 1)
    ty, tx = np.clip(fy - y0, 0, 1)[:, None], np.clip(fx - x0, 0, 1)[None, :]
    top = weight[np.ix_(y0, x0)] * (1 - tx) + weight[np.ix_(y0, x1)] * tx
    low = weight[np.ix_(y1, x0)] * (1 - tx) + weight[np.ix_(y1, x1)] * tx
    return top * (1 - ty) + low * ty


def keep_occlusions(current: np.ndarray, combined: np.ndarray, fg: np.ndarray) -> tuple[np.ndarray, float]:
    small = occlusion_weight(current, combined, fg)
    wgt = enlarge(small, *fg.shape)[..., None]
    return combined * (1 - wgt) + current * wgt, float(small.mean())


def transient_mask(current: np.ndarray, combined: np.ndarray, fg: np.ndarray, used: np.ndarray | None = None) -> np.ndarray:
    """Long thin regions where the current frame differs from the combined one."""
    lum = combined.mean(axis=2)
    d = current.mean(axis=2) - lum
    p = np.pad(d, 1, mode="edge")
    d = sum(p[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)) / 9
    d = d - blur_thrice(d, 32)
    med = upper_median(d)
    sigma = max(upper_median(np.abs(d - med)) * 1.4826, 1e-9)
    sky = lum[~fg]
    mask = (np.abs(d - med) > 4 * sigma) & (lum >= 0.6 * (upper_median(sky) if len(sky) else 0.0))
    if used is not None:
        mask &= used >= 4
    ids = label(mask)
    keep = np.zeros(mask.size, dtype=bool)
    y, x = np.nonzero(mask)
    kinds, region = np.unique(ids[mask], return_inverse=True)
    if len(kinds):
        n = np.bincount(region)
        mean = [np.bincount(region, v) / n for v in (x, y)]
        dx, dy = x - mean[0][region], y - mean[1][region]
        cxx, cyy, cxy = (np.bincount(region, v) / n for v in (dx * dx, dy * dy, dx * dy))
        half = 0.5 * (cxx + cyy)
        disc = np.sqrt(np.maximum(half * half - (cxx * cyy - cxy * cxy), 0.0))
        long_ = np.sqrt((half + disc) / np.maximum(half - disc, 1e-9))
        extent = np.zeros(len(kinds), dtype=int)
        for v in (x, y):
            low, high = np.full(len(kinds), 1 << 30), np.full(len(kinds), -1)
            np.minimum.at(low, region, v)
            np.maximum.at(high, region, v)
            extent = np.maximum(extent, high - low + 1)
        keep[kinds[(extent >= 40) & (long_ >= 3.0)]] = True
    return dilate(mask & keep[np.maximum(ids, 0)], 2)


def levels(v: np.ndarray, low: np.ndarray) -> tuple[float, float]:
    """(median-like level, high level) of samples and their blur."""
    blurred = low[np.isfinite(low)]
    if not len(blurred):
        return 0.0, 0.0
    dark = 0.6 * pick(blurred, 0.5)
    sky = blurred[blurred >= dark]
    level = pick(sky if len(sky) else blurred, 0.2)
    fine = (v - low)[low >= dark]
    fine = fine[np.isfinite(fine)]
    return level, level + max(pick(fine, 0.999), 0.0) if len(fine) else 0.0


def level_stats(image: np.ndarray, masked: np.ndarray | None = None) -> np.ndarray:
    """Levels of each channel, for matching frames in brightness."""
    ok = np.ones(image.shape[:2], dtype=bool) if masked is None else ~masked
    return np.array([levels(image[..., c][ok], box_blur(image[..., c], 8)[ok]) for c in range(image.shape[2])])


def level_stats_at(y: np.ndarray, x: np.ndarray, v: np.ndarray) -> tuple[float, float]:
    """Levels of one channel given by its places, some of which may be missing."""
    return levels(v, blur_at(y, x, v, 8))
