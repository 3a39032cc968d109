"""Dense fits on one small grid: smooth models, bilinear surfaces, directions and lines.  numpy, double precision."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..functions.kernels import smoothstep, upper_median, window_sum

#: Angular orders; spoke width and inner radius; directional profile step and smoothing.
HARMONICS = (0, 2, 4)
SPOKE_DEG, SPOKE_R, PROFILE_STEP, PROFILE_SMOOTH = 0.5, 0.15, 96.0, 7


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """A dense system; None if it is singular."""
    try:
        x = np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return None
    return x if np.isfinite(x).all() else None


def centres(gw: int, gh: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    y, x = np.mgrid[:gh, :gw]
    return x * block + block / 2, y * block + block / 2


def cubic_terms(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.stack([np.ones_like(u), u, v, u * u, u * v, v * v, u**3, u * u * v, u * v * v, v**3], axis=-1)


def along(profile: np.ndarray, r: np.ndarray, step: float) -> np.ndarray:
    return np.interp(r / step, np.arange(len(profile)), profile)


def corner_radius(cx: float, cy: float, w: float, h: float) -> float:
    return float(np.hypot(max(cx, w - cx), max(cy, h - cy)))


def full_radius(cx: float, cy: float, w: float, h: float) -> float:
    return max(min(cx, cy, w - cx, h - cy), 1.0)


@dataclass
class Smooth:
    """Cubic plus radial profiles with angular weights, about a centre."""

    poly: np.ndarray
    profiles: np.ndarray
    cx: float
    cy: float
    step: float
    w: float
    h: float
    spread: float

    def at(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        r, th = np.hypot(x - self.cx, y - self.cy), np.arctan2(y - self.cy, x - self.cx)
        out = cubic_terms(x / self.w * 2 - 1, y / self.h * 2 - 1) @ self.poly
        return out + sum(along(p, r, self.step) * np.cos(k * th) for k, p in zip(HARMONICS, self.profiles, strict=True))


def fit_smooth(values: np.ndarray, block: int, cx: float, cy: float, step: float, exclude: np.ndarray | None = None, passes: int = 5) -> Smooth:
    """Iterated least squares: cells further than three median residuals drop out of the next pass."""
    gh, gw = values.shape
    w, h = float(gw * block), float(gh * block)
    x, y = (a.ravel() for a in centres(gw, gh, block))
    v = values.ravel()
    n_bins = int(np.ceil(corner_radius(cx, cy, w, h) / step)) + 2
    r, th = np.hypot(x - cx, y - cy), np.arctan2(y - cy, x - cx)
    k = np.minimum((r / step).astype(int), n_bins - 2)
    f = np.clip(r / step - k, 0, 1)
    hat = np.zeros((len(v), n_bins))
    rows = np.arange(len(v))
    hat[rows, k] = 1 - f
    hat[rows, k + 1] += f
    a = np.concatenate([cubic_terms(x / w * 2 - 1, y / h * 2 - 1), *(hat * np.cos(m * th)[:, None] for m in HARMONICS)], axis=1)
    bend = np.diff(np.eye(n_bins), 2, axis=0)
    penalty = np.zeros((a.shape[1],) * 2)
    for p, ridge in enumerate((1e-4, 2.0, 2.0)):
        at = slice(10 + p * n_bins, 10 + (p + 1) * n_bins)
        penalty[at, at] = 200.0 * bend.T @ bend + ridge * np.eye(n_bins)
    ok = np.isfinite(v) if exclude is None else np.isfinite(v) & ~exclude.ravel()
    level = max(abs(upper_median(v[np.isfinite(v)])), 1e-6)
    keep, sol, spread = ok.copy(), np.zeros(a.shape[1]), 0.0
    for it in range(passes):
        found = solve(a[keep].T @ a[keep] + penalty, a[keep].T @ v[keep])
        if found is None:
            break
        sol = found
        off = np.abs(v - a @ sol)
        spread = upper_median(off[ok])
        if it + 1 < passes and spread > 0:
            keep = ok & (off <= 3 * max(spread, 1e-4 * level))
    return Smooth(sol[:10], sol[10:].reshape(len(HARMONICS), n_bins), cx, cy, step, w, h, spread)


def centre_candidates(best: tuple[float, float], half: tuple[float, float], steps: int, w: float, h: float) -> np.ndarray:
    i = np.arange(-steps, steps + 1) / steps
    x = np.clip(best[0] + i * half[0], w * 0.25, w * 0.75)
    y = np.clip(best[1] + i * half[1], h * 0.25, h * 0.75)
    return np.array([(a, b) for b in y for a in x])


def find_centre(values: np.ndarray, block: int, exclude: np.ndarray | None = None, levels: int = 4, spreads=None) -> tuple[float, float]:
    """Centre with the least residual, on ever finer grids.  ``spreads`` may score candidates elsewhere (in parallel)."""
    gh, gw = values.shape
    w, h = float(gw * block), float(gh * block)
    score = spreads or (lambda c: np.array([fit_smooth(values, block, x, y, 2.0 * block, exclude).spread for x, y in c]))
    best, least, half, steps = (w / 2, h / 2), np.inf, (w / 4, h / 4), 5
    for _ in range(levels):
        c = centre_candidates(best, half, steps, w, h)
        s = score(c)
        k = int(np.argmin(s))
        if s[k] < least:
            best, least = (float(c[k][0]), float(c[k][1])), float(s[k])
        half, steps = (half[0] / steps, half[1] / steps), 3
    return best


@dataclass
class Surface:
    """Values on a grid of nodes, bilinear between."""

    nodes: np.ndarray
    step: float

    @property
    def range(self) -> float:
        return float(self.nodes.max() - self.nodes.min())

    def at(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        ny, nx = self.nodes.shape
        fx, fy = np.clip(x / self.step, 0, nx - 1 - 1e-3), np.clip(y / self.step, 0, ny - 1 - 1e-3)
        i, j = np.floor(fx).astype(int), np.floor(fy).astype(int)
        tx, ty = fx - i, fy - j
        n = self.nodes
        return (n[j, i] * (1 - tx) + n[j, i + 1] * tx) * (1 - ty) + (n[j + 1, i] * (1 - tx) + n[j + 1, i + 1] * tx) * ty


def fit_surface(resid: np.ndarray, ok: np.ndarray, block: int, step_cells: int, stiffness: float, symmetric: bool = False, bases: tuple[np.ndarray, ...] = (), robust: bool = True) -> tuple[Surface, np.ndarray]:
    """Bilinear nodes with a bending penalty, and a coefficient for each extra basis, by conjugate gradients.

    Robust: six passes; cells outside the band of the last residuals drop out (symmetric, or a
    lower envelope that gives little room above and more below).
    """
    gh, gw = resid.shape
    step = float(step_cells * block)
    nx, ny = gw // step_cells + 2, gh // step_cells + 2
    x, y = (a.ravel() / step for a in centres(gw, gh, block))
    i, j = np.minimum(x.astype(int), nx - 2), np.minimum(y.astype(int), ny - 2)
    tx, ty = x - i, y - j
    at = np.stack([j * nx + i, j * nx + i + 1, (j + 1) * nx + i, (j + 1) * nx + i + 1], axis=1)
    wgt = np.stack([(1 - tx) * (1 - ty), tx * (1 - ty), (1 - tx) * ty, tx * ty], axis=1)
    extra = np.stack([b.ravel() for b in bases], axis=1) if bases else np.zeros((gw * gh, 0))
    nn, v, good = nx * ny, resid.ravel(), ok.ravel()
    v = np.where(good, v, 0.0)

    def model(sol):
        return (sol[at] * wgt).sum(axis=1) + extra @ sol[nn:]

    def back(values):
        return np.concatenate([np.bincount(at.ravel(), (wgt * values[:, None]).ravel(), nn), extra.T @ values])

    def bend(grid):
        g, out = grid.reshape(ny, nx), np.zeros((ny, nx))
        d = g[:, :-2] - 2 * g[:, 1:-1] + g[:, 2:]
        out[:, :-2] += d
        out[:, 1:-1] -= 2 * d
        out[:, 2:] += d
        d = g[:-2] - 2 * g[1:-1] + g[2:]
        out[:-2] += d
        out[1:-1] -= 2 * d
        out[2:] += d
        return out.ravel()

    keep, sol = good.copy(), np.zeros(nn + extra.shape[1])
    for _ in range(6 if robust else 1):
        k = keep.astype(float)
        apply = lambda s, k=k: back(model(s) * k) + np.concatenate([stiffness * bend(s[:nn]) + 1e-6 * s[:nn], 1e-9 * s[nn:]])
        r = back(v * k) - apply(sol)
        p, rr = r.copy(), float(r @ r)
        least = 1e-12 * max(rr, 1e-30)
        for _ in range(400):
            if rr < least:
                break
            ap = apply(p)
            pap = float(p @ ap)
            if pap <= 0:
                break
            a = rr / pap
            sol, r = sol + a * p, r - a * ap
            new = float(r @ r)
            p, rr = r + new / rr * p, new
        off = v - model(sol)
        mad = max(upper_median(np.abs(off[good])), 1e-9)
        keep = good & ((np.abs(off) <= 2.5 * mad) if symmetric else ((off <= 2 * mad) & (off >= -5 * mad)))
    return Surface(sol[:nn].reshape(ny, nx), step), sol[nn:]


def smooth_nodes(s: Surface, sigma_px: float = 150.0) -> Surface:
    sigma = sigma_px / s.step
    r = int(np.ceil(3 * sigma))
    kernel = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    kernel /= kernel.sum()
    out = s.nodes
    for axis in (1, 0):
        wide = np.pad(out, [(r, r) if k == axis else (0, 0) for k in range(2)], mode="edge")
        out = sum(k * np.take(wide, np.arange(out.shape[axis]) + d, axis) for d, k in enumerate(kernel))
    return Surface(out, s.step)


def agreed(a: Surface, b: Surface) -> tuple[Surface, float]:
    """What two halves of a session both show: same sign, smaller magnitude, each about its median."""
    x, y = a.nodes - upper_median(a.nodes), b.nodes - upper_median(b.nodes)
    both = np.where(x * y > 0, np.sign(x) * np.minimum(np.abs(x), np.abs(y)), 0.0)
    total = 0.5 * (np.abs(x) + np.abs(y)).sum()
    return Surface(both, a.step), float(np.abs(both).sum() / total) if total > 0 else 0.0


def fill_gaps(v: np.ndarray) -> np.ndarray:
    ok = np.isfinite(v)
    return np.interp(np.arange(len(v)), np.flatnonzero(ok), v[ok]) if ok.any() else np.zeros_like(v)


def _median_filter(v: np.ndarray, size: int, wrap: bool = False) -> np.ndarray:
    half, n = size // 2, len(v)
    out = np.full(n, np.nan)
    for i in range(n):
        k = np.arange(i - half, i + half + 1)
        part = v[k % n] if wrap else v[k[(k >= 0) & (k < n)]]
        part = part[np.isfinite(part)]
        out[i] = upper_median(part) if len(part) else np.nan
    return out


def highpass_1d(v: np.ndarray, size: int, wrap: bool = False) -> np.ndarray:
    low = _median_filter(v, size, wrap)
    return np.where(np.isfinite(v) & np.isfinite(low), v - low, 0.0)


@dataclass
class Lines:
    """Offsets of cell rows, and of directions from the centre."""

    rows: np.ndarray
    spokes: np.ndarray
    block: float

    def at(self, y, r, theta, r_full):
        out = np.interp(y / self.block - 0.5, np.arange(len(self.rows)), self.rows)
        fb = (np.degrees(theta) % 360) / SPOKE_DEG
        b = np.floor(fb).astype(int) % len(self.spokes)
        spoke = self.spokes[b] * (1 - (fb - np.floor(fb))) + self.spokes[(b + 1) % len(self.spokes)] * (fb - np.floor(fb))
        return out + spoke * np.clip((r / r_full - SPOKE_R) / SPOKE_R, 0, 1)


def fit_lines(resid: np.ndarray, ok: np.ndarray, block: int, cx: float, cy: float, r_full: float) -> Lines:
    gh, gw = resid.shape
    x, y = centres(gw, gh, block)
    r, deg = np.hypot(x - cx, y - cy), np.degrees(np.arctan2(y - cy, x - cx)) % 360
    good = ok & (np.abs(resid) <= 3 * max(upper_median(np.abs(resid[ok])), 1e-9))
    raw = np.array([upper_median(resid[j][good[j]]) if good[j].sum() >= gw // 4 and good[j].any() else np.nan for j in range(gh)])
    rows = highpass_1d(raw, 9)
    n = int(360 / SPOKE_DEG)
    spoke = np.minimum((deg / SPOKE_DEG).astype(int), n - 1)
    left = resid - rows[:, None]
    far = good & (r >= SPOKE_R * r_full)
    raw = np.full(n, np.nan)
    for b in np.unique(spoke[far]):
        part = left[far & (spoke == b)]
        if len(part) >= 6:
            raw[b] = upper_median(part)
    return Lines(rows, highpass_1d(raw, 41, True), float(block))


@dataclass
class Direction:
    """A profile along one direction through the centre."""

    degrees: float
    start: float
    profile: np.ndarray

    def at(self, dx, dy):
        d = dx * np.cos(np.radians(self.degrees)) + dy * np.sin(np.radians(self.degrees))
        return np.interp((d - self.start) / PROFILE_STEP, np.arange(len(self.profile)), self.profile)


def direction_profile(resid, good, d, start, n_bins, least: int = 6) -> np.ndarray:
    b = np.minimum(((d - start) / PROFILE_STEP).astype(int), n_bins - 1)
    raw = np.full(n_bins, np.nan)
    for k in np.unique(b[good]):
        part = resid[good & (b == k)]
        if len(part) >= least:
            raw[k] = upper_median(part)
    out = _median_filter(fill_gaps(raw), PROFILE_SMOOTH)
    return out - upper_median(out)


def fit_direction(resid: np.ndarray, ok: np.ndarray, block: int, cx: float, cy: float, degrees=tuple(range(0, 360, 2)), least: int = 6) -> Direction:
    """The direction whose profile leaves the least median residual (the first of equals)."""
    gh, gw = resid.shape
    x, y = centres(gw, gh, block)
    x, y = x - cx, y - cy
    corner = corner_radius(cx, cy, gw * block, gh * block)
    n_bins = int(np.ceil(2 * corner / PROFILE_STEP)) + 2
    mad = max(upper_median(np.abs(resid[ok])), 1e-9)
    good = ok & (resid <= 2 * mad) & (resid >= -5 * mad)
    best = None
    for deg in degrees:
        d = x * np.cos(np.radians(deg)) + y * np.sin(np.radians(deg))
        p = direction_profile(resid, good, d, -corner, n_bins, least)
        left = np.abs(resid - np.interp((d + corner) / PROFILE_STEP, np.arange(n_bins), p))[good]
        score = upper_median(left)
        if best is None or score < best[0]:
            best = score, Direction(float(deg), -corner, p)
    return best[1]


@dataclass
class Glare:
    """The session's additive model of one channel; ``correction`` is what it adds about its pedestal."""

    smooth: Smooth
    block: int
    surface: Surface | None = None
    coarse: Surface | None = None
    verified: bool = False
    agreement: float = 0.0
    lines: Lines | None = None
    direction: Direction | None = None
    pedestal: float = 0.0
    notes: dict = field(default_factory=dict)

    def at(self, x, y):
        x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
        s = self.smooth
        out = s.at(x, y)
        dx, dy = x - s.cx, y - s.cy
        r, full = np.hypot(dx, dy), full_radius(s.cx, s.cy, s.w, s.h)
        if self.surface is not None:
            if self.verified:
                out = out + self.surface.at(x, y)
            else:
                a, b = self.coarse.at(x, y), self.coarse.at(2 * s.cx - x, y)
                shared = np.where(a * b > 0, np.sign(a) * np.minimum(np.abs(a), np.abs(b)), 0.0)
                out = out + (self.surface.at(x, y) - a + shared) * smoothstep(r / full, 0.5, 0.9)
        if self.direction is not None:
            out = out + self.direction.at(dx, dy)
        if self.lines is not None:
            out = out + self.lines.at(y, r, np.arctan2(dy, dx), full)
        return out

    def correction(self, x, y):
        return self.at(x, y) - self.pedestal


def fit_glare(values: np.ndarray, block: int, valid: np.ndarray | None = None, centre: tuple[float, float] | None = None, with_surface: bool = True, halves: tuple[np.ndarray, np.ndarray, float] | None = None) -> Glare:
    """All parts, each on the residual of those before: smooth, surface, lines, direction; then the pedestal.

    ``halves``: the session's two half maps and the sky's motion between them; with 300 px or more
    the surface is what both halves show, and it is taken whole.
    """
    gh, gw = values.shape
    ok = np.isfinite(values) if valid is None else np.isfinite(values) & valid
    cx, cy = centre or find_centre(values, block, ~ok)
    model = Glare(fit_smooth(values, block, cx, cy, 2.0 * block, ~ok), block)
    x, y = centres(gw, gh, block)
    if with_surface:
        fit = lambda v: fit_surface(v - model.smooth.at(x, y), ok & np.isfinite(v), block, 2, 2.0)[0]
        surface = fit(values)
        if halves and halves[2] >= 300.0:
            surface, model.agreement = agreed(fit(halves[0]), fit(halves[1]))
            model.verified = True
        model.surface, model.coarse = surface, smooth_nodes(surface)
        r_full = full_radius(cx, cy, float(gw * block), float(gh * block))
        model.lines = fit_lines(values - model.at(x, y), ok, block, cx, cy, r_full)
        model.direction = fit_direction(values - model.at(x, y), ok, block, cx, cy)
    model.pedestal = upper_median(model.at(x, y)[ok])
    return model


@dataclass
class FrameAnomaly:
    """What one frame's background has beyond the session's."""

    surface: Surface
    pedestal: float
    range: float
    gain: float
    dome: float
    low: np.ndarray
    mean: float
    level_ratio: float
    block: int

    def correction(self, k: np.ndarray, x: np.ndarray, y: np.ndarray, cx: float, cy: float, r_full: float) -> np.ndarray:
        """The model's correction ``k`` at pixels, with this frame's gain, dome and surface."""
        half = self.block / 2
        lp = Surface(self.low, float(self.block)).at(x - half, y - half)
        wgt = smoothstep(np.hypot(x - cx, y - cy) / r_full, 0.20, 0.35)
        return k + (self.gain - 1) * (k - lp) * wgt + (self.dome - 1) * (k - self.mean) + self.surface.at(x, y) - self.pedestal

    def packed(self) -> np.ndarray:
        """All of it as one flat array, to travel in a row."""
        facts = [self.surface.step, self.pedestal, self.range, self.gain, self.dome, self.mean, self.level_ratio, self.block, *self.surface.nodes.shape, *self.low.shape]
        return np.concatenate([np.asarray(facts, dtype=float), self.surface.nodes.ravel(), self.low.ravel()])

    @classmethod
    def unpacked(cls, v: np.ndarray) -> FrameAnomaly:
        step, pedestal, spread, gain, dome, mean, ratio, block = (float(x) for x in v[:8])
        ny, nx, gh, gw = (int(x) for x in v[8:12])
        return cls(Surface(v[12 : 12 + ny * nx].reshape(ny, nx), step), pedestal, spread, gain, dome, v[12 + ny * nx :].reshape(gh, gw), mean, ratio, int(block))


def fit_anomaly(frame: np.ndarray, session: np.ndarray, sky: np.ndarray, model: Glare, mode: str = "full") -> FrameAnomaly:
    """A frame's background less the session's: a stiff surface, a gain of the halo and one of the dome.

    Modes: full (surface of 8 cells), coarse (32 cells, stiffer), none (a constant).  A frame far
    brighter than the session is fitted without rejection, softer, and without the halo's gain.
    """
    gh, gw = frame.shape
    block, s = model.block, model.smooth
    x, y = centres(gw, gh, block)
    resid, k = frame - session, model.correction(x, y)
    level, ref = upper_median(frame[sky]), upper_median(session[sky])
    ratio = level / ref if ref > 0 else 1.0
    if mode == "none":
        p = upper_median(resid[sky])
        return FrameAnomaly(Surface(np.full((2, 2), p), float(max(gw, gh) * block)), p, 0.0, 1.0, 1.0, np.zeros((gh, gw)), 0.0, ratio, block)
    cells, stiff = {"full": (8, 100.0), "coarse": (32, 1000.0)}[mode]
    n = window_sum(sky.astype(float), cells)
    low = np.where(n > 0, window_sum(np.where(sky, k, 0.0), cells) / np.maximum(n, 1), k)
    r_full = full_radius(s.cx, s.cy, s.w, s.h)
    fine = (k - low) * smoothstep(np.hypot(x - s.cx, y - s.cy) / r_full, 0.20, 0.35)
    mean = float(k[sky].mean()) if sky.any() else 0.0
    bright = ratio > 1.6
    if bright:
        surface, coef = fit_surface(resid, sky, block, cells, 0.1 * stiff, True, (k - mean,), False)
        gain, dome = 1.0, 1 + coef[0]
    else:
        surface, coef = fit_surface(resid, sky, block, cells, stiff, True, (fine, k - mean))
        gain, dome = float(np.clip(1 + coef[0], 1.0, 3.0)), 1 + coef[1]
    r = ratio if np.isfinite(ratio) and ratio > 0 else 1.0
    least = max(min(r, 1.0) * 0.85, 0.3)
    dome = float(np.clip(dome, least, max(min(max(r, 1.0) * 1.15, 3.0), least)))
    v = surface.at(x, y)[sky]
    pedestal, spread = (upper_median(v), float(v.max() - v.min())) if len(v) else (0.0, 0.0)
    damp = float(1 - smoothstep(spread / max(level, 1e-9), 0.25, 1.0))
    surface = Surface(pedestal + damp * (surface.nodes - pedestal), surface.step)
    return FrameAnomaly(surface, pedestal, spread * damp, gain, dome, low, mean, ratio, block)


def foreground(values: np.ndarray, block: int) -> np.ndarray:
    """Cells far under a smooth model of the frame itself, without specks, grown by one."""
    from ..functions.kernels import dilate, drop_small

    gh, gw = values.shape
    x, y = centres(gw, gh, block)
    mask = np.zeros(values.shape, dtype=bool)
    for _ in range(2):
        pred = fit_smooth(values, block, gw * block / 2, gh * block / 2, 2.0 * block, mask).at(x, y)
        mask = (pred > 0) & (values < 0.55 * pred)
    return dilate(drop_small(mask, 2), 1)
