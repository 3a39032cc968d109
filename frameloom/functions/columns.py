"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def upper_median(name: str) -> Column:
    """Aggregate: the value at place n // 2 of the ascending order (nulls skipped)."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {name} DESC)")


def array_upper_median(sorted_values: Column) -> Column:
    """The same of an ascending array; null if it is empty."""
    return F.get(sorted_values, F.floor(F.size(sorted_values) / 2).cast("int"))


def array_pick(sorted_values: Column, share: float) -> Column:
    """Value at place min(floor(n * share), n - 1) of an ascending array."""
    n = F.size(sorted_values)
    return F.get(sorted_values, F.least(F.floor(n * F.lit(share)).cast("int"), n - 1))


def let(value: Column, body) -> Column:
    """``body`` of a value that nested functions use but that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, col(low)), col(high))


def smoothstep(x: Column, start, end) -> Column:
    """0 at ``start``, 1 at ``end``, t * t * (3 - 2 t) between."""
    t = clamp((x - col(start)) / (col(end) - col(start)), 0.0, 1.0)
    return t * t * (3 - 2 * t)


def same_sign_least(a: Column, b: Column) -> Column:
    """The smaller of two magnitudes where the signs agree, else 0."""
    return F.when(a * b > 0, F.signum(a) * F.least(F.abs(a), F.abs(b))).otherwise(0.0)


def finite(x: Column) -> Column:
    """NaN and infinities as null, so that aggregates skip them."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def luminance(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def poly_terms(u: Column, v: Column) -> list[Column]:
    """The ten terms of a cubic in two variables, by rising degree."""
    return [F.lit(1.0), u, v, u * u, u * v, v * v, u * u * u, u * u * v, u * v * v, v * v * v]


def poly_value(coefficients: Column, u: Column, v: Column) -> Column:
    return sum((F.get(coefficients, F.lit(k)) * t for k, t in enumerate(poly_terms(u, v))), F.lit(0.0))


def harmonic(order: int, theta: Column) -> Column:
    """Angular weight of the profile of an order (0: none)."""
    return F.cos(order * theta) if order else F.lit(1.0)


def radial_value(profile: Column, r: Column, step) -> Column:
    """Linear in the profile, constant past its end."""
    t = r / col(step)
    i = F.floor(t).cast("int")
    last = F.size(profile) - 1
    return F.when(i + 1 > last, F.get(profile, last)).otherwise(F.get(profile, i) * (1 - (t - i)) + F.get(profile, i + 1) * (t - i))


def full_radius(cx, cy, w, h) -> Column:
    cx, cy, w, h = map(col, (cx, cy, w, h))
    return F.greatest(F.least(cx, cy, w - cx, h - cy), F.lit(1.0))


def corner_radius(cx, cy, w, h) -> Column:
    cx, cy, w, h = map(col, (cx, cy, w, h))
    return F.hypot(F.greatest(cx, w - cx), F.greatest(cy, h - cy))


def white_balance(r: Column, g: Column, b: Column) -> Column:
    """Ratios to green."""
    g = F.greatest(g, F.lit(1.0))
    return F.array(r / g, F.lit(1.0), b / g)


def quantise(v: Column, black, white) -> Column:
    """16-bit sample: clamped, half up."""
    span = F.greatest(col(white) - col(black), F.lit(1e-6))
    return F.floor(clamp((v - col(black)) * 65535.0 / span, 0.0, 65535.0) + 0.5).cast("int")


def background_level(median: Column, black: Column, white: Column) -> Column:
    return F.when(white - black > 1e-9, (median - black) / (white - black)).otherwise(0.0)


def matrix_srational(m: Column) -> Column:
    """Numerators over 10000 of a flat matrix, half away from zero."""
    return F.transform(m, lambda v: F.round(v * 10000).cast("int"))


def colour_matrix(m: Column) -> Column:
    """Three rows of a flat 4 x 3 matrix: identity if all zero, over 10000 if its entries are that large."""
    rows = F.slice(m, 1, 9)
    biggest = F.array_max(F.transform(rows, F.abs))
    unit = F.array(*(F.lit(float(k % 4 == 0)) for k in range(9)))
    return F.when(biggest == 0, unit).when(biggest > 10, F.transform(rows, lambda v: v / 10000)).otherwise(rows)


def dawn_weight(ratio: Column, start: float = 1.5, end: float = 2.3) -> Column:
    """How far a frame is left to dawn: the squared ramp, zero under 0.02."""
    t = smoothstep(ratio, start, end)
    return F.when(t * t < 0.02, 0.0).otherwise(t * t)


def dome_bounds(ratio: Column) -> tuple[Column, Column]:
    """Limits of the dome's gain for a frame's level ratio."""
    r = F.when(ratio > 0, ratio).otherwise(1.0)
    low = F.greatest(F.least(r, F.lit(1.0)) * 0.85, F.lit(0.3))
    return low, F.greatest(F.least(F.greatest(r, F.lit(1.0)) * 1.15, F.lit(3.0)), low)


def anomaly_damping(spread: Column, level: Column) -> Column:
    """Share of a frame's anomaly surface that is kept: all up to a quarter of the sky, none from one sky on."""
    return 1 - smoothstep(spread / F.greatest(level, F.lit(1e-9)), 0.25, 1.0)


def contrast_gain(k: Column, pedestal: Column, strength: float) -> Column:
    return 1 / (1 - F.least(strength * F.greatest(k, F.lit(0.0)) / F.greatest(pedestal, F.lit(1e-9)), F.lit(0.5)))


def flat_deficit(t: Column, level: Column, ratio: Column) -> Column:
    return (1 - clamp(t, 0.15, 1.0)) * level * ratio


def sidereal_motion(seconds: Column, diagonal) -> Column:
    """Pixels that the sky moves in half a session, at a quarter of the diagonal from the pole."""
    return seconds / 2 * (2 * 3.141592653589793 / 86164) * 0.25 * col(diagonal)
