"""Windows over time and over profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import array_upper_median
from .ordering import owned, spread


def half_window(size: int) -> int:
    """Half of a window: even sizes are rounded up to odd ones."""
    return (max(size, 1) | 1) // 2


def trimmed_window(df: DataFrame, by: list[str], at: str, value: str, masked: Column, size: int) -> DataFrame:
    """Add combined and n_used: the mean over neighbours in time without one least and one greatest.

    Under four samples it is the plain mean; a masked row keeps its own value and never feeds others.
    All four aggregates share one window, so a plan has one exchange and one sort.
    """
    half = half_window(size)
    w = Window.partitionBy(*by).orderBy(at).rowsBetween(-half, half)
    v = F.when(~masked, F.col(value))
    out = df.withColumns({"__s": F.sum(v).over(w), "__lo": F.min(v).over(w), "__hi": F.max(v).over(w), "n_used": F.count(v).over(w)})
    mean = F.when(F.col("n_used") >= 4, (F.col("__s") - F.col("__lo") - F.col("__hi")) / (F.col("n_used") - 2)).when(F.col("n_used") > 0, F.col("__s") / F.col("n_used"))
    return out.withColumn("combined", F.when(masked, F.col(value)).otherwise(F.coalesce(mean, F.col(value)))).drop("__s", "__lo", "__hi")


def trimmed_window_long(df: DataFrame, at: str, value: str, masked: Column, size: int) -> DataFrame:
    """The same for one long series, in blocks of positions (``at`` is a gapless position)."""
    half = half_window(size)
    out = trimmed_window(spread(df, at, half), ["__block"], at, value, masked, size)
    return owned(out)


def moving_median(df: DataFrame, by: list[str], at: str, value: str, size: int) -> DataFrame:
    """Add smooth: upper median of the values around (nulls skipped), fewer at the ends."""
    w = Window.partitionBy(*by).orderBy(at).rowsBetween(-(size // 2), size // 2)
    return df.withColumn("smooth", array_upper_median(F.sort_array(F.collect_list(value).over(w))))


def highpass_median(df: DataFrame, by: list[str], at: str, value: str, size: int) -> DataFrame:
    """Add fine: the value less its moving median, 0 where it is null."""
    return moving_median(df, by, at, value, size).withColumn("fine", F.coalesce(F.col(value) - F.col("smooth"), F.lit(0.0))).drop("smooth")


def highpass_median_round(df: DataFrame, by: list[str], at: str, value: str, size: int, period: int) -> DataFrame:
    """The same where position 0 follows position period - 1: half a window is repeated before and after."""
    half = size // 2
    turn = F.explode(F.array(F.lit(-period), F.lit(0), F.lit(period)))
    wide = df.withColumn("__turn", turn).withColumn("__at", F.col(at) + F.col("__turn")).where((F.col("__at") >= -half) & (F.col("__at") < period + half))
    return highpass_median(wide, by, "__at", value, size).where("__turn = 0").drop("__turn", "__at")


def running_min(df: DataFrame, by: list[str], at: str, value: str, name: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.min(value).over(w))


def fill(df: DataFrame, by: list[str], at: str, value: str, name: str, both: bool = True) -> DataFrame:
    """The last known value; before the first one, the next (``both``)."""
    w = Window.partitionBy(*by).orderBy(at)
    back = F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(value, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(name, F.coalesce(back, ahead) if both else back)


def fill_linear(df: DataFrame, by: list[str], at: str, value: str, name: str) -> DataFrame:
    """Linear between known values, constant outside, 0 where there is none."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("at"), F.col(value).alias("v")))
    w = Window.partitionBy(*by).orderBy(at)
    out = df.withColumn("__b", F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__a", F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    b, a = F.col("__b"), F.col("__a")
    t = (F.col(at) - b["at"]) / F.greatest(a["at"] - b["at"], F.lit(1))
    return out.withColumn(name, F.when(b.isNull(), F.coalesce(a["v"], F.lit(0.0))).when(a.isNull(), b["v"]).otherwise(b["v"] * (1 - t) + a["v"] * t)).drop("__b", "__a")


def window_means(df: DataFrame, by: list[str], r: int, value: str, x: str = "gx", y: str = "gy") -> DataFrame:
    """Add mean and n over the square of 2 r + 1: cumulative sums along each axis."""
    row = Window.partitionBy(*by, y).orderBy(x).rangeBetween(-r, r)
    column = Window.partitionBy(*by, x).orderBy(y).rangeBetween(-r, r)
    out = df.withColumn("__s", F.sum(value).over(row)).withColumn("__n", F.count(value).over(row))
    return out.withColumn("n", F.sum("__n").over(column)).withColumn("mean", F.sum("__s").over(column) / F.col("n")).drop("__s", "__n")


def deviation_band(df: DataFrame, by: list[str], value: str, k: float) -> DataFrame:
    """Add ok: within k median absolute values of zero, over each group.  The group's median is one more aggregate joined on the group."""
    mad = df.groupBy(*by).agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY abs({value}) DESC)").alias("__mad"))
    return df.join(mad, by).withColumn("ok", F.abs(F.col(value)) <= k * F.greatest("__mad", F.lit(1e-9))).drop("__mad")
