"""The frame catalog: listing, time, and selection of frames by session-relative rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import upper_median

#: Extensions of camera files.
RAW_EXTENSIONS = (
    "3fr", "ari", "arw", "cr2", "crw", "dcr", "dcs", "dng", "erf", "fff", "iiq", "kdc", "mef", "mos",
    "mrw", "nef", "nrw", "orf", "pef", "raf", "raw", "rw2", "rwl", "sr2", "srf", "srw", "x3f",
)

#: Cloud cover of stack, model and report; level of a saturated sky; least model frames; least inliers.
CLOUD_STACK, CLOUD_MODEL, CLOUD_REPORT = 0.5, 0.02, 0.05
SATURATED, MODEL_FRAMES, LEAST_INLIERS = 0.85, 24, 6


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def is_raw(path: Column) -> Column:
    return extension(path).isin(*RAW_EXTENSIONS)


def list_frames(files: DataFrame, path: str = "path", limit: int | None = None) -> DataFrame:
    """Camera files in path order with their index; ``limit`` applies after the sort and before any decoding."""
    from .ordering import numbered

    found = files.where(is_raw(F.col(path)))
    if limit is not None:
        found = found.orderBy(path).limit(limit)
    return numbered(found, [path], "frame_idx")


def capture_seconds(original: Column, digitised: Column, modified: Column) -> Column:
    """Naive seconds of "YYYY:MM:DD HH:MM:SS", the first tag that is there (session time zone UTC)."""
    text = F.coalesce(original, digitised, modified)
    return F.unix_timestamp(F.try_to_timestamp(F.substring(F.trim(text), 1, 19), F.lit("yyyy:MM:dd HH:mm:ss")))


def describe(model: Column, lens: Column) -> Column:
    both = F.concat_ws(" + ", model, lens)
    return F.when(both == "", F.lit("no identifying tags")).otherwise(both)


def session_facts(catalog: DataFrame, cap: float) -> DataFrame:
    """One row: median positive level, number of frames, frames that pass the foreground cap."""
    return catalog.agg(
        upper_median("CASE WHEN level > 0 THEN level END").alias("med"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("aligned") & (F.col("fg") <= cap)).alias("clear"),
    )


def stack_selection(catalog: DataFrame, tolerance: float = 1.6, cap: float | None = None, untracked: bool = False) -> DataFrame:
    """Add reject_reason (null: stacked), in_stack, export.  The first failing rule is the reason.

    When fewer than a fifth of the frames pass a foreground cap under 0.6, the cap becomes 0.6.
    """
    cap = max(cap if cap is not None else (1.0 if untracked else 0.0), 0.0)
    tol = max(tolerance, 1.0)
    facts = session_facts(catalog, cap)
    relaxed = (F.col("clear") < F.greatest(F.floor(F.col("n") / 5), F.lit(1))) & F.lit(cap < 0.6)
    facts = facts.select(F.coalesce("med", F.lit(0.0)).alias("__med"), F.when(relaxed, 0.6).otherwise(cap).alias("__cap"))
    out = catalog.crossJoin(F.broadcast(facts))  # one row of facts
    level, med = F.col("level"), F.col("__med")
    reason = (
        F.when(~F.col("aligned"), "unaligned")
        .when(F.col("fg") > F.col("__cap"), "foreground")
        .when(F.col("cloud") > CLOUD_STACK, "cloud")
        .when((med > 0) & (level > med * tol), "bright")
        .when((med > 0) & (level < med / tol), "dark")
    )
    out = out.withColumn("reject_reason", reason).withColumn("in_stack", F.col("reject_reason").isNull())
    return out.withColumn("export", level < SATURATED).drop("__med", "__cap")


def selection_report(selected: DataFrame) -> DataFrame:
    """One row of counters."""
    why = F.col("reject_reason")
    counts = {k: F.count_if(why == k) for k in ("unaligned", "foreground", "cloud", "bright", "dark")}
    return selected.agg(
        F.count(F.lit(1)).alias("n_frames"), F.count_if("in_stack").alias("n_stack"), F.count_if(~F.col("export")).alias("n_saturated"),
        F.count_if(F.col("cloud") > CLOUD_REPORT).alias("n_clouded"), F.count_if(F.col("fg") > 0).alias("n_with_foreground"),
        *(v.alias(f"n_{k}") for k, v in counts.items()),
    )


def model_frames(selected: DataFrame, least: int = MODEL_FRAMES) -> DataFrame:
    """Add in_model: clear stacked frames; if there are too few, the least clouded stacked frames as well."""
    clear = F.col("in_stack") & (F.col("cloud") <= CLOUD_MODEL)
    facts = selected.agg(F.count_if(clear).alias("__clear"), F.count_if("in_stack").alias("__stack"))
    first = selected.where("in_stack").orderBy("cloud", "frame_idx").limit(least).select("frame_idx", F.lit(True).alias("__first"))  # ``least`` rows
    out = selected.crossJoin(F.broadcast(facts)).join(F.broadcast(first), "frame_idx", "left")
    short = F.col("__clear") < F.least(F.lit(least), F.col("__stack"))
    return out.withColumn("in_model", clear | (short & F.coalesce("__first", F.lit(False)))).drop("__clear", "__stack", "__first")


def levels_reference(selected: DataFrame) -> DataFrame:
    """The stacked frame whose level is nearest the stack's median, the first of equals."""
    med = selected.where("in_stack").agg(upper_median("level").alias("__med"))
    near = selected.where("in_stack").crossJoin(F.broadcast(med)).withColumn("distance", F.abs(F.col("level") - F.col("__med")))
    return near.orderBy("distance", "frame_idx").limit(1).select("frame_idx", "level", "distance")


def export_order(selected: DataFrame, white: float, stabilise: bool = False) -> DataFrame:
    """Frames to export and their positions.

    Saturated frames stay out; so do frames past the white level that are far brighter than the
    session.  Without stabilisation, a frame with no catalog level is exported too.
    """
    from .ordering import numbered

    med = selected.where("level > 0").agg(F.coalesce(upper_median("level"), F.lit(0.0)).alias("__med"))
    out = selected.crossJoin(F.broadcast(med))
    dawn = (F.col("level") >= white) & (F.col("__med") > 0) & (F.col("level") / F.col("__med") >= 2.3)
    keep = F.when(F.col("level").isNull(), F.lit(not stabilise)).otherwise((F.col("level") < SATURATED) & ~dawn)
    return numbered(out.where(keep).drop("__med"), ["frame_idx"], "position")


def same_size(frames: DataFrame) -> DataFrame:
    """Frames of the first frame's size; the others are dropped."""
    first = frames.orderBy("frame_idx").limit(1).select(F.col("width").alias("__w"), F.col("height").alias("__h"))
    return frames.crossJoin(F.broadcast(first)).where((F.col("width") == F.col("__w")) & (F.col("height") == F.col("__h"))).drop("__w", "__h")


def with_catalog(frames: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog facts of each frame, null where there are none."""
    return frames.join(catalog, "frame_idx", "left")


#: What marks a report line as a warning, case kept.
WARNINGS = ("WARNING", "LOAD FAILED", "NOT ALIGNED", "different dimensions", "implausible alignment")


def is_warning(line: Column) -> Column:
    """Report lines that a reader should not miss; others (a drift that could not be measured, say) are news."""
    return reduce(lambda a, b: a | b, (F.contains(line, F.lit(w)) for w in WARNINGS))


def every(places: Column, total: Column, most: int) -> Column:
    """Systematic sample: every k-th place, so that about ``most`` are left."""
    return places % F.greatest(F.floor(total / most), F.lit(1)) == 0


def first_and_last(catalog: DataFrame) -> DataFrame:
    """Seconds between the first and the last capture."""
    return catalog.agg((F.max("capture_s") - F.min("capture_s")).alias("seconds"))


def halves(catalog: DataFrame, least: int = 8) -> DataFrame:
    """Add half (0 or 1) of the model frames in time order; null if either would be too small."""
    n = catalog.agg(F.count(F.lit(1)).alias("__n"))
    from .ordering import numbered

    placed = numbered(catalog, ["frame_idx"], "__at").crossJoin(F.broadcast(n))
    return placed.withColumn("half", F.when(F.col("__n") >= 2 * least, (F.col("__at") >= F.floor(F.col("__n") / 2)).cast("int"))).drop("__at", "__n")


def ranked(df: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= most).drop("__r")
