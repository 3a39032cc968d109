"""Pass 1 as files arrive: the per-frame measures need no other frame, so a stream of files can run them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import is_raw
from ..sources.frames import decode

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, a_time: int = 16) -> DataFrame:
    """A stream of camera files of a folder, a bounded number of them a trigger."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", a_time).load(folder)
    return files.where(is_raw(F.col("path"))).select("path", "content")


def measured(files: DataFrame) -> DataFrame:
    """Frame facts of a stream or a table of files; session-wide medians are for the batch pass that follows."""
    frames = decode(files)
    green = F.transform(F.sequence(F.lit(1), F.size("data") - 1, F.lit(3)), lambda k: F.get("data", k))
    ranked = F.sort_array(green)
    level = F.get(ranked, F.floor(F.size(ranked) / 2).cast("int"))
    return frames.where("error IS NULL").select("path", "w", "h", "camera", level.alias("level"))
