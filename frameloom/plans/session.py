"""Spark sessions, and getting this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the operators expect (time zone UTC, adaptive execution)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("frameloom")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions), "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g",
    }
    return builder.config(map=settings | conf).getOrCreate()


#: Rows of an Arrow batch where nothing else is set: rows are images, tiles or whole texts.
BATCH_ROWS = 2000


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors' Python once per application, so that workers import it wherever they start."""
    context = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # Spark's default
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if getattr(context, "_frameloom_shipped", False):
        return spark
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="frameloom-code-")
    path = os.path.join(folder, "frameloom_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(path)
    context._frameloom_shipped = True
    return spark
