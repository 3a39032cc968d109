"""Tables written in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex[:12]


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.

    Where that is unset, a temporary folder in local mode (one machine: every
    thread sees it), else a folder in the warehouse, which a cluster shares.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and sc._jsc.sc().getCheckpointDir().isDefined():
        found = sc._jsc.sc().getCheckpointDir().get()
    if not found:
        if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            found = tempfile.mkdtemp(prefix="frameloom-")
            atexit.register(shutil.rmtree, found, ignore_errors=True)
            found = f"file://{found}"
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
            if found.startswith("file:"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share: the warehouse is a local one")
        spark.conf.set("spark.checkpoint.dir", found)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def _clear() -> None:
    """Delete this process's tables when it ends, if its session still runs."""
    spark = SparkSession.getActiveSession()
    for folder in _FOLDERS:
        try:
            delete(spark, folder)
        except Exception:  # noqa: BLE001, S112  the session may be gone: then its cluster clears the folder
            continue


_FOLDERS: set[str] = set()
atexit.register(_clear)


def new_path(spark: SparkSession, tag: str) -> str:
    _FOLDERS.add(f"{shared_dir(spark)}/frameloom-{_RUN}")
    return f"{shared_dir(spark)}/frameloom-{_RUN}/{tag}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back; ends the lineage."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def released(df: DataFrame) -> None:
    """Delete a table made by written() that nothing will read again."""
    path = getattr(df, "_shared_path", None)
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
