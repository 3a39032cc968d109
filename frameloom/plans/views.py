"""Views over the provided tables that have the shape of a session's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame_idx, gx, gy, v): pixels in a 4 x 3 grid of cells over 30 days."""
    events = table(spark, sf_dir, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return events.select(
        F.floor((seconds - 1704067200) / 86400).cast("int").alias("frame_idx"),
        (F.col("user_id") % 4).cast("int").alias("gx"),
        F.floor((F.col("user_id") % 12) / 4).cast("int").alias("gy"),
        F.col("value").alias("v"),
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame_idx, session, h, w, data): 8 x 8 images of one channel, as arrays."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("frame_idx"), F.col("label").alias("session"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.col("embedding").cast("array<double>").alias("data"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame_idx, session, y, x, v): the same images, a row per pixel."""
    return images(spark, sf_dir).select("frame_idx", "session", F.posexplode("data").alias("pos", "v")).select("frame_idx", "session", F.floor(F.col("pos") / 8).cast("int").alias("y"), (F.col("pos") % 8).cast("int").alias("x"), "v")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame_idx, star_id, x, y, flux): star lists."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return items.select(F.col("l_orderkey").alias("frame_idx"), (F.row_number().over(order) - 1).alias("star_id"), (F.col("l_partkey") * 1.0).cast("double").alias("x"), (F.col("l_suppkey") * 10.0).cast("double").alias("y"), F.col("l_extendedprice").alias("flux"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame_idx, level, fg, cloud, aligned, angle, tx, ty): a frame catalog in time order."""
    from ..operators.ordering import numbered

    orders = numbered(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], "frame_idx")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return orders.select(
        "frame_idx",
        (F.col("o_totalprice") / 500000.0).alias("level"),
        ((cust % 10) / 10.0).alias("fg"),
        ((key % 100) / 100.0).alias("cloud"),
        (key % 5 != 0).alias("aligned"),
        ((cust % 7 - 3) * F.lit(0.001)).cast("double").alias("angle"),
        ((cust % 11) * F.lit(0.5)).cast("double").alias("tx"),
        ((cust % 13) * F.lit(0.25)).cast("double").alias("ty"),
    )


#: The same views for DuckDB, as the head of a query.
SQL = {
    "samples": """samples AS (
  SELECT CAST(floor((epoch(ts) - 1704067200) / 86400) AS INT) AS frame_idx, CAST(user_id % 4 AS INT) AS gx,
    CAST(floor((user_id % 12) / 4) AS INT) AS gy, value AS v FROM events)""",
    "pixels": """pixels AS (
  SELECT vec_id AS frame_idx, label AS session, CAST(floor(p / 8) AS INT) AS y, CAST(p % 8 AS INT) AS x,
    CAST(embedding[p + 1] AS DOUBLE) AS v FROM embeddings, range(64) r(p))""",
    "points": """points AS (
  SELECT l_orderkey AS frame_idx,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS star_id,
    CAST(l_partkey * 1.0 AS DOUBLE) AS x, CAST(l_suppkey * 10.0 AS DOUBLE) AS y, l_extendedprice AS flux FROM lineitem)""",
    "catalog": """catalog AS (
  SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS frame_idx, o_totalprice / 500000.0 AS level,
    (o_custkey % 10) / 10.0 AS fg, (o_orderkey % 100) / 100.0 AS cloud, o_orderkey % 5 <> 0 AS aligned,
    CAST((o_custkey % 7 - 3) * 0.001 AS DOUBLE) AS angle, CAST((o_custkey % 11) * 0.5 AS DOUBLE) AS tx,
    CAST((o_custkey % 13) * 0.25 AS DOUBLE) AS ty FROM orders)""",
}


def with_views(names: str, sql: str) -> str:
    """A DuckDB query with the named views before it."""
    return "WITH " + ",\n".join(SQL[n] for n in names.split()) + (",\n" if sql.lstrip()[:7] != "SELECT " else "\n") + sql.strip()
