"""Global positions and neighbours in time, without one task seeing all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Sampled keys of a range, about: how even ranges are.
SAMPLED = 20


def ranges(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add the range (from 0) that a row belongs to: ranges follow the order and hold like numbers of rows.

    There is a range for each shuffle partition, fewer where the sample has fewer different keys.  The
    bounds are fixed before the plan, so every use of it deals a row alike; a row finds its range by
    halving the bounds.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n, most = df.count(), SAMPLED * width
    keys = df.select(*order).dropna()
    found = sorted({tuple(r) for r in keys.sample(False, min(1.0, most / max(n, 1)), 17).limit(2 * most).collect()})
    cuts = sorted({found[len(found) * k // width] for k in range(1, width)}) if found else []
    if not cuts:
        return df.withColumn(name, F.lit(0))
    key = F.struct(*(F.col(c) for c in order))
    bounds = F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(cut, order, strict=True))) for cut in cuts))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))))
    # the number of bounds that are not past the key
    at = F.aggregate(steps, F.lit(0), lambda lo, step: F.when((lo + step <= len(cuts)) & (F.get(bounds, lo + step - 1) <= key), lo + step).otherwise(lo))
    return df.withColumn(name, at)


def numbered(df: DataFrame, order: list[str], name: str, by: list[str] | None = None) -> DataFrame:
    """Position (from 0) of each row in the order.

    Rows are dealt to ranges of the order; each range numbers its own rows and starts after the sizes
    of those before it, of which there is one number per range.  Rows that tie in the order must be
    equal in all that matters.
    """
    if by:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    ranged = ranges(df, order, "__part")
    local = ranged.withColumn("__within", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # a row per range
    return local.join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + F.col("__within") - 1)).drop("__part", "__within", "__before")


def spread(df: DataFrame, at: str, reach: int, block: int = 4096) -> DataFrame:
    """Copies of rows to every block of ``block`` positions whose windows of ``reach`` can meet them.

    Adds __block and __own (the row belongs to the block).  A window over
    __block, ordered by position, then sees every neighbour within reach, and
    blocks are independent tasks; rows with __own are the result.
    """
    first, last = F.floor((F.col(at) - reach) / block), F.floor((F.col(at) + reach) / block)
    out = df.withColumn("__block", F.explode(F.sequence(first, last)))
    return out.withColumn("__own", F.floor(F.col(at) / block) == F.col("__block"))


def owned(df: DataFrame) -> DataFrame:
    return df.where("__own").drop("__own", "__block")
