"""Dense numbers of values, without the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import stored


def dense_ids(df: DataFrame, column: str, name: str = "id") -> DataFrame:
    """(name, column): 0, 1, 2, ... for the distinct values of a column, in their order.

    Values are sorted into ranges; each range numbers its own, and counts before it are summed over
    one row a range.
    """
    ordered = df.select(column).distinct().orderBy(column).withColumn("at", F.monotonically_increasing_id())
    ordered = stored(ordered.withColumn("range", F.shiftright("at", 33)), "ordered")
    sizes = ordered.groupBy("range").agg(F.min("at").alias("low"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("range", (before - F.col("low")).alias("shift"))  # a row for each shuffle partition
    return ordered.join(F.broadcast(sizes), "range").select((F.col("at") + F.col("shift")).alias(name), column)
