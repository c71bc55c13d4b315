"""Exact positions within groups of any size without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def positions(df: DataFrame, keys: list[str], order: list[Column], name: str = "pos", parts: int | None = None) -> DataFrame:
    """Adds the 0-based position of each row within its ``keys`` group in the given order.

    Rows are range-partitioned by keys and order, so that every partition has about as many rows and a hot group is cut by
    row count; they are numbered where they lie, written once, and the offsets come from the counts per group and partition,
    of which only one row each goes through a window. Keys must not be NULL; the order must be total for the positions to be
    the same on every run.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(k) for k in keys], *order]
    rows = materialize(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("__i", F.monotonically_increasing_id()), "sorted")
    rows = rows.withColumn("__p", F.shiftright("__i", 33))
    ends = rows.groupBy(*keys, "__p").agg(F.count(F.lit(1)).alias("__n"), F.min("__i").alias("__first"))
    run = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "__p", (F.coalesce(F.sum("__n").over(run), F.lit(0)) - F.col("__first")).alias("__off"))
    out = rows.join(ends, [*keys, "__p"])
    return out.withColumn(name, (F.col("__i") + F.col("__off")).cast("long")).drop("__p", "__i", "__off")
