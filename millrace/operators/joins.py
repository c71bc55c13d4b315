"""Joins on ranges of time that shuffle on equal keys, so no side is broadcast or crossed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def range_join(left: DataFrame, right: DataFrame, t: str, u: str, low: int, high: int, keys: list[str]) -> DataFrame:
    """Pairs with equal keys and ``t + low <= u <= t + high`` (whole numbers).

    Both sides fall into buckets as wide as the range; a left row looks into the at most two buckets its range
    touches, so the join is on equal (keys, bucket) and a key with many rows is spread over its buckets.
    """
    width = max(1, high - low)
    l = left.withColumn("__b", F.explode(F.sequence(F.floor((F.col(t) + low) / F.lit(width)), F.floor((F.col(t) + high) / F.lit(width)))))  # noqa: E741
    r = right.withColumn("__b", F.floor(F.col(u) / F.lit(width)))
    return l.join(r, [*keys, "__b"]).filter((F.col(u) >= F.col(t) + low) & (F.col(u) <= F.col(t) + high)).drop("__b")


def asof_join(left: DataFrame, right: DataFrame, t: str, keys: list[str], take: list[str], span: int) -> DataFrame:
    """Left rows with the columns ``take`` of the last right row at or before them (NULL if there is none).

    Rows of both sides are merged in order within (keys, span of time); the last right row of every span is carried on
    to later spans through one row per span, so no task holds all of a key.
    """
    cols = left.columns
    both = left.withColumns({"__r": F.lit(None).cast("struct<" + ",".join(f"`{c}`:{ty}" for c, ty in right.dtypes if c in take) + ">"), "__side": F.lit(1)})
    r = right.select(*[F.col(c) if c in [*keys, t] else F.lit(None).cast(ty).alias(c) for c, ty in left.dtypes], F.struct(*[F.col(c) for c, _ in right.dtypes if c in take]).alias("__r"), F.lit(0).alias("__side"))
    rows = both.unionByName(r).withColumn("__s", F.floor(F.col(t) / F.lit(span)))
    inside = Window.partitionBy(*keys, "__s").orderBy(F.col(t), "__side").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__last", F.last("__r", ignorenulls=True).over(inside))
    ends = rows.groupBy(*keys, "__s").agg(F.max_by("__r", F.when(F.col("__r").isNotNull(), F.col(t))).alias("__end"))
    run = Window.partitionBy(*keys).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("__carry", F.last("__end", ignorenulls=True).over(run)).select(*keys, "__s", "__carry")
    out = rows.filter("__side = 1").join(ends, [*keys, "__s"], "left").withColumn("__hit", F.coalesce("__last", "__carry"))
    return out.select(*cols, *[F.col(f"__hit.{c}").alias(c) for c in take])
