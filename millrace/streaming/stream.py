"""Streams: micro-batches that end when all input is read, event-time windows, and provisional period counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


def microbatch(spark: SparkSession, path: str, schema, transform: Callable[[DataFrame], DataFrame], out: str | None = None, checkpoint: str | None = None, glob: str | None = None) -> DataFrame:
    """Reads new files as a stream until there are no more (availableNow) and appends the result.

    Called again with the same ``out`` and ``checkpoint`` it takes only files that came since.
    """
    out = out or shared_dir(spark, "stream")
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = transform(r.parquet(path))
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint or out + "-checkpoint").trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def tumbling(df: DataFrame, ts: str, length: str, keys: list[str], aggs: list[Column], late: str | None = None) -> DataFrame:
    """Aggregates per window; on a stream ``late`` is how long late rows are waited for."""
    return sliding(df, ts, length, None, keys, aggs, late)


def sliding(df: DataFrame, ts: str, length: str, slide: str | None, keys: list[str], aggs: list[Column], late: str | None = None) -> DataFrame:
    if late and df.isStreaming:
        df = df.withWatermark(ts, late)
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    g = df.groupBy(w.alias("w"), *keys).agg(*aggs)
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in g.columns if c != "w"])


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], aggs: list[Column], late: str | None = None) -> DataFrame:
    if late and df.isStreaming:
        df = df.withWatermark(ts, late)
    g = df.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(*aggs)
    return g.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *[c for c in g.columns if c != "w"])


def period_increments(spark: SparkSession, path: str, schema, periods, out: str, checkpoint: str, glob: str | None = None) -> DataFrame:
    """The fast layer of lambda views as a stream: increments of provisional periods from each micro-batch of arrivals.

    A micro-batch writes its increments to a folder of its own number, so one that is repeated after a failure
    replaces what it had written. ``periods`` is a :class:`~millrace.operators.lambda_periods.LambdaPeriods`.
    """

    def write(batch: DataFrame, number: int) -> None:
        periods.fast(batch, -(2**40), 2**40).write.mode("overwrite").parquet(f"{out}/batch={number}")

    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    q = r.parquet(path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    inc = spark.read.parquet(out)
    return inc.groupBy("key", "period_end").agg(F.min("period_start").alias("period_start"), *[F.sum(c).alias(c) for c in ("executions", "rows_copied", "late_executions")])
