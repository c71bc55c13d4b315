"""Processing only new or changed records: log-based change capture.

* The **offset** of a partition (the tenant) is a position in the log, ``order``, the order of arrival over the whole log. Stamps only
  decide which of several deliveries of a key is the newest. So a delivery that arrives late, whatever its stamp, is read once.
* A batch is **planned ahead**: where every partition begins and ends is written to the shared folder before anything is
  read. A run that finds a plan without a commit replays exactly that plan, whatever has arrived since.
* The **sink** is log-structured: a batch writes the newest delivery of each of its keys with its offset and what it meant
  (``new``, ``changed``, ``same``, or ``stale`` if the sink had a newer one). A batch counts once its **commit**, the offsets it has
  reached, is there; until then a replay overwrites it. Reading the sink keeps the newest row per key, so applying a batch
  twice changes nothing. :meth:`compact` folds batches into one.
* A pipeline that was driven by stamps before is **adopted**: its watermarks become floors, the newest deliveries up to them
  are the sink's first batch, and the first plan takes everything beyond the floors.

A later run reads only what lies beyond the least committed position (a filter that reaches the scan), and only its keys
are joined with the sink.

Defined results: deliveries without a stamp, a position, a key or a partition are not part of the log; of several deliveries with
one stamp that with the greatest position is the newest; NULL values equal each other; a partition without a
watermark begins at the beginning; an empty log gives an empty batch; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

_OFFSETS = "partition string, position long, floor long"
_PLAN = "partition string, position long, floor long, until long"


def committed_offsets(attempts: DataFrame, model: str, partition: str = "tenant") -> DataFrame:
    """(partition, floor): microseconds of the watermark of each partition's last successful attempt."""
    ok = attempts.filter((F.col("model_name") == model) & (F.lower(F.trim(F.col("status"))) == "success") & F.col(partition).isNotNull())
    last = ok.groupBy(F.col(partition).alias("partition")).agg(F.max(F.struct("started_at", "execution_id", "metadata_watermark")).alias("m"))
    return last.select("partition", F.unix_micros(F.col("m.metadata_watermark").cast("timestamp")).alias("floor"))


@dataclass(frozen=True)
class ChangeCapture:
    key: str = "order_id"
    partition: str = "tenant"
    stamp: str = "_fivetran_synced"
    order: str = "row_id"
    values: tuple[str, ...] = ("customer_id", "order_date", "status", "total_amount")

    def _log(self, log: DataFrame, beyond: int | None = None) -> DataFrame:
        c = lambda n: F.col(f"`{n}`")
        if beyond is not None:
            log = log.filter(c(self.order) > beyond)
        return log.select(
            c(self.key).alias("key"), c(self.partition).cast("string").alias("partition"), F.unix_micros(c(self.stamp).cast("timestamp")).alias("off"),
            c(self.order).alias("ord"), F.struct(*[c(v).alias(v) for v in self.values]).alias("v"),
        ).filter("key is not null and partition is not null and off is not null and ord is not null")

    @staticmethod
    def _newest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(F.max(F.struct("off", "ord", "partition", "v")).alias("n")).select("key", "n.*")

    # the folder: adopted, plan/N, batch/N, commit/N; a part counts when Spark's _SUCCESS is there
    @staticmethod
    def _done(spark: SparkSession, folder: str, kind: str) -> list[int]:
        """Numbers of the finished plans, batches or commits."""
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{kind}")
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{kind}/*/_SUCCESS")) or []
        return sorted(int(f.getPath().getParent().getName()) for f in found)

    def adopt(self, log: DataFrame, floors: DataFrame, folder: str) -> None:
        """Batch 0: the sink as the last successful runs of a stamp-driven pipeline left it. Does nothing if it is there."""
        spark = log.sparkSession
        if self._done(spark, folder, "commit"):
            return
        floors = floors.select(F.col("partition").cast("string").alias("partition"), F.lit(None).cast("long").alias("position"), "floor")
        floors.write.mode("overwrite").parquet(f"{folder}/adopted")
        floors = spark.read.schema(_OFFSETS).parquet(f"{folder}/adopted")
        old = self._log(log).join(floors, "partition").filter(F.col("off") <= F.col("floor"))
        self._newest(old).withColumn("state", F.lit("new")).write.mode("overwrite").parquet(f"{folder}/batch/0")
        floors.write.mode("overwrite").parquet(f"{folder}/commit/0")

    def offsets(self, spark: SparkSession, folder: str) -> DataFrame:
        done = self._done(spark, folder, "commit")
        return spark.read.schema(_OFFSETS).parquet(f"{folder}/commit/{done[-1]}") if done else spark.createDataFrame([], _OFFSETS)

    def plan(self, log: DataFrame, folder: str) -> int:
        """Writes the next batch's plan ahead of the work and returns its number; a plan without a commit is kept."""
        spark = log.sparkSession
        n = (self._done(spark, folder, "commit") or [0])[-1] + 1
        if n in self._done(spark, folder, "plan"):
            return n
        since = self.offsets(spark, folder)
        new = self._log(log, self._least(since)).groupBy("partition").agg(F.max("ord").alias("own"))
        ends = since.join(new, "partition", "full_outer")
        # arrival is one order over the log: what lies before its end has been seen for every partition
        top = new.agg(F.max("own")).first()[0]
        ends.select("partition", "position", "floor", F.coalesce(F.lit(top).cast("long"), F.col("position")).alias("until")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/plan/{n}")
        return n

    @staticmethod
    def _least(offsets: DataFrame) -> int | None:
        """The position before which every partition is done; None if one isn't positioned yet."""
        r = offsets.agg(F.min("position").alias("p"), F.count(F.when(F.col("position").isNull(), 1)).alias("open")).first()
        return None if r.open else r.p

    def delta(self, log: DataFrame, folder: str, n: int) -> DataFrame:
        """The deliveries of a planned batch."""
        plan = log.sparkSession.read.schema(_PLAN).parquet(f"{folder}/plan/{n}")
        rows = self._log(log, self._least(plan)).join(plan, "partition")
        beyond = (F.col("position").isNull() | (F.col("ord") > F.col("position"))) & (F.col("floor").isNull() | (F.col("off") > F.col("floor")))
        return rows.filter(beyond & (F.col("ord") <= F.col("until"))).select("key", "partition", "off", "ord", "v")

    def sink(self, spark: SparkSession, folder: str) -> DataFrame | None:
        """(key, off, ord, partition, v) of the newest delivery of every key; None before the first commit."""
        done = [f"{folder}/batch/{n}" for n in self._done(spark, folder, "batch") if n in self._done(spark, folder, "commit")]
        if not done:
            return None
        rows = spark.read.parquet(*done).filter("state <> 'stale'")
        return rows.drop("state") if len(done) == 1 else self._newest(rows)

    def process(self, log: DataFrame, folder: str, n: int) -> DataFrame:
        """Writes batch ``n`` as planned; a replay writes the same rows in its place."""
        spark = log.sparkSession
        new, sink = self._newest(self.delta(log, folder, n)), self.sink(spark, folder)
        if sink is None:
            batch = new.withColumn("state", F.lit("new"))
        else:
            had = sink.select("key", F.struct("off", "ord").alias("o"), F.col("v").alias("ov"))
            state = F.when(F.col("o").isNull(), "new").when(F.struct("off", "ord") <= F.col("o"), "stale").when(F.col("v").eqNullSafe(F.col("ov")), "same").otherwise("changed")
            batch = new.join(had, "key", "left").select("key", "off", "ord", "partition", "v", state.alias("state"))
        batch.write.mode("overwrite").parquet(f"{folder}/batch/{n}")
        return spark.read.schema(batch.schema).parquet(f"{folder}/batch/{n}")

    def commit(self, spark: SparkSession, folder: str, n: int) -> None:
        """Writes the offsets that batch ``n`` has reached: from here on it is part of the sink."""
        plan = spark.read.schema(_PLAN).parquet(f"{folder}/plan/{n}")
        done = plan.select("partition", F.col("until").alias("position"), F.when(F.col("until").isNull(), F.col("floor")).alias("floor"))
        done.write.mode("overwrite").parquet(f"{folder}/commit/{n}")

    def run(self, log: DataFrame, folder: str | None = None, floors: DataFrame | None = None) -> tuple[DataFrame, str]:
        """Plan, process, commit: (the batch's rows, the folder). Call again with the same folder after a failure or later."""
        folder = folder or shared_dir(log.sparkSession, "capture")
        if floors is not None:
            self.adopt(log, floors, folder)
        n = self.plan(log, folder)
        batch = self.process(log, folder, n)
        self.commit(log.sparkSession, folder, n)
        return batch, folder

    def compact(self, spark: SparkSession, folder: str) -> None:
        """Folds the sink into the next batch and commits it with unchanged offsets; older batches can then be left out.

        As every batch, it counts once its commit is there.
        """
        n = self._done(spark, folder, "commit")[-1] + 1
        self.sink(spark, folder).withColumn("state", F.lit("same")).write.mode("overwrite").parquet(f"{folder}/batch/{n}")
        self.offsets(spark, folder).write.mode("overwrite").parquet(f"{folder}/commit/{n}")
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for k in self._done(spark, folder, "batch"):
            if k < n:
                p = jvm.org.apache.hadoop.fs.Path(f"{folder}/batch/{k}")
                p.getFileSystem(conf).delete(p, True)

    @staticmethod
    def changes(batch: DataFrame) -> DataFrame:
        """The keys that are new or whose values changed."""
        return batch.filter(F.col("state").isin("new", "changed"))
