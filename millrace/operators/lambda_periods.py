"""Per-period aggregates by event time, corrected as late records arrive (lambda views).

* The **fast layer** increments provisional periods with whatever arrived since the last scheduled batch. It
  neither removes repeated deliveries nor looks at the log again, so it is cheap and may be off.
* The **batch layer** recomputes every open period from the full log and replaces its row. Its records say whether the fast layer
  had them: those it had not are the corrections.
* A period is **frozen** by the first batch at or after its end + cut-off + delivery allowance. Frozen rows are
  carried over and never computed again; the log's rows of frozen periods are dropped before anything is shuffled.

Lateness is that of the event (``started_at`` against the end of its period): up to ``provisional_h`` hours is on
time, up to ``cutoff_h`` hours is a late record that the batch layer adds, beyond that the record is closed out. The
delivery allowance covers the way of the record to the log (``recorded_at``); what arrives even later than the
freezing batch is listed by :meth:`LambdaPeriods.ledger` with ``frozen_out`` true and changes nothing.

Defined results: a record without an event time, a key or any part of a period is ``unresolved`` and belongs to no
period; a period with only a start is unresolved as well, for its length is unknown; repeated deliveries of an
execution count once, and the earliest arrival with the least payload decides; NULL readings add nothing; an empty log
gives empty views; other columns of the log, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

HOUR = 3600


def period_bounds(key: Column, start: Column, end: Column) -> Column:
    """struct(start, end) of a period in epoch seconds from a key written in any way, else from its bounds.

    A key counts by its digits: 4 a year, 6 a month, 8 a day, 10 and more an hour. A key that is no such date is as good
    as NULL. Without a key the end counts as given; the start is then only a hint within the period.
    """
    d = F.regexp_replace(key, "[^0-9]", "")
    grain = F.when(F.length(d) >= 10, "hour").when(F.length(d) == 8, "day").when(F.length(d) == 6, "month").when(F.length(d) == 4, "year")
    ymd = F.concat_ws("-", F.substring(d, 1, 4), F.when(F.length(d) >= 6, F.substring(d, 5, 2)).otherwise("01"), F.when(F.length(d) >= 8, F.substring(d, 7, 2)).otherwise("01"))
    day = F.when(grain.isNotNull(), F.try_to_timestamp(ymd, F.lit("yyyy-MM-dd")))
    hour = F.when(grain == "hour", F.substring(d, 9, 2).cast("int")).otherwise(0)
    begin = F.when(hour < 24, F.unix_timestamp(day) + hour * HOUR)
    after = (
        F.when(grain == "hour", begin + HOUR)
        .when(grain == "day", begin + 24 * HOUR)
        .when(grain == "month", F.unix_timestamp(F.add_months(day, 1).cast("timestamp")))
        .when(grain == "year", F.unix_timestamp(F.add_months(day, 12).cast("timestamp")))
    )
    return F.struct(
        F.coalesce(begin, F.when(end.isNotNull(), F.unix_timestamp(start.cast("timestamp")))).alias("start"),
        F.coalesce(after, F.unix_timestamp(end.cast("timestamp"))).alias("end"),
    )


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


@dataclass(frozen=True)
class LambdaPeriods:
    """Column names and limits; ``status`` is the spelling (without case and blanks) of records that count."""

    id: str = "execution_id"
    key: str = "model_name"
    event_time: str = "started_at"
    arrival: str = "recorded_at"
    value: str = "rows_copied"
    status_column: str = "status"
    status: str = "success"
    period_key: str = "partition_key"
    period_start: str = "partition_start"
    period_end: str = "partition_end"
    provisional_h: int = 2
    cutoff_h: int = 72
    delivery_h: int = 144

    def _resolved(self, log: DataFrame) -> DataFrame:
        """The counted rows of the log with the period of each; no shuffle."""
        c = lambda n: F.col(f"`{n}`")
        rows = log.filter(F.lower(F.trim(c(self.status_column))) == self.status)
        p = period_bounds(c(self.period_key), c(self.period_start), c(self.period_end))
        return rows.select(
            c(self.id).alias("id"), c(self.key).alias("key"), micros(c(self.event_time)).alias("at"),
            micros(c(self.arrival)).alias("arrived"), c(self.value).cast("long").alias("value"), p.alias("p"),
        ).filter(F.col("id").isNotNull())

    def ledger(self, log: DataFrame, batch_every_h: int = 24) -> DataFrame:
        """One row per execution: its period and the layer that adds it.

        Columns ``id, key, period_start, period_end`` (epoch seconds), ``value, arrived``, ``layer`` in
        ``fast | batch | closed | unresolved`` and ``frozen_out``. One shuffle, on the id.
        """
        one = self._resolved(log).groupBy("id").agg(F.min(F.struct(F.col("arrived").isNull(), "arrived", "at", "key", "value", "p")).alias("r")).select("id", "r.*")
        late = F.col("at") - F.col("p.end") * F.lit(1_000_000)
        layer = (
            F.when(F.col("p.end").isNull() | F.col("at").isNull() | F.col("key").isNull(), "unresolved")
            .when(late <= self.provisional_h * HOUR * 1_000_000, "fast")
            .when(late <= self.cutoff_h * HOUR * 1_000_000, "batch")
            .otherwise("closed")
        )
        return one.select(
            "id", "key", F.col("p.start").alias("period_start"), F.col("p.end").alias("period_end"), "value", "arrived",
            layer.alias("layer"), F.coalesce(F.col("arrived") > self.freeze_at(F.col("p.end"), batch_every_h) * F.lit(1_000_000), F.lit(False)).alias("frozen_out"),
        )

    def freeze_at(self, end: Column, batch_every_h: int) -> Column:
        """Epoch second of the scheduled batch that freezes a period."""
        step = batch_every_h * HOUR
        return (F.ceil((end + (self.cutoff_h + self.delivery_h) * HOUR) / F.lit(step)) * step).cast("long")

    def members(self, log: DataFrame, as_of: int, last: int | None = None, batch_every_h: int = 24) -> DataFrame:
        """The batch layer's records: (id, key, period_start, period_end, value, arrived, fast), one per execution.

        Of what had arrived by ``as_of``, executions of periods that the batch at ``last`` had not frozen, up to the cut-off and
        arrived before their period freezes. ``fast`` tells whether the fast layer had counted one of its deliveries.
        """
        us = F.lit(1_000_000)
        rows = self._resolved(log).filter((F.col("arrived") <= as_of * 1_000_000) & F.col("key").isNotNull() & (F.col("at") - F.col("p.end") * us <= self.cutoff_h * HOUR * 1_000_000))
        if last is not None:
            rows = rows.filter(self.freeze_at(F.col("p.end"), batch_every_h) > last)
        r = F.struct("arrived", "at", "key", "value", "p")
        one = rows.groupBy("id").agg(F.min(r).alias("r"), F.max(F.col("at") - F.col("p.end") * us <= self.provisional_h * HOUR * 1_000_000).alias("fast")).select("id", "r.*", "fast")
        one = one.filter(F.col("arrived") <= self.freeze_at(F.col("p.end"), batch_every_h) * us)
        return one.select("id", "key", F.col("p.start").alias("period_start"), F.col("p.end").alias("period_end"), "value", "arrived", "fast")

    def frozen_by(self, t: int, batch_every_h: int = 24) -> Column:
        return self.freeze_at(F.col("period_end"), batch_every_h) <= t

    @staticmethod
    def corrections(members: DataFrame) -> DataFrame:
        """The records that the batch layer adds to periods the fast layer had shown without them."""
        return members.filter("not fast")

    def fast(self, log: DataFrame, since: int, until: int) -> DataFrame:
        """Increments of provisional periods from the arrivals in (since, until], in epoch seconds."""
        new = self._resolved(log).filter((F.col("arrived") > since * 1_000_000) & (F.col("arrived") <= until * 1_000_000))
        return self._by_period(new.filter((F.col("at") - F.col("p.end") * F.lit(1_000_000)) <= self.provisional_h * HOUR * 1_000_000).select("key", F.col("p.start").alias("period_start"), F.col("p.end").alias("period_end"), "value", F.lit("fast").alias("layer")))

    def _by_period(self, rows: DataFrame) -> DataFrame:
        # the first moment of a period isn't always known: the end names it
        return rows.filter(F.col("key").isNotNull()).groupBy("key", "period_end").agg(
            F.min("period_start").alias("period_start"), F.count(F.lit(1)).alias("executions"), F.coalesce(F.sum("value"), F.lit(0)).cast("long").alias("rows_copied"),
            F.count(F.when(F.col("layer") == "batch", 1)).alias("late_executions"),
        )

    def batch(self, log: DataFrame, view: DataFrame | None, as_of: int, last: int | None = None, batch_every_h: int = 24) -> DataFrame:
        """The view after the scheduled batch at ``as_of`` (epoch seconds).

        Periods that an earlier batch (the one at ``last``) has frozen are taken from ``view`` as they are; every
        other period is computed from all of the log that had arrived.
        """
        return self._replace(self.members(log, as_of, last, batch_every_h), view, as_of, batch_every_h)

    def _replace(self, members: DataFrame, view: DataFrame | None, as_of: int, batch_every_h: int) -> DataFrame:
        rows = members.withColumn("layer", F.when(F.col("fast"), "fast").otherwise("batch"))
        fresh = self._by_period(rows).withColumn("frozen", self.frozen_by(as_of, batch_every_h))
        return fresh if view is None else view.filter("frozen").unionByName(fresh)

    def serve(self, view: DataFrame, fast: DataFrame) -> DataFrame:
        """What a reader sees between two batches: batch view plus the fast layer's increments."""
        inc = fast.withColumn("frozen", F.lit(False)).withColumn("provisional", F.lit(True))
        return (
            view.withColumn("provisional", F.lit(False)).unionByName(inc)
            .groupBy("key", "period_end")
            .agg(F.min("period_start").alias("period_start"), F.max("frozen").alias("frozen"), F.max("provisional").alias("provisional"),
                 *[F.sum(c).alias(c) for c in ("executions", "rows_copied", "late_executions")])
        )

    def schedule(self, log: DataFrame, every_days: int = 14) -> list[int]:
        """Batches in a fixed rhythm from the log's first arrival until after its last."""
        r = log.agg(F.min(self.arrival).alias("a"), F.max(self.arrival).alias("z")).select(F.unix_seconds(F.col("a").cast("timestamp")).alias("a"), F.unix_seconds(F.col("z").cast("timestamp")).alias("z")).first()
        if r.a is None:
            return []
        step, day = every_days * 24 * HOUR, r.a - r.a % (24 * HOUR)
        return list(range(day + step, r.z + 1 + step, step))

    def run(self, log: DataFrame, batches: list[int], batch_every_h: int = 24) -> tuple[DataFrame, DataFrame]:
        """All scheduled batches in turn: (the view, the records behind it).

        Every batch's records and view are written to the shared folder before the next; records of frozen periods stay as
        they were when their period froze.
        """
        view, last, settled = None, None, []
        for t in batches:
            members = materialize(self.members(log, t, last, batch_every_h), "members")
            view = materialize(self._replace(members, view, t, batch_every_h), "periods")
            if settled:
                settled[-1] = settled[-1].filter(self.frozen_by(last, batch_every_h))
            settled.append(members)
            last = t
        if view is None:
            settled.append(self.members(log, 0))
            view = self._replace(settled[0], None, 0, batch_every_h)
        out = settled[0]
        for m in settled[1:]:
            out = out.unionByName(m)
        return view, out
