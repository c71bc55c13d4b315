"""History of changing entity attributes, kept as checkpoints and deltas.

Storage has two tables. **Patches** hold, for every delivery that changed something, only the attributes that
changed; an entity's patches are numbered and cut into segments of ``every``. **Checkpoints** hold the full version of an entity
as each of its segments but the first begins, so there is one for every so many patches. Validity rows, or the state at a
moment, come from folding patches forward from the nearest checkpoint: a fold spans ``every`` patches at most.

No entity is ever sorted as a whole. Deliveries get their positions from range partitions; comparisons with the delivery
before run within blocks of ``block`` deliveries of an entity, and only one row per block goes through a window per entity.

Defined results: deliveries without an entity or a stamp are left out; of several deliveries of an entity with one
stamp that with the greatest ``order`` counts, ties there by the greatest state; text attributes compare without case and
surrounding blanks (``normalize``); NULL is a value of its own; a NULL deletion mark means not deleted; an empty input
gives empty tables; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .ranks import positions


@dataclass(frozen=True)
class EntityHistory:
    entity: str = "customer_id"
    stamp: str = "_fivetran_synced"
    order: str = "row_id"
    deleted: str | None = "_fivetran_deleted"
    attributes: tuple[str, ...] = ("tier",)
    normalize: bool = True
    every: int = 16
    block: int = 4096

    def _deliveries(self, df: DataFrame) -> DataFrame:
        """One row per entity and stamp: (e, at, gone, v)."""
        c = lambda n: F.col(f"`{n}`")
        norm = lambda n: F.lower(F.trim(c(n))) if self.normalize and dict(df.dtypes)[n] == "string" else c(n)
        gone = F.coalesce(c(self.deleted), F.lit(False)) if self.deleted else F.lit(False)
        rows = df.select(c(self.entity).alias("e"), F.unix_micros(c(self.stamp).cast("timestamp")).alias("at"), c(self.order).alias("o"), gone.alias("gone"), F.struct(*[norm(a).alias(a) for a in self.attributes]).alias("v"))
        one = rows.filter("e is not null and at is not null").groupBy("e", "at").agg(F.max(F.struct("o", "gone", "v")).alias("m"))
        return one.select("e", "at", F.col("m.gone").alias("gone"), F.when(~F.col("m.gone"), F.col("m.v")).alias("v"))

    def _state(self) -> Column:
        return F.struct("gone", "v")

    def build(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(checkpoints, patches), both written to the shared folder.

        checkpoints: e, seg, at, gone, v -- the full version before the segment's first patch, whose stamp is ``at``.
        patches: e, seg, at, gone, ch (per attribute whether it is set), v (attributes that changed, else NULL).
        """
        rows = positions(self._deliveries(df), ["e"], [F.col("at")])
        rows = rows.select("e", "at", "pos", F.floor(F.col("pos") / self.block).alias("blk"), self._state().alias("s"))
        # the last state of each block, carried to the next one of the entity: one row per entity and block
        ends = rows.groupBy("e", "blk").agg(F.max_by("s", "pos").alias("end"))
        carry = ends.select("e", "blk", F.lag("end").over(Window.partitionBy("e").orderBy("blk")).alias("carry"))
        inside = Window.partitionBy("e", "blk").orderBy("pos")
        rows = rows.join(carry, ["e", "blk"]).withColumn("before", F.when(F.pmod("pos", F.lit(self.block)) == 0, F.col("carry")).otherwise(F.lag("s").over(inside)))
        rows = rows.filter(~F.col("before").eqNullSafe(F.col("s"))).withColumn("i", F.row_number().over(inside) - 1).drop("carry", "pos")
        rows = materialize(rows, "deltas")
        counts = rows.groupBy("e", "blk").agg(F.count(F.lit(1)).alias("n"))
        so_far = F.coalesce(F.sum("n").over(Window.partitionBy("e").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = rows.join(counts.select("e", "blk", so_far.alias("off")), ["e", "blk"]).withColumn("n", F.col("off") + F.col("i"))
        rows = rows.withColumn("seg", F.floor(F.col("n") / self.every))
        checkpoints = rows.filter((F.col("n") > 0) & (F.pmod("n", F.lit(self.every)) == 0)).select("e", "seg", "at", "before.gone", "before.v")
        there = F.col("s.v").isNotNull()
        set_ = {a: F.col("before.v").isNull() | ~F.col(f"before.v.{a}").eqNullSafe(F.col(f"s.v.{a}")) for a in self.attributes}
        patches = rows.select(
            "e", "seg", "at", "s.gone", there.alias("there"),
            F.struct(*[(set_[a] & there).alias(a) for a in self.attributes]).alias("ch"),
            F.struct(*[F.when(set_[a], F.col(f"s.v.{a}")).alias(a) for a in self.attributes]).alias("v"),
        )
        return materialize(checkpoints, "checkpoints"), materialize(patches, "patches")

    def fold(self, checkpoints: DataFrame, patches: DataFrame) -> DataFrame:
        """The full version after every patch: patches folded forward from the segment's checkpoint."""
        start = checkpoints.select(
            "e", "seg", F.lit(None).cast("long").alias("at"), "gone", F.lit(True).alias("there"),
            F.struct(*[F.lit(True).alias(a) for a in self.attributes]).alias("ch"),
            F.struct(*[F.col(f"v.{a}").alias(a) for a in self.attributes]).alias("v"),
        )
        upto = Window.partitionBy("e", "seg").orderBy(F.col("at").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
        # a set value may be NULL itself, so it is wrapped before NULLs are passed over
        held = [F.last(F.when(F.col(f"ch.{a}"), F.struct(F.col(f"v.{a}").alias("x"))), ignorenulls=True).over(upto).getField("x").alias(a) for a in self.attributes]
        return start.unionByName(patches).select("e", "seg", "at", "gone", *held).filter("at is not null")

    def validity(self, checkpoints: DataFrame, patches: DataFrame) -> DataFrame:
        """One row per version: e, attributes, valid_from, valid_to (microseconds; NULL while it holds)."""
        rows = self.fold(checkpoints, patches)
        nxt = F.lead("at").over(Window.partitionBy("e", "seg").orderBy("at"))
        # a segment's last version ends where the next segment, if any, begins
        heads = checkpoints.select("e", (F.col("seg") - 1).alias("seg"), F.col("at").alias("after"))
        rows = rows.withColumn("next", nxt).join(heads, ["e", "seg"], "left")
        return rows.filter(~F.col("gone")).select("e", *self.attributes, F.col("at").alias("valid_from"), F.coalesce("next", "after").alias("valid_to"))

    def as_of(self, checkpoints: DataFrame, patches: DataFrame, moment: int) -> DataFrame:
        """State of every entity at a moment (microseconds): the last segment with a patch up to it, folded up to it.

        Segments before the nearest checkpoint are not read into the fold, which is an aggregation that combines before
        the shuffle: per attribute the last value that was set.
        """
        upto = patches.filter(F.col("at") <= moment)
        last = upto.groupBy("e").agg(F.max("seg").alias("seg"))
        start = checkpoints.select(
            "e", "seg", F.lit(-(2**62)).alias("at"), "gone", F.lit(True).alias("there"),
            F.struct(*[F.lit(True).alias(a) for a in self.attributes]).alias("ch"), F.struct(*[F.col(f"v.{a}").alias(a) for a in self.attributes]).alias("v"),
        )
        rows = start.unionByName(upto).join(last, ["e", "seg"])
        held = [F.max_by(F.struct(F.col(f"v.{a}").alias("x")), F.when(F.col(f"ch.{a}"), F.col("at"))).getField("x").alias(a) for a in self.attributes]
        return rows.groupBy("e").agg(F.max_by("gone", "at").alias("gone"), *held).filter(~F.col("gone")).select("e", *self.attributes)
