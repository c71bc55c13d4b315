"""Irregular readings onto a regular grid, gaps filled by iterative singular-spectrum imputation.

Readings, each record once, are averaged (or counted) per source, series and slot, which combines before the shuffle, so a source
with a third of all rows becomes one row per slot. Slots are gathered in blocks of a fixed number of slots, and those near a
border in the neighbouring block as well; a block is the unit of work, so no task ever holds a whole long series. Of other blocks
it knows the last value before and the first after it (a window over one row per block). Within a block the missing entries
start from linear interpolation, the series is embedded as a Hankel trajectory, the leading singular vectors are kept, the
diagonals averaged and the missing entries replaced, until they no longer move; ``converged`` is false where ``rounds`` did not
suffice for that.

Defined results: equal rows of a record count once; readings without a source or a time are left out, as are those ``usable`` rejects; the grid of a series
runs from its first to its last slot with a value; a slot without a value is ``missing`` with its filled ``value``; a
silent stretch longer than a block lies on the line between its ends; a series with one slot has that slot; an empty input gives an
empty grid.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def epoch_seconds(c: Column) -> Column:
    """Whole seconds of an epoch time written in seconds, milli-, micro- or nanoseconds."""
    a = F.abs(c)
    n = F.when(a < 10**11, 1).when(a < 10**14, 10**3).when(a < 10**17, 10**6).otherwise(10**9)
    return ((c - F.pmod(c, n)) / n).cast("long")


def ssa_fill(x: np.ndarray, window: int = 24, rank: int = 4, rounds: int = 1000, tol: float = 1e-3, outside: tuple[tuple[int, float], ...] = ()) -> tuple[np.ndarray, int, bool]:
    """(filled series, rounds, whether they sufficed); 0 rounds: nothing missing, too short or constant.

    ``outside`` are (index, value) of the nearest values beyond either end, for the first guess.
    """
    gaps = np.isnan(x)
    if not gaps.any() or gaps.all() and not outside:
        return x, 0, True
    i = np.arange(len(x))
    at = np.r_[i[~gaps], [k for k, _ in outside]]
    order = np.argsort(at, kind="stable")
    y = np.interp(i, at[order], np.r_[x[~gaps], [v for _, v in outside]][order])
    n, L = len(x), min(window, len(x) // 2)
    if L < 2 or gaps.all() or np.ptp(x[~gaps]) == 0:
        return y, 0, True
    mean, scale = y.mean(), y.std() or 1.0
    z = (y - mean) / scale
    k = n - L + 1
    weight = np.minimum(np.minimum(i + 1, n - i), min(L, k)).astype(float)
    r = min(rank, L)
    for step in range(1, rounds + 1):
        h = np.lib.stride_tricks.sliding_window_view(z, L)  # k x L trajectories
        vec = np.linalg.eigh(h.T @ h)[1][:, -r:]
        low = (h @ vec) @ vec.T
        rec = np.zeros(n)
        for j in range(L):  # averages over the anti-diagonals
            rec[j : j + k] += low[:, j]
        rec /= weight
        moved = np.sqrt(np.mean((rec[gaps] - z[gaps]) ** 2))
        z[gaps] = rec[gaps]
        if moved < tol:
            return z * scale + mean, step, True
    return z * scale + mean, rounds, False


@dataclass(frozen=True)
class RegularGrid:
    slot_s: int = 300
    block_slots: int = 1024
    window: int = 24
    rank: int = 4
    rounds: int = 1000
    margin: int = 96

    def slots(self, df: DataFrame, source: str, series: str, seconds: Column, usable: Column | None = None, value: Column | None = None, record: str | None = None, count_of: str | None = None) -> DataFrame:
        """(source, series, slot, value) per slot with a value: mean of ``value``, or the number of distinct ``count_of``.

        Equal rows of one ``record`` (same time and value) are one reading; without ``record`` equal rows are.
        """
        s = F.col(f"`{source}`")
        rows = df.filter(s.isNotNull() & seconds.isNotNull())
        if usable is not None:
            rows = rows.filter(usable)
        slot = (seconds - F.pmod(seconds, F.lit(self.slot_s))).alias("slot")
        if count_of is None:
            each = rows.select(s.alias("source"), F.lit(series).alias("series"), slot, (F.col(f"`{record}`") if record else F.lit(0)).alias("r"), seconds.alias("t"), value.cast("double").alias("x")).distinct()
            return each.groupBy("source", "series", "slot").agg(F.avg("x").alias("value"))
        rows = rows.select(s.alias("source"), F.lit(series).alias("series"), slot, F.col(f"`{count_of}`").alias("x"))
        return rows.groupBy("source", "series", "slot").agg(F.countDistinct("x").cast("double").alias("value"))

    def blocks(self, slots: DataFrame) -> DataFrame:
        """One row per (source, series, block), silent ones too: the series' ends, the values in and near the block, and the
        nearest values of other blocks."""
        width, near = self.slot_s * self.block_slots, self.slot_s * self.margin
        block = ((F.col("slot") - F.pmod(F.col("slot"), F.lit(width))) / width).cast("long")
        into = F.pmod(F.col("slot"), F.lit(width))
        copies = F.array(F.lit(0), F.when(into < near, F.lit(-1)), F.when(into >= width - near, F.lit(1)))
        rows = slots.withColumn("d", F.explode(F.filter(copies, lambda c: c.isNotNull()))).withColumn("block", block + F.col("d"))
        own = F.when(F.col("d") == 0, F.struct("slot", "value"))
        by = rows.groupBy("source", "series", "block").agg(F.collect_list(F.struct("slot", "value")).alias("vals"), F.min(own).alias("head"), F.max(own).alias("tail"))
        ends = slots.groupBy("source", "series").agg(F.min("slot").alias("first"), F.max("slot").alias("last"))
        every = F.sequence(((F.col("first") - F.pmod(F.col("first"), F.lit(width))) / width).cast("long"), ((F.col("last") - F.pmod(F.col("last"), F.lit(width))) / width).cast("long"))
        by = ends.withColumn("block", F.explode(every)).join(by, ["source", "series", "block"], "left")
        run = Window.partitionBy("source", "series").orderBy("block")
        before = F.last("tail", ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, -1))
        after = F.first("head", ignorenulls=True).over(run.rowsBetween(1, Window.unboundedFollowing))
        # only single values go through the window, the arrays stay where they are
        ctx = by.select("source", "series", "block", before.alias("before"), after.alias("after"))
        return by.drop("head", "tail").join(ctx, ["source", "series", "block"])

    def fill(self, slots: DataFrame) -> DataFrame:
        """(source, series, slot, value, missing, rounds, converged): the whole grid."""
        width, step, win, rank, rounds, margin = self.slot_s * self.block_slots, self.slot_s, self.window, self.rank, self.rounds, self.margin

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for r in b.itertuples(index=False):
                    a, z = max(r.first, r.block * width), min(r.last, (r.block + 1) * width - step)
                    lo, hi = max(r.first, r.block * width - margin * step), min(r.last, (r.block + 1) * width + (margin - 1) * step)
                    x = np.full((hi - lo) // step + 1, np.nan)
                    for p in r.vals if r.vals is not None else ():
                        if lo <= p["slot"] <= hi and p["value"] is not None:
                            x[(p["slot"] - lo) // step] = p["value"]
                    own = slice((a - lo) // step, (z - lo) // step + 1)
                    gaps = np.isnan(x)
                    outside = tuple(((p["slot"] - lo) // step, p["value"]) for p in (r.before, r.after) if p is not None and not lo <= p["slot"] <= hi)
                    # without a gap of its own the block needs no filling
                    y, n, done = ssa_fill(x, win, rank, rounds, outside=outside) if gaps[own].any() else (x, 0, True)
                    m = len(gaps[own])
                    names = np.full(m, r.source, dtype=object), np.full(m, r.series, dtype=object)
                    yield pd.DataFrame({"source": names[0], "series": names[1], "slot": np.arange(a, z + 1, step), "value": y[own], "missing": gaps[own], "rounds": n, "converged": done})

        spread = self.blocks(slots).repartition("source", "series", "block")
        out = spread.mapInPandas(work, "source string, series string, slot long, value double, missing boolean, rounds int, converged boolean")
        return out.withColumn("value", F.when(~F.isnan("value"), F.col("value")))

    def grid(self, parts: list[DataFrame]) -> DataFrame:
        """Fills several sets of slots at once."""
        both = parts[0]
        for p in parts[1:]:
            both = both.unionByName(p)
        return self.fill(both)
