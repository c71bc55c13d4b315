"""Implausible readings per source: spikes, stuck values and physically impossible readings.

* **Physical bounds**: a reading below ``least`` is impossible.
* **Hampel filter**: on a log scale, a reading is an outlier if it is further from the rolling median of its source than ``k``
  scaled median absolute deviations; once more so among the window's active readings (not zero), for a source that is quiet half
  of the time has deviations as wide as its readings. Only outliers can be spikes.
* **Usual band**: an outlier is withheld if it is usual for its source after all: not more than ``factor`` times the highest and
  not less than 1 / ``factor`` of the lowest usual reading. Usual is what recurs: readings are
  counted in fine log bins per source, and a level counts if its neighbourhood holds ``share`` of the source's readings; so
  regular peaks, lasting levels and quiet executions stay.
* **Stuck values**: runs of ``run`` or more equal consecutive readings of a source whose other readings rarely repeat.

Readings are numbered per source by range partitions, so a hot source is cut by row count; blocks of a fixed number of consecutive
readings with a margin on either side are the unit of work, so windows are exact and no task holds a whole source. Per block only candidates, bin counts and run counts come back.

Defined results: an execution counts once however often it was delivered (least row decides); NULL readings are passed
over; rows without an id or source are left out; a missing time sorts first; an empty input gives no rows; sources with
fewer than ``run`` readings have neither spikes nor stuck values, only impossible readings; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ranks import positions

NEG, CAND, RUN = 1, 2, 4
OUT = "kind int, source string, reading string, id long, value double, flag int, bin int, n long, lo double, hi double"


def rolling_median(x: np.ndarray, half: int) -> np.ndarray:
    """Centred rolling median; windows shrink at the ends."""
    n = len(x)
    if n == 0:
        return x
    w = 2 * half + 1
    padded = np.concatenate([np.full(half, np.nan), x, np.full(half, np.nan)])
    out = np.empty(n)
    view = np.lib.stride_tricks.sliding_window_view(padded, w)
    if n > 2 * half:
        out[half : n - half] = np.partition(view[half : n - half], half, axis=1)[:, half]
        edge = np.r_[0:half, n - half : n]
    else:
        edge = np.arange(n)
    out[edge] = np.nanmedian(view[edge], axis=1)
    return out


def hampel(y: np.ndarray, half: int, k: float, floor: float) -> np.ndarray:
    """Which readings are outliers of their windows."""
    med = rolling_median(y, half)
    return np.abs(y - med) > np.maximum(k * 1.4826 * rolling_median(np.abs(y - med), half), floor)


def active_hampel(y: np.ndarray, half: int, k: float, floor: float, least: int = 5) -> np.ndarray:
    """The same among readings that aren't zero; windows with fewer than ``least`` of them have no outliers."""
    on = y > 0
    if on.all() or not on.any():
        return np.zeros(len(y), bool)

    def median(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        padded = np.concatenate([np.full(half, np.nan), np.where(on, x, np.nan), np.full(half, np.nan)])
        w = np.sort(np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1), axis=1)  # NaNs are last
        n = (~np.isnan(w)).sum(axis=1)
        i = np.arange(len(x))
        return (w[i, np.maximum(n - 1, 0) // 2] + w[i, n // 2]) / 2, n

    med, n = median(y)
    mad, _ = median(np.abs(y - med))
    return (n >= least) & (np.abs(y - med) > np.maximum(k * 1.4826 * mad, floor))


def run_lengths(x: np.ndarray) -> np.ndarray:
    """Length of the run of equal values each entry is in."""
    if len(x) == 0:
        return np.zeros(0, int)
    cut = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    size = np.diff(np.r_[cut, len(x)])
    return np.repeat(size, size)


def bins_of(x: np.ndarray, per_octave: int) -> np.ndarray:
    """Log bins of non-negative values; -1 is zero."""
    return np.where(x <= 0, -1, np.floor(np.log2(np.maximum(x, 1e-300)) * per_octave)).astype(np.int64)


def usual_band(bins: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray, share: float, edge: float, per_octave: int) -> tuple[float, float]:
    """Lowest and highest usual reading from one source's sorted bins; NaN where nothing recurs."""
    total = n.sum()
    keep = np.zeros(len(bins), bool)
    width = max(1, round(per_octave / 3))  # an edge is looked at over a third of an octave
    zero = bins == -1
    for i in range(len(bins)):
        if zero[i]:
            keep[i] = n[i] >= max(3, share * total)
            continue
        near = ~zero & (np.abs(bins - bins[i]) < width)
        wide = ~zero & (np.abs(bins - bins[i]) <= per_octave)
        keep[i] = n[near].sum() >= max(3, edge * total) and n[wide].sum() >= max(3, share * total)
    return (lo[keep].min(), hi[keep].max()) if keep.any() else (np.nan, np.nan)


@dataclass(frozen=True)
class Spikes:
    id: str = "execution_id"
    source: str = "model_name"
    time: str = "started_at"
    readings: tuple[str, ...] = ("duration_ms", "rows_copied")
    least: float = 0.0
    half_window: int = 12
    k: float = 3.0
    floor: float = 0.05  # on the log scale: what a constant source may vary by
    factor: float = 4.0
    share: float = 0.015
    edge: float = 0.003
    run: int = 6
    repeats: float = 0.1
    per_octave: int = 12
    block: int = 4096

    def _readings(self, df: DataFrame) -> DataFrame:
        """(source, reading, id, at, value), each execution once, readings without a value left out."""
        c = lambda n: F.col(f"`{n}`")
        rows = df.select(c(self.id).alias("id"), c(self.source).alias("source"), F.coalesce(F.unix_micros(c(self.time).cast("timestamp")), F.lit(-(2**62))).alias("at"), *[c(r).cast("double").alias(f"r{i}") for i, r in enumerate(self.readings)])
        rows = rows.filter("id is not null and source is not null")
        one = rows.groupBy("id").agg(F.min(F.struct("at", "source", *[f"r{i}" for i in range(len(self.readings))])).alias("m")).select("id", "m.*")
        each = F.explode(F.array(*[F.struct(F.lit(r).alias("reading"), F.col(f"r{i}").alias("value")) for i, r in enumerate(self.readings)])).alias("x")
        return one.select("id", "source", "at", each).select("id", "source", "at", "x.reading", "x.value").filter(F.col("value").isNotNull() & ~F.isnan("value"))

    def blocks(self, df: DataFrame) -> DataFrame:
        """The readings with position and block; those near a border are in the neighbouring block as well (own false)."""
        rows = positions(self._readings(df), ["source", "reading"], [F.col("at"), F.col("id")])
        margin, size = max(self.half_window, self.run), self.block
        b, at = F.floor(F.col("pos") / size), F.pmod(F.col("pos"), F.lit(size))
        near = F.array(F.lit(0), F.when((at < margin) & (b > 0), F.lit(-1)), F.when(at >= size - margin, F.lit(1)))
        rows = rows.withColumn("d", F.explode(F.filter(near, lambda x: x.isNotNull())))
        return rows.select("source", "reading", (b + F.col("d")).alias("block"), "pos", "id", "value", (F.col("d") == 0).alias("own"))

    def scan(self, df: DataFrame) -> DataFrame:
        """Candidates (kind 0), bin counts (kind 1) and run counts (kind 2) of every block, written to the shared folder."""
        half, k, floor, run, least, per_octave = self.half_window, self.k, self.floor, self.run, self.least, self.per_octave
        names = [x.split()[0] for x in OUT.split(", ")]

        def work(t: pa.Table) -> pa.Table:
            pos = t["pos"].to_numpy()
            order = np.argsort(pos, kind="stable")
            v, own, ids = t["value"].to_numpy()[order], t["own"].to_numpy(zero_copy_only=False)[order], t["id"].to_numpy()[order]
            fine = v >= least
            y = np.log1p(np.maximum(v, 0))
            cand = hampel(y, half, k, floor) | active_hampel(y, half, k, floor)
            long = run_lengths(v) >= run
            flag = NEG * ~fine + CAND * (cand & fine) + RUN * long
            hit = own & (flag > 0)
            b = bins_of(v[own & fine], per_octave)
            vals = v[own & fine]
            ub, inv, cnt = np.unique(b, return_inverse=True, return_counts=True)
            lo, hi = np.full(len(ub), np.inf), np.full(len(ub), -np.inf)
            np.minimum.at(lo, inv, vals)
            np.maximum.at(hi, inv, vals)
            same = np.r_[False, v[1:] == v[:-1]]
            rest = own & ~long
            h, m = int(hit.sum()), len(ub)
            src, rd = t["source"][0].as_py() if t.num_rows else "", t["reading"][0].as_py() if t.num_rows else ""
            tail = np.zeros(h + m, np.int64)
            cols = {
                "kind": np.r_[np.zeros(h), np.ones(m), 2].astype(np.int32),
                "source": [src] * (h + m + 1), "reading": [rd] * (h + m + 1),
                "id": np.r_[ids[hit], np.zeros(m + 1, np.int64)],
                "value": np.r_[v[hit], np.zeros(m + 1)],
                "flag": np.r_[flag[hit], np.zeros(m + 1, np.int64)].astype(np.int32),
                "bin": np.r_[np.zeros(h, np.int64), ub, 0].astype(np.int32),
                # kind 2: readings, in bin lo: outside of long runs, in hi: of those equal to the one before
                "n": np.r_[tail[:h], cnt, int(own.sum())].astype(np.int64),
                "lo": np.r_[np.zeros(h), lo, float(rest.sum())],
                "hi": np.r_[np.zeros(h), hi, float((rest & same).sum())],
            }
            return pa.table([pa.array(cols[n]) for n in names], names=names)

        return materialize(self.blocks(df).groupBy("source", "reading", "block").applyInArrow(work, OUT), "spikes")

    def bands(self, scan: DataFrame) -> DataFrame:
        """(source, reading, usual_lo, usual_hi, rarely_repeats): one row per source and reading."""
        share, edge, per_octave, run, repeats = self.share, self.edge, self.per_octave, self.run, self.repeats
        counts = scan.filter("kind > 0").groupBy("source", "reading", "kind", "bin").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("lo").alias("slo"), F.sum("hi").alias("shi"))
        per = counts.groupBy("source", "reading").agg(F.collect_list(F.struct("kind", "bin", "n", "lo", "hi", "slo", "shi")).alias("b"))

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for d in batches:
                out = []
                for r in d.itertuples(index=False):
                    bs = sorted((x["bin"], x["n"], x["lo"], x["hi"]) for x in r.b if x["kind"] == 1)
                    runs = [x for x in r.b if x["kind"] == 2][0]
                    lo = hi = float("nan")
                    if bs:
                        lo, hi = usual_band(*[np.array(z) for z in zip(*bs)], share, edge, per_octave)
                    n, rest, same = runs["n"], runs["slo"], runs["shi"]
                    out.append((r.source, r.reading, lo, hi, bool(n >= run and rest >= 0.5 * n and same <= repeats * rest)))
                yield pd.DataFrame(out, columns=["source", "reading", "usual_lo", "usual_hi", "rarely_repeats"], dtype=object)

        return per.mapInPandas(work, "source string, reading string, usual_lo double, usual_hi double, rarely_repeats boolean")

    def flags(self, df: DataFrame) -> DataFrame:
        """(id, reading, value, source, reason) of every implausible reading; reason: impossible, spike, stuck."""
        scan = self.scan(df)
        c = scan.filter("kind = 0").select("source", "reading", "id", "value", "flag").join(self.bands(scan), ["source", "reading"])
        spike = F.col("flag").bitwiseAND(CAND).cast("boolean") & ~F.isnan("usual_hi") & ((F.col("value") > F.col("usual_hi") * self.factor) | (F.col("value") < F.col("usual_lo") / self.factor))
        reason = F.when(F.col("flag").bitwiseAND(NEG).cast("boolean"), "impossible").when(spike, "spike").when(F.col("flag").bitwiseAND(RUN).cast("boolean") & F.col("rarely_repeats"), "stuck")
        return c.select("id", "reading", "value", "source", reason.alias("reason")).filter("reason is not null")
