"""Percentiles of very large numeric columns from deterministic, mergeable rank summaries.

A summary is a sorted list of rank-interval tuples (v, rmin, rmax): the value v of the column has a rank between rmin
and rmax among the n values. Summaries are built per (group, day, shard) from exact ranks, compressed by the permitted
uncertainty, merged per (group, day) and then per group. Merging keeps intervals valid, compression widens the distance
between neighbours; the bound on the rank error of any answer is read from the tuples themselves (half the widest
distance), so what accumulates over merges is known and stated, not assumed.

Hot groups are spread over ``shards`` by a hash of the record, so no task holds a group, and a merge holds at most 16
summaries a level of at most 1 / (2 eps) + 2 tuples each. A shard is sorted by value and read in chunks of a fixed number of values:
equal records give equal summaries, in whatever order they arrive and however Arrow cuts its batches.

Defined results: NULL and negative values are left out (``least``), as are NULL groups and ids; a record delivered
several times counts once (its least row); a NULL time is a day of its own; ties have an interval of ranks each and
any of them answers; an empty input has no groups; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Summary = tuple[np.ndarray, np.ndarray, np.ndarray, int]
SCHEMA = "grp string, day date, n long, v array<double>, rmin array<long>, rmax array<long>"
ARROW = pa.schema([("grp", pa.string()), ("day", pa.date32()), ("n", pa.int64()), ("v", pa.list_(pa.float64())), ("rmin", pa.list_(pa.int64())), ("rmax", pa.list_(pa.int64()))])


def compress(s: Summary, eps: float) -> Summary:
    """Drops tuples so that the distance of neighbours grows by at most 2 eps n ranks.

    Every tuple kept lies more than 2 eps n ranks beyond the one before, so at most 1 / (2 eps) + 2 stay, and the rank
    error grows by at most eps n: levels of merging add up, and :func:`bound` reads the sum from the tuples.
    """
    v, lo, hi, n = s
    if len(v) <= 2 or int(2 * eps * n) < 2:
        return s
    room = int((hi[1:] - lo[:-1]).max()) + int(2 * eps * n)
    keep, last, i = [0], 0, 1
    while i < len(v):
        # the furthest tuple that is still within reach of the last one kept
        j = int(np.searchsorted(hi, lo[last] + room, "right")) - 1
        j = min(max(j, i), len(v) - 1)
        keep.append(j)
        last, i = j, j + 1
    k = np.array(keep)
    return v[k], lo[k], hi[k], n


class Tree:
    """Summaries of one group, merged level by level: a level's ``fan_in`` summaries make one of the next.

    What is held grows with the logarithm of what came in, and so does the rank error.
    """

    def __init__(self, eps: float, fan_in: int = 16):
        self.eps, self.fan_in, self.levels = eps, fan_in, [[]]

    def add(self, s: Summary, level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(s)
        if len(self.levels[level]) == self.fan_in:
            whole, self.levels[level] = merge(self.levels[level], self.eps), []
            self.add(whole, level + 1)

    def result(self) -> Summary:
        parts = [s for level in self.levels for s in level]
        return parts[0] if len(parts) == 1 else merge(parts, self.eps)


def build(x: np.ndarray, eps: float) -> Summary:
    """Summary of sorted values: exact ranks, then compressed."""
    n, step = len(x), int(2 * eps * len(x))
    r = np.arange(1, n + 1) if step < 2 else np.unique(np.r_[1 : n + 1 : step, n])
    return x[r - 1], r, r, n


def merge(parts: list[Summary], eps: float) -> Summary:
    """Merges summaries; of equal values the earlier part's come first."""
    parts = [p for p in parts if p[3]]
    if len(parts) == 1:
        return parts[0]
    v = np.concatenate([p[0] for p in parts])
    own = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    lo, hi = np.concatenate([p[1] for p in parts]).astype(np.int64), np.concatenate([p[2] for p in parts]).astype(np.int64)
    for k, (pv, plo, phi, pn) in enumerate(parts):
        before, after = own < k, own > k
        # tuples of earlier parts precede equal values of this one, those of later parts follow them
        at = np.where(before, np.searchsorted(pv, v, "left"), np.searchsorted(pv, v, "right"))
        other = before | after
        lo += np.where(other & (at > 0), plo[np.maximum(at - 1, 0)], 0)
        hi += np.where(other, np.where(at < len(pv), phi[np.minimum(at, len(pv) - 1)] - 1, pn), 0)
    order = np.lexsort((own, v))
    return compress((v[order], lo[order], hi[order], sum(p[3] for p in parts)), eps)


def bound(s: Summary) -> int:
    """Ranks by which any answer of the summary may be off."""
    _, lo, hi, n = s
    if not n:
        return 0
    gap = (hi[1:] - lo[:-1]).max() if len(lo) > 1 else 0
    return int(max(np.ceil(gap / 2), hi[0] - 1, n - lo[-1]))


def quantile(s: Summary, q: float) -> tuple[float, int]:
    """(value, rank error of this answer): the tuple nearest to rank ceil(q n)."""
    v, lo, hi, n = s
    r = max(1, int(np.ceil(round(q * n, 9))))
    off = np.maximum(hi - r, r - lo)
    i = int(off.argmin())
    return float(v[i]), int(max(off[i], 0))


def _lists(rows: list[tuple], arrow: pa.Schema = ARROW) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in arrow]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)


def _build_stream(eps: float, chunk: int = 8192) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Summaries of (group, day, shard) from rows sorted by value within them, built of every ``chunk`` values in turn.

    The chunks follow the order of values, not Arrow's batches, so the result depends on the values alone.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree, rest = None, Tree(eps), np.zeros(0)

        def done() -> tuple:
            if len(rest):
                tree.add(build(rest, eps))
            m = tree.result()
            return key[1], key[2], m[3], *m[:3]

        for b in batches:
            out = []
            x, code = b.column("x").to_numpy(), b.column("code").to_numpy()  # changes with (group, day, shard)
            cut = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else []
            for i, j in zip(cut, np.r_[cut[1:], len(code)].astype(int) if len(cut) else []):
                k = (code[i], b.column("grp")[i].as_py(), b.column("day")[i].as_py())
                if k != key:
                    if key is not None:
                        out.append(done())
                    key, tree, rest = k, Tree(eps), np.zeros(0)
                rest = np.concatenate([rest, x[i:j]])
                while len(rest) >= chunk:
                    tree.add(build(rest[:chunk], eps))
                    rest = rest[chunk:]
            if out:
                yield _lists(out)
        if key is not None:
            yield _lists([done()])

    return work


def _unpack(b: pa.RecordBatch) -> list[Summary]:
    offs = b.column("v").offsets.to_numpy()
    v, lo, hi = (b.column(c).flatten().to_numpy() for c in ("v", "rmin", "rmax"))
    offs = offs - offs[0]
    n = b.column("n").to_pylist()
    return [(v[offs[i] : offs[i + 1]], lo[offs[i] : offs[i + 1]], hi[offs[i] : offs[i + 1]], n[i]) for i in range(len(n))]


def _merge_stream(eps: float, by_day: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree = None, Tree(eps)
        done = lambda: (key[0], key[1], (m := tree.result())[3], *m[:3])
        for b in batches:
            out = []
            g, d = b.column("grp").to_pylist(), b.column("day").to_pylist()
            for i, s in enumerate(_unpack(b)):
                k = (g[i], d[i] if by_day else None)
                if k != key:
                    if key is not None:
                        out.append(done())
                    key, tree = k, Tree(eps)
                tree.add(s)
            if out:
                yield _lists(out)
        if key is not None:
            yield _lists([done()])

    return work


@dataclass(frozen=True)
class RankSummaries:
    """``eps`` is the rank error, as a share of n, that each level may add (building, then each level of merging).

    Levels: one for building, up to one for each power of 16 in the number of chunks of a shard, of shards of a day,
    and of days of a group. ``rank_error_bound`` is what has really accumulated.
    """

    id: str = "execution_id"
    group: str = "model_name"
    value: str = "duration_ms"
    time: str = "started_at"
    least: float = 0.0
    eps: float = 0.0005
    shards: int | None = None

    def _values(self, df: DataFrame) -> DataFrame:
        c = lambda n: F.col(f"`{n}`")
        rows = df.select(c(self.id).alias("id"), c(self.group).cast("string").alias("grp"), F.to_date(c(self.time)).alias("day"), c(self.value).cast("double").alias("x"))
        rows = rows.filter((F.col("x") >= self.least) & ~F.isnan("x") & F.col("id").isNotNull() & F.col("grp").isNotNull())
        return rows.groupBy("id").agg(F.min(F.struct("x", "grp", "day")).alias("m")).select("id", "m.*")

    def daily(self, df: DataFrame) -> DataFrame:
        """One summary per (group, day); those of separate days or runs can be stored and merged later."""
        shards = self.shards or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)
        rows = self._values(df).select("grp", "day", "x", F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"))
        rows = rows.withColumn("code", F.xxhash64("grp", F.coalesce(F.col("day"), F.lit("0001-01-01").cast("date")), "shard"))
        parts = rows.repartition("grp", "day", "shard").sortWithinPartitions("code", "grp", "day", "x").select("grp", "day", "x", "code").mapInArrow(_build_stream(self.eps), SCHEMA)
        return self._merged(parts, ["grp", "day"])

    def merged(self, summaries: DataFrame) -> DataFrame:
        """One summary per group from those of its days (``day`` is NULL then)."""
        return self._merged(summaries, ["grp"])

    def _merged(self, parts: DataFrame, keys: list[str]) -> DataFrame:
        # a total order: equal input gives an equal result whatever the order of arrival
        return parts.repartition(*keys).sortWithinPartitions("grp", "day", "n", "v", "rmin", "rmax").mapInArrow(_merge_stream(self.eps, "day" in keys), SCHEMA)

    def percentiles(self, summaries: DataFrame, qs: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
        """(grp, day, n, p50, p90, p99, ..., rank_error, rank_error_bound) of each summary."""
        names = [f"p{q * 100:g}".replace(".", "_") for q in qs]
        arrow = pa.schema([("grp", pa.string()), ("day", pa.date32()), ("n", pa.int64()), *[(x, pa.float64()) for x in names], ("rank_error", pa.int64()), ("rank_error_bound", pa.int64())])

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for g, d, s in zip(b.column("grp").to_pylist(), b.column("day").to_pylist(), _unpack(b)):
                    a = [quantile(s, q) for q in qs]
                    rows.append((g, d, s[3], *[x for x, _ in a], max(e for _, e in a), bound(s)))
                yield _lists(rows, arrow)

        return summaries.mapInArrow(work, "grp string, day date, n long, " + "".join(f"{x} double, " for x in names) + "rank_error long, rank_error_bound long")

    def rank_check(self, df: DataFrame, answers: DataFrame, names: tuple[str, ...] = ("p50", "p90", "p99"), qs: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
        """(grp, n, within per percentile): whether the exact ranks lie within the stated bound."""
        rows = self._values(df).join(answers.select("grp", "n", "rank_error_bound", *names), "grp")
        agg = [F.count(F.when(F.col("x") < F.col(c), 1)).alias(f"{c}_lt") for c in names] + [F.count(F.when(F.col("x") <= F.col(c), 1)).alias(f"{c}_le") for c in names]
        got = rows.groupBy("grp", "n", "rank_error_bound").agg(F.count(F.lit(1)).alias("total"), *agg)

        def ok(c: str, q: float) -> Column:
            r = F.greatest(F.lit(1), F.ceil(F.round(F.col("n") * q, 9)))
            return ((F.col(f"{c}_lt") + 1 - F.col("rank_error_bound") <= r) & (r <= F.col(f"{c}_le") + F.col("rank_error_bound"))).alias(f"{c}_within")

        return got.select("grp", "n", (F.col("n") == F.col("total")).alias("n_exact"), *[ok(c, q) for c, q in zip(names, qs)])
