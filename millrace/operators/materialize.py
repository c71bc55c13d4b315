"""Ways to build a table from a model: full refresh, incremental, merge, time intervals, delete+insert, snapshots, views."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import TableStore

EPOCH = "1970-01-01 00:00:00"


def full_refresh(store: TableStore, table: str, df: DataFrame) -> DataFrame:
    return store.replace(table, df)


def bootstrap(store: TableStore, table: str, df: DataFrame) -> DataFrame:
    if store.exists(table):
        raise ValueError(f"{table} is there already")
    return store.replace(table, df)


def incremental(store: TableStore, table: str, source: DataFrame, stamp: str) -> DataFrame:
    """Appends rows stamped strictly after the watermark, up to the greatest stamp there is when the run begins.

    The watermark is part of the table's version: rows and watermark are there together or not at all, so a run that is
    repeated after a crash neither skips nor repeats rows, and what lands while it runs is left to the next.
    """
    mark = ((store.version(table)[1] or {}).get("state") or {}).get("watermark", EPOCH)
    ts = F.col(stamp).cast("timestamp")
    new = source.filter(ts > F.lit(mark).cast("timestamp"))
    top = new.agg(F.date_format(F.max(ts), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]
    if top is None:
        return store.read(table) if store.exists(table) else store.append(table, new)
    return store.append(table, new.filter(ts <= F.lit(top).cast("timestamp")), {"watermark": top})


def merged(target: DataFrame, source: DataFrame, keys: list[str], update: list[str] | None = None) -> DataFrame:
    """MERGE as one full outer join: matched rows take ``update`` (all columns by default), others are kept or inserted."""
    if not keys:
        raise ValueError("a merge needs key columns")
    cols = target.columns
    update = [c for c in cols if c not in keys] if update is None else update
    s = source.select(*[F.col(f"`{c}`").alias(f"__s_{c}") for c in cols], F.lit(True).alias("__there"))
    on = [target[k] == s[f"__s_{k}"] for k in keys]
    j = target.withColumn("__old", F.lit(True)).join(s, on, "full_outer")
    take = lambda c: F.when(F.col("__there").isNotNull() & (F.col("__old").isNull() | F.lit(c in update)), F.col(f"__s_{c}")).otherwise(F.col(f"`{c}`"))
    return j.select(*[take(c).alias(c) for c in cols])


def merge(store: TableStore, table: str, source: DataFrame, keys: list[str], update: list[str] | None = None) -> DataFrame:
    return store.replace(table, merged(store.read(table), source, keys, update) if store.exists(table) else source)


def delete_insert(store: TableStore, table: str, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Replaces the rows of every partition tuple that the incoming rows have."""
    if not store.exists(table):
        return store.replace(table, incoming)
    kept = store.read(table).join(incoming.select(*keys).distinct(), keys, "left_anti")
    return store.replace(table, kept.unionByName(incoming))


def time_interval(store: TableStore, table: str, model: Callable[[datetime, datetime], DataFrame], time_column: str, windows: list[tuple[datetime, datetime]], grain: str) -> DataFrame:
    """Computes the model per half-open window and replaces all periods of the window (key column ``period``) at once.

    The period comes from each row's time, so a window may span any number of periods; those without rows are emptied.
    """
    if not windows:
        raise ValueError("no period to build")
    out = None
    for start, end in windows:
        t = F.col(time_column).cast("timestamp")
        df = model(start, end).filter((t >= F.lit(start)) & (t < F.lit(end))).withColumn("period", F.date_format(t, _FORMATS[grain]))
        touched = []
        while start < end:
            touched.append(period_key(start, grain))
            start = step(start, grain)
        out = store.replace_partitions(table, df, "period", touched)
    return out


def time_interval_bootstrap(store: TableStore, table: str, model: Callable[[datetime, datetime], DataFrame], grain: str) -> DataFrame:
    """The table of a time-interval model without rows: what depends on it can be built before its first period is."""
    if store.exists(table):
        return store.read(table)
    t = parse_key({"hour": "1970-01-01T00", "day": "1970-01-01", "month": "1970-01", "year": "1970"}[grain], grain)
    return store.replace(table, model(t, t).filter(F.lit(False)).withColumn("period", F.lit("")), ["period"])


def surrogate_key(cols: list[str], null: str = "_dbt_utils_surrogate_key_null_") -> Column:
    """md5 of the columns' texts joined by '-', NULL having a text of its own."""
    return F.md5(F.concat_ws("-", *[F.coalesce(F.col(c).cast("string"), F.lit(null)) for c in cols]))


def metadata_columns(df: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Appends {name: (value expression, type)}."""
    return df.withColumns({n: F.expr(v).cast(t) for n, (v, t) in columns.items()})


def archive(df: DataFrame, stamp: str, before: str) -> tuple[DataFrame, DataFrame]:
    """(rows to keep, rows older than ``before``)."""
    old = F.coalesce(F.col(stamp).cast("timestamp") < F.lit(before).cast("timestamp"), F.lit(False))
    return df.filter(~old), df.filter(old)


def compact(store: TableStore, table: str, files: int, sort: list[str] | None = None) -> DataFrame:
    """Rewrites a table into few files, sorted so that min/max statistics prune."""
    df = store.read(table)
    df = df.repartitionByRange(files, *sort).sortWithinPartitions(*sort) if sort else df.repartition(files)
    return store.replace(table, df)


# snapshots (slowly changing dimensions, type 2)
@dataclass(frozen=True)
class Snapshot:
    """``updated_at`` or ``check`` columns decide what changed; ``run_ts`` is always given, never read from a clock."""

    keys: tuple[str, ...]
    updated_at: str | None = None
    check: tuple[str, ...] = ()
    hard_deletes: bool = False

    def with_id(self, history: DataFrame) -> DataFrame:
        """Adds ``snapshot_id``, a key of each version: md5 of its keys and the time it is valid from."""
        return history.withColumn("snapshot_id", surrogate_key([*self.keys, "valid_from"]))

    def first(self, source: DataFrame, run_ts: str) -> DataFrame:
        return source.withColumns({"valid_from": self._from(run_ts), "valid_to": F.lit(None).cast("timestamp"), "is_current": F.lit(True)})

    def _from(self, run_ts: str) -> Column:
        return F.col(self.updated_at).cast("timestamp") if self.updated_at else F.lit(run_ts).cast("timestamp")

    def run(self, history: DataFrame, source: DataFrame, run_ts: str) -> DataFrame:
        """The history after this run: one full outer join of current rows and source, closed versions passed through."""
        if not self.keys:
            raise ValueError("a snapshot needs key columns")
        cols = source.columns
        closed, cur = history.filter("not is_current"), history.filter("is_current")
        s = source.select(*[F.col(f"`{c}`").alias(f"__s_{c}") for c in cols], F.lit(True).alias("__there"))
        j = cur.withColumn("__old", F.lit(True)).join(s, [cur[k] == s[f"__s_{k}"] for k in self.keys], "full_outer")
        watched = [self.updated_at] if self.updated_at else list(self.check)
        differs = F.lit(False)
        for c in watched:
            differs = differs | ~F.col(f"`{c}`").eqNullSafe(F.col(f"__s_{c}"))
        old, there = F.col("__old").isNotNull(), F.col("__there").isNotNull()
        kind = F.when(old & there & differs, "changed").when(old & there, "same").when(old, "gone").otherwise("new")
        j = j.withColumn("__kind", kind)
        now = F.lit(run_ts).cast("timestamp")
        new_from = F.col(f"__s_{self.updated_at}").cast("timestamp") if self.updated_at else now
        ends = F.when(F.col("__kind") == "changed", new_from).when((F.col("__kind") == "gone") & F.lit(self.hard_deletes), now)
        kept = j.filter("__old is not null").select(*cols, "valid_from", ends.alias("valid_to"), ends.isNull().alias("is_current"))
        fresh = j.filter(F.col("__kind").isin("changed", "new")).select(*[F.col(f"__s_{c}").alias(c) for c in cols], new_from.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), F.lit(True).alias("is_current"))
        return closed.unionByName(kept).unionByName(fresh)


# periods
_FORMATS = {"hour": "yyyy-MM-dd'T'HH", "day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}
_KEYS = {"hour": "%Y-%m-%dT%H", "day": "%Y-%m-%d", "month": "%Y-%m", "year": "%Y"}


def period_key(t: datetime, grain: str) -> str:
    return t.strftime(_KEYS[grain])


def parse_key(key: str, grain: str) -> datetime:
    """The period's first moment; only the canonical spelling of a key is taken."""
    t = datetime.strptime(key, _KEYS[grain])
    if period_key(t, grain) != key:
        raise ValueError(f"not a {grain} key: {key!r}")
    return t


def truncate(t: datetime, grain: str) -> datetime:
    return datetime.strptime(period_key(t, grain), _KEYS[grain])


def step(t: datetime, grain: str, n: int = 1) -> datetime:
    if grain in ("hour", "day"):
        return t + timedelta(**{grain + "s": n})
    months = t.year * 12 + t.month - 1 + n * (12 if grain == "year" else 1)
    return t.replace(year=months // 12, month=months % 12 + 1)


def plan_periods(grain: str, *, single: str | None = None, first: str | None = None, last: str | None = None, latest: datetime | None = None, built: set[str] | None = None, lookback: int = 0, batch: int = 1) -> list[tuple[datetime, datetime]]:
    """Half-open windows to build, in order: one period, a range, the latest closed one, or those of a range not ``built``.

    ``lookback`` adds earlier periods for late data, ``batch`` merges up to so many consecutive periods into one window.
    """
    if single is not None:
        todo = [parse_key(single, grain)]
    elif latest is not None and first is None:
        todo = [step(truncate(latest, grain), grain, -1)]
    else:
        a = parse_key(first, grain)
        b = parse_key(last, grain) if last else step(truncate(latest, grain), grain, -1)
        todo = []
        while a <= b:
            if built is None or period_key(a, grain) not in built:
                todo.append(a)
            a = step(a, grain)
    if todo and lookback:
        todo = sorted({*todo, *(step(todo[0], grain, -k) for k in range(1, lookback + 1))})
    out: list[tuple[datetime, datetime]] = []
    size = 0
    for t in todo:
        if out and out[-1][1] == t and size < batch:
            out[-1] = (out[-1][0], step(t, grain))
            size += 1
        else:
            out.append((t, step(t, grain)))
            size = 1
    return out
