"""Comparing tables: rows, chunk and partition checksums, schemas, drift."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from ..types import widens


def row_counts(a: DataFrame, b: DataFrame, warn_pct: float = 1.0, fail_pct: float = 5.0) -> DataFrame:
    n = lambda d, s: d.agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(s))
    both = n(a, 0).unionByName(n(b, 1)).agg(F.max(F.when(F.col("side") == 0, F.col("n"))).alias("left_rows"), F.max(F.when(F.col("side") == 1, F.col("n"))).alias("right_rows"))
    diff = F.col("right_rows") - F.col("left_rows")
    pct = F.when(F.col("left_rows") == 0, F.when(F.col("right_rows") == 0, 0.0).otherwise(100.0)).otherwise(F.abs(diff) * 100.0 / F.when(F.col("left_rows") > 0, F.col("left_rows")))
    return both.withColumn("diff", diff).withColumn("pct", F.round(pct, 6)).withColumn("verdict", F.when(F.col("pct") > fail_pct, "fail").when(F.col("pct") > warn_pct, "warn").otherwise("pass"))


def except_both(a: DataFrame, b: DataFrame, every: bool = False) -> DataFrame:
    """Rows of one side only, tagged; ``every`` counts repeated rows."""
    op = "exceptAll" if every else "subtract"
    return getattr(a, op)(b).withColumn("_diff_side", F.lit("left")).unionByName(getattr(b, op)(a).withColumn("_diff_side", F.lit("right")))


def row_hash(cols: list[str]) -> Column:
    return F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in cols])


def row_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, change) of added, removed and changed rows: one full outer join of row hashes.

    Both sides are reduced to key and hash before the shuffle. Rows without a key are in no chunk and no diff; count
    them with :func:`null_keys`.
    """
    cols = [c for c in a.columns if c != key and c in b.columns]
    side = lambda d, n: d.filter(F.col(key).isNotNull()).select(F.col(key), row_hash(cols).alias(n))
    j = side(a, "h_left").join(side(b, "h_right"), key, "full_outer")
    change = F.when(F.col("h_left").isNull(), "added").when(F.col("h_right").isNull(), "removed").when(F.col("h_left") != F.col("h_right"), "changed")
    return j.select(key, change.alias("change")).filter("change is not null")


def null_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    n = lambda d, s: d.filter(F.col(key).isNull()).agg(F.count(F.lit(1)).alias("null_keys")).withColumn("side", F.lit(s))
    return n(a, "left").unionByName(n(b, "right"))


def chunk_of(key: str, lo: int, hi: int, k: int) -> Column:
    """The chunk of a key in [lo, hi] cut into k ranges; the last takes what is left over, keys below are -1, keys beyond k."""
    step = (hi - lo) // k
    inside = F.lit(0) if step <= 0 else F.least(F.floor((F.col(key) - lo) / F.lit(step)), F.lit(k - 1))
    return F.when(F.col(key) < lo, -1).when(F.col(key) > hi, k).when(F.col(key).isNotNull(), inside).cast("bigint")


def split_range(lo: int, hi: int, k: int) -> list[tuple[int, int]]:
    """The half-open ranges of the chunks of [lo, hi]."""
    step = (hi - lo) // k
    if step <= 0:
        return [(lo, hi + 1)]
    return [(lo + i * step, hi + 1 if i == k - 1 else lo + (i + 1) * step) for i in range(k)]


def chunk_checksums(df: DataFrame, key: str, lo: int, hi: int, k: int = 32) -> DataFrame:
    """(chunk, rows, checksum, hash_sum) over all rows with a key, wherever it lies."""
    h = row_hash([key, *[c for c in df.columns if c != key]])
    return df.filter(F.col(key).isNotNull()).groupBy(chunk_of(key, lo, hi, k).alias("chunk")).agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("checksum"), F.sum(h.cast("decimal(38,0)")).alias("hash_sum"))


def key_bounds(a: DataFrame, b: DataFrame, key: str) -> tuple[int, int, int]:
    """(least key, greatest key, rows) of both tables together."""
    r = a.select(key).unionByName(b.select(key)).agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(key).alias("n")).first()
    return r.lo or 0, r.hi or 0, r.n


def chunked_diff(a: DataFrame, b: DataFrame, key: str, leaf_rows: int = 1000) -> DataFrame:
    """:func:`row_diff` of the chunks whose checksums differ; equal chunks are never joined.

    Bounds and number of chunks come from both tables, so that a chunk has about ``leaf_rows`` rows of either: what bisection
    finds level by level, one grouped aggregation finds at once. How many chunks differ decides how they are joined (AQE).
    """
    lo, hi, n = key_bounds(a, b, key)
    k = max(32, n // (2 * leaf_rows))
    ca, cb = chunk_checksums(a, key, lo, hi, k), chunk_checksums(b, key, lo, hi, k)
    same = F.struct("rows", "checksum", "hash_sum")
    j = ca.select("chunk", same.alias("x")).join(cb.select("chunk", same.alias("y")), "chunk", "full_outer")
    bad = materialize(j.filter(~F.col("x").eqNullSafe(F.col("y"))).select(F.col("chunk").alias("__c")), "chunks")
    pick = lambda d: d.join(bad, chunk_of(key, lo, hi, k) == F.col("__c"), "left_semi")
    return row_diff(pick(a), pick(b), key)


def samples(diff: DataFrame, key: str, n: int = 5) -> DataFrame:
    """(change, rows, keys): how many rows changed in each way, and the first ``n`` keys of them."""
    w = Window.partitionBy("change").orderBy(key)
    top = diff.withColumn("i", F.row_number().over(w)).filter(F.col("i") <= n).groupBy("change").agg(F.sort_array(F.collect_list(key)).alias("keys"))
    return diff.groupBy("change").agg(F.count(F.lit(1)).alias("rows")).join(top, "change")


def partition_checksums(df: DataFrame, partition: Column, cols: list[str] | None = None) -> DataFrame:
    """(part, rows, checksum): the order of rows does not matter; repeated rows do, as the sum goes beside the xor."""
    h = row_hash(cols or df.columns)
    return df.groupBy(partition.alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("checksum"), F.sum(h.cast("decimal(38,0)")).alias("hash_sum"))


def changed_partitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """(part, state): changed (new and removed ones too) or unchanged."""
    b = before.select("part", F.struct("rows", "checksum", "hash_sum").alias("b"))
    j = b.join(after.select("part", F.struct("rows", "checksum", "hash_sum").alias("a")), "part", "full_outer")
    return j.select("part", F.when(F.col("a").eqNullSafe(F.col("b")), "unchanged").otherwise("changed").alias("state"))


def shared_partitions(tables: dict[str, DataFrame]) -> DataFrame:
    """Partitions with equal content in several tables: (checksum, rows, hash_sum, tables, copies)."""
    out = None
    for n, d in tables.items():
        d = d.select("rows", "checksum", "hash_sum", F.lit(n).alias("t"))
        out = d if out is None else out.unionByName(d)
    return out.groupBy("checksum", "rows", "hash_sum").agg(F.countDistinct("t").alias("tables"), F.count(F.lit(1)).alias("copies")).filter("tables > 1")


def schema_diff(a: T.StructType, b: T.StructType) -> list[str]:
    """What b has otherwise than a: added, removed, retyped and moved columns; names count with case."""
    x, y = {f.name: f.dataType for f in a}, {f.name: f.dataType for f in b}
    out = [f"removed {n}" for n in x if n not in y] + [f"added {n}" for n in y if n not in x]
    out += [f"type {n}: {x[n].simpleString()} to {y[n].simpleString()}" for n in x if n in y and x[n] != y[n]]
    both = [n for n in x if n in y]
    if both != [n for n in y if n in x]:
        out.append("order")
    return out


@dataclass(frozen=True)
class Drift:
    """What must happen to a target for a source: 'none', 'evolve' (add columns, widen) or 'recreate'."""

    action: str
    added: tuple[str, ...] = ()
    widened: tuple[str, ...] = ()
    retyped: tuple[str, ...] = ()
    gone: tuple[str, ...] = ()


def detect_drift(source: T.StructType, target: T.StructType) -> Drift:
    s, t = {f.name.lower(): f for f in source}, {f.name.lower(): f for f in target}
    added = tuple(f.name for n, f in s.items() if n not in t)
    kept = [(f, t[n]) for n, f in s.items() if n in t and t[n].dataType != f.dataType]
    widened = tuple(f.name for f, o in kept if widens(o.dataType, f.dataType))
    retyped = tuple(f.name for f, o in kept if not widens(o.dataType, f.dataType) and not widens(f.dataType, o.dataType))
    gone = tuple(f.name for n, f in t.items() if n not in s)
    return Drift("recreate" if retyped else "evolve" if added or widened else "none", added, widened, retyped, gone)


def evolve(target: DataFrame, source: T.StructType) -> DataFrame:
    """The target with the source's new columns (NULL) and wider types; columns the source lost stay."""
    d = detect_drift(source, target.schema)
    types = {f.name.lower(): f.dataType for f in source}
    cols = [F.col(f"`{f.name}`").cast(types[f.name.lower()]).alias(f.name) if f.name.lower() in {w.lower() for w in d.widened} else F.col(f"`{f.name}`") for f in target.schema]
    return target.select(*cols, *[F.lit(None).cast(types[a.lower()]).alias(a) for a in d.added])


def grace(state: dict[str, str], gone: tuple[str, ...], present: tuple[str, ...], today: str, days: int) -> tuple[dict[str, str], list[str], list[str]]:
    """(state, columns kept NULL, columns expired): a dropped column is kept for some days; one that returns starts anew."""
    from datetime import date

    left = {c: d for c, d in state.items() if c not in present}
    for c in gone:
        left.setdefault(c, today)
    age = {c: (date.fromisoformat(today) - date.fromisoformat(d)).days for c, d in left.items()}
    expired = sorted(c for c, a in age.items() if a >= days)
    return {c: d for c, d in left.items() if c not in expired}, sorted(c for c in left if c not in expired), expired
