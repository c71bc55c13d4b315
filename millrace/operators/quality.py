"""Data quality: assertions, checks, quarantine, masks, profiles, anomalies and contracts, all as plans without a collect."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import is_assignable

_PATTERN = re.compile(r"^[\w\s^$.*+?()\[\]{}|\\\-@:/,#=<>!~%&;]*$")
_COMPARE = {"=": "__eq__", "==": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


@dataclass(frozen=True)
class Rule:
    """One assertion. Row rules pass where they are NULL; a row outside of ``where`` passes too."""

    kind: str
    column: str | None = None
    columns: tuple[str, ...] = ()
    values: tuple = ()
    low: float | None = None
    high: float | None = None
    pattern: str | None = None
    expression: str | None = None
    op: str | None = None
    cmp: str | None = None
    value: float | None = None
    to: DataFrame | None = None
    to_column: str | None = None
    run_ts: str | None = None
    days: int | None = None
    where: str | None = None
    severity: str = "error"
    name: str | None = None

    @property
    def label(self) -> str:
        return self.name or "_".join([self.kind, *([self.column] if self.column else self.columns)])

    def passes(self) -> Column | None:
        """The row predicate of row rules, never NULL; None for rules on sets of rows."""
        c = F.col(f"`{self.column}`") if self.column else None
        if self.kind == "not_null":
            ok = c.isNotNull()
        elif self.kind == "accepted_values":
            ok = c.cast("string").isin(*self.values)
        elif self.kind == "expression":
            ok = F.expr(self.expression)
        elif self.kind == "in_range":
            ok = reduce(lambda a, b: a & b, [x for x in (c >= self.low if self.low is not None else None, c <= self.high if self.high is not None else None) if x is not None])
        elif self.kind == "regex_match":
            if not _PATTERN.match(self.pattern):
                raise ValueError("characters in the pattern that are not allowed")
            ok = c.rlike(self.pattern)
        elif self.kind == "not_in_future":
            ok = c.cast("timestamp") <= F.lit(self.run_ts).cast("timestamp")
        elif self.kind == "older_than_n_days":
            ok = c.cast("date") <= F.date_sub(F.lit(self.run_ts).cast("date"), self.days)
        else:
            return None
        ok = F.coalesce(ok, F.lit(True))
        return F.when(F.coalesce(F.expr(self.where), F.lit(False)), ok).otherwise(F.lit(True)) if self.where else ok

    def failing(self, df: DataFrame) -> DataFrame:
        """Rows, groups or values that fail."""
        ok = self.passes()
        if self.kind == "accepted_values":
            return df.filter(~ok).select(self.column).distinct()
        if ok is not None:
            return df.filter(~ok)
        if self.where:
            df = df.filter(F.expr(self.where))
        if self.kind in ("unique", "composite_unique"):
            keys = [self.column] if self.column else list(self.columns)
            return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        if self.kind == "unique_expr":
            return df.groupBy(F.expr(self.expression).alias("key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        if self.kind == "relationships":
            to = self.to.select(F.col(f"`{self.to_column}`").alias("__to")).filter("__to is not null").distinct()
            return df.filter(F.col(f"`{self.column}`").isNotNull()).join(to, F.col(f"`{self.column}`") == F.col("__to"), "left_anti")
        if self.kind == "row_count_range":
            n = df.agg(F.count(F.lit(1)).alias("n"))
            bad = F.lit(False)
            bad = bad | (F.col("n") < self.low) if self.low is not None else bad
            return n.filter(bad | (F.col("n") > self.high) if self.high is not None else bad)
        if self.kind == "aggregate":
            f = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[self.op]
            a = df.agg(f(F.col(f"`{self.column}`")).alias("value"))
            return a.filter(~F.coalesce(getattr(F.col("value"), _COMPARE[self.cmp])(self.value), F.lit(False)))
        raise ValueError(f"no such rule: {self.kind}")

    def verdict(self, df: DataFrame) -> DataFrame:
        """(rule, severity, failures, passed), one row."""
        return self.failing(df).agg(F.count(F.lit(1)).alias("failures")).select(F.lit(self.label).alias("rule"), F.lit(self.severity).alias("severity"), "failures", (F.col("failures") == 0).alias("passed"))


def run_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Verdicts of all rules: the row rules in one pass over the data, the others beside it."""
    rows = [(r, p) for r in rules if r.kind != "accepted_values" and (p := r.passes()) is not None]
    parts = [r.verdict(df) for r in rules if r not in [x for x, _ in rows]]
    if rows:
        one = df.agg(*[F.count(F.when(~p, 1)).alias(f"r{i}") for i, (_, p) in enumerate(rows)])
        each = F.explode(F.array(*[F.struct(F.lit(r.label).alias("rule"), F.lit(r.severity).alias("severity"), F.col(f"r{i}").alias("failures")) for i, (r, _) in enumerate(rows)])).alias("x")
        parts.insert(0, one.select(each).select("x.*", (F.col("x.failures") == 0).alias("passed")))
    return reduce(DataFrame.unionByName, parts)


# quarantine
def _labelled(rules: list[Rule]) -> list[tuple[str, Column]]:
    out: list[tuple[str, Column]] = []
    for r in rules:
        p = r.passes()
        if p is None or r.severity != "error":
            continue
        n, k = f"_error_{r.label}", 2
        while n in [x for x, _ in out]:
            n, k = f"_error_{r.label}_{k}", k + 1
        out.append((n, p))
    return out


def tag(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """All rows, with a column per rule: its label where the row fails, else NULL."""
    return df.withColumns({n: F.when(~p, F.lit(n.removeprefix("_error_"))) for n, p in _labelled(rules)})


def split(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, failing rows with their error columns)."""
    preds = _labelled(rules)
    ok = reduce(lambda a, b: a & b, [p for _, p in preds], F.lit(True))
    return df.filter(ok), tag(df, rules).filter(~ok)


def drop(df: DataFrame, rules: list[Rule]) -> DataFrame:
    return split(df, rules)[0]


# masks
def mask(c: Column, how: str) -> Column:
    """hash, redact (NULL too), partial (first and last two characters; short texts whole) or none."""
    s = c.cast("string")
    if how == "hash":
        return F.sha2(s, 256)
    if how == "redact":
        return F.lit("***")
    if how == "partial":
        return F.when(s.isNull(), None).when(F.length(s) < 5, "***").otherwise(F.concat(F.substring(s, 1, 2), F.lit("***"), F.right(s, F.lit(2))))
    return c


# checks
def row_count_check(source: DataFrame, target: DataFrame) -> DataFrame:
    n = lambda d, side: d.agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(side))
    both = n(source, "source").unionByName(n(target, "target"))
    return both.agg(F.max(F.when(F.col("side") == "source", F.col("n"))).alias("source_rows"), F.max(F.when(F.col("side") == "target", F.col("n"))).alias("target_rows")).withColumn("passed", F.col("source_rows") == F.col("target_rows"))


def column_match(source: DataFrame, target: DataFrame, exclude: tuple[str, ...] = ()) -> tuple[set[str], set[str]]:
    """Names only in the source and only in the target, without case."""
    skip = {x.lower() for x in exclude}
    a, b = ({c.lower() for c in d.columns} - skip for d in (source, target))
    return a - b, b - a


def freshness(df: DataFrame, stamp: str, run_ts: str, max_lag_s: int) -> DataFrame:
    lag = F.unix_timestamp(F.lit(run_ts).cast("timestamp")) - F.unix_timestamp(F.max(F.col(stamp).cast("timestamp")))
    return df.agg(lag.cast("bigint").alias("lag_s")).withColumn("passed", F.coalesce(F.col("lag_s") <= max_lag_s, F.lit(False)))


def null_rates(df: DataFrame, columns: list[str] | None = None, threshold: float = 1.0) -> DataFrame:
    """(column_name, nulls, rows, null_rate, passed): one pass over the data."""
    cols = columns or df.columns
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"n{i}") for i, c in enumerate(cols)])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("nulls")) for i, c in enumerate(cols)])).alias("x")
    return one.select("rows", each).select("x.column_name", "x.nulls", "rows", (F.col("x.nulls") / F.when(F.col("rows") > 0, F.col("rows"))).alias("null_rate")).withColumn("passed", F.coalesce(F.col("null_rate") <= threshold, F.lit(True)))


def custom_check(df: DataFrame, sql: str, threshold: float) -> DataFrame:
    """``sql`` names the table as {target}; its single value must not exceed the threshold."""
    from pyspark.sql import SparkSession

    spark: SparkSession = df.sparkSession
    r = spark.sql(sql, target=df)
    return r.select(F.col(r.columns[0]).cast("double").alias("value")).withColumn("passed", F.coalesce(F.col("value") <= threshold, F.lit(False)))


def overlap(siblings: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Keys that more than one sibling has (NULL keys left out), with how many."""
    parts = [d.select(*keys, F.lit(n).alias("__src")) for n, d in siblings.items()]
    both = reduce(DataFrame.unionByName, parts)
    for k in keys:
        both = both.filter(F.col(k).isNotNull())
    return both.groupBy(*keys).agg(F.countDistinct("__src").alias("sources")).filter("sources > 1")


def anomaly(history: list[float], value: float, max_pct: float = 50.0) -> bool:
    """Whether a value is off the mean of its history by more than so many percent."""
    if not history:
        return False
    mean = sum(history) / len(history)
    return value != 0 if mean == 0 else abs(value - mean) / abs(mean) * 100 > max_pct


def anomalies(df: DataFrame, key: list[str], order: str, value: str, window: int, max_pct: float = 50.0) -> DataFrame:
    """The same over a table of counts: mean of up to ``window`` rows before each."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(-window, -1)
    mean = F.avg(value).over(w)
    return df.withColumn("mean_before", mean).withColumn("is_anomaly", F.when(F.col("mean_before").isNull(), False).when(F.col("mean_before") == 0, F.col(value) != 0).otherwise(F.abs(F.col(value) - F.col("mean_before")) / F.abs("mean_before") * 100 > max_pct))


def rolling_stats(df: DataFrame, key: list[str], order: list[str], value: str, window: int) -> DataFrame:
    """Mean, population deviation and z-score over the last ``window`` rows, the row itself included."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(-(window - 1), 0)
    s = df.withColumns({"mean": F.avg(value).over(w), "std": F.stddev_pop(value).over(w), "samples": F.count(value).over(w)})
    return s.withColumn("z", F.when((F.col("samples") >= 2) & (F.col("std") > 0), (F.col(value) - F.col("mean")) / F.col("std")))


def health(z: list[float]) -> float:
    return 1 - min(1.0, max(0.0, (max(map(abs, z), default=0.0) - 2) / 4))


# profiles
def profile(df: DataFrame, columns: list[str] | None = None, exact: bool = True) -> DataFrame:
    """(column_name, rows, nulls, distinct_values, min_text, max_text, mean, std): one aggregation.

    Exact distinct counts shuffle every distinct value of every column; without ``exact`` they come from sketches (2 % error), which
    combine before the shuffle: the choice for wide tables of many rows.
    """
    distinct = F.countDistinct if exact else lambda x: F.approx_count_distinct(x, 0.02)
    cols = columns or df.columns
    kinds = dict(df.dtypes)
    aggs: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`")
        num = kinds[c].startswith(("int", "bigint", "double", "float", "decimal", "smallint", "tinyint"))
        v = x.cast("double") if num else F.lit(None).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), distinct(x).alias(f"d{i}"), F.min(x.cast("string")).alias(f"a{i}"), F.max(x.cast("string")).alias(f"z{i}"), F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}")]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), (F.col("rows") - F.col(f"n{i}")).alias("nulls"), F.col(f"d{i}").alias("distinct_values"), F.col(f"a{i}").alias("min_text"), F.col(f"z{i}").alias("max_text"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std")) for i, c in enumerate(cols)])).alias("x")
    return df.agg(*aggs).select("rows", each).select("x.column_name", "rows", "x.nulls", "x.distinct_values", "x.min_text", "x.max_text", "x.mean", "x.std")


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    return df.groupBy(F.col(f"`{column}`").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.col("value").asc_nulls_first()).limit(k)


def profile_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Severity of what changed between two profiles, per column."""
    b = before.select("column_name", *[F.col(c).alias(f"b_{c}") for c in ("rows", "nulls", "distinct_values")])
    j = after.select("column_name", "rows", "nulls", "distinct_values").join(b, "column_name")
    rows = (F.col("rows") - F.col("b_rows")) / F.col("b_rows")
    nulls = F.col("nulls") / F.col("rows") - F.col("b_nulls") / F.col("b_rows")
    card = (F.col("distinct_values") - F.col("b_distinct_values")) / F.col("b_distinct_values")
    level = F.when((rows <= -0.5) | (nulls >= 0.1), "critical").when((F.abs(rows) >= 0.1) | (nulls >= 0.01) | (F.abs(card) >= 0.2), "warning").otherwise("ok")
    return j.select("column_name", F.round(rows, 6).alias("row_change"), F.round(nulls, 6).alias("null_rate_change"), F.round(card, 6).alias("distinct_change"), level.alias("severity"))


# contracts
@dataclass(frozen=True)
class ContractColumn:
    name: str
    type: T.DataType | None = None
    nullable: bool = True
    required: bool = True


def contract(schema: T.StructType, columns: list[ContractColumn], protected: tuple[str, ...] = (), previous: T.StructType | None = None, closed: bool = False) -> list[str]:
    """Diagnostics E010 missing, E011 type, E012 nullability, E013 protected column removed, W010 extra column."""
    have = {f.name.lower(): f for f in schema}
    out = []
    for c in columns:
        f = have.get(c.name.lower())
        if f is None:
            out += [f"E010 {c.name}"] if c.required else []
            continue
        if c.type is not None and not is_assignable(f.dataType, c.type):
            out.append(f"E011 {c.name}: {f.dataType.simpleString()} is not {c.type.simpleString()}")
        if not c.nullable and f.nullable:
            out.append(f"E012 {c.name}")
    if previous is not None:
        out += [f"E013 {p}" for p in protected if p.lower() in {f.name.lower() for f in previous} and p.lower() not in have]
    if closed:
        known = {c.name.lower() for c in columns}
        out += [f"W010 {f.name}" for f in schema if f.name.lower() not in known]
    return out
