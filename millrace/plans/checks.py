"""Compile-time checks: keys that models are joined on, time-interval models, cost budgets and missing declarations."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..operators.materialize import parse_key
from ..types import common_supertype
from .project import Model, estimate_rows


def join_keys(frames: dict[str, DataFrame], upstream: dict[str, set[str]]) -> list[str]:
    """E001 for same-named columns of two upstreams whose types have nothing in common, W001 where one is widened."""
    out = []
    for model, ups in sorted(upstream.items()):
        seen: dict[str, tuple[str, T.DataType]] = {}
        for u in sorted(ups):
            for f in frames[u].schema if u in frames else []:
                if f.name in seen and seen[f.name][1] != f.dataType:
                    other, t = seen[f.name]
                    code = "E001" if common_supertype(t, f.dataType) is None else "W001"
                    out.append(f"{code} {model}: {f.name} is {t.simpleString()} in {other} and {f.dataType.simpleString()} in {u}")
                seen.setdefault(f.name, (u, f.dataType))
    return out


def time_interval(m: Model, schema: T.StructType) -> list[str]:
    """E020 no time column, E021 unknown column, E022 wrong type, E023 nullable, E024 no placeholder, E025 hours need a timestamp, E026 bad first period."""
    o, fields = m.options, {f.name: f for f in schema}
    col, grain = o.get("time_column"), o.get("grain", "day")
    if not col:
        return [f"E020 {m.name}"]
    if col not in fields:
        return [f"E021 {m.name}: {col}"]
    out, t = [], fields[col].dataType
    if not isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        out.append(f"E022 {m.name}: {col} is {t.simpleString()}")
    if fields[col].nullable and not o.get("allow_null", False):
        out.append(f"E023 {m.name}: {col}")
    if m.text and not ("@start_date" in m.text and "@end_date" in m.text):
        out.append(f"E024 {m.name}")
    if grain == "hour" and isinstance(t, T.DateType):
        out.append(f"E025 {m.name}: {col}")
    if first := o.get("first_period"):
        try:
            parse_key(first, grain)
        except ValueError:
            out.append(f"E026 {m.name}: {first}")
    return out


def fill_interval(text: str, start: datetime, end: datetime) -> str:
    """``@start_date`` and ``@end_date`` of a time-interval model's text."""
    for name, t in (("start", start), ("end", end)):
        text = re.sub(rf"@{name}_date\b", f"TIMESTAMP '{t:%Y-%m-%d %H:%M:%S}'", text)
    return text


def cost(plan: list[tuple[str, str, list[str]]], rows: dict[str, float], budget: float | None = None) -> tuple[dict[str, float], list[str]]:
    """Row estimates of steps (name, kind, inputs) in order, and E027 for those beyond the budget."""
    est = dict(rows)
    for name, kind, inputs in plan:
        est[name] = estimate_rows(kind, *[est[i] for i in inputs])
    return est, [f"E027 {n}" for n, *_ in plan if budget is not None and est[n] > budget]


def explain_estimate(df: DataFrame) -> dict[str, float]:
    """Bytes and, where Spark knows them, rows of the optimised plan."""
    s = df._jdf.queryExecution().optimizedPlan().stats()
    r = s.rowCount()
    return {"bytes": float(str(s.sizeInBytes())), **({"rows": float(str(r.get()))} if r.isDefined() else {})}


def declarations(models: list[Model], schema_of: Callable[[str], T.StructType]) -> list[str]:
    """W002 repeated column, W004 tagged column without a mask, W005 no freshness, W006 merge without keys or with unknown ones."""
    out = []
    for m in models:
        names = [f.name for f in schema_of(m.name)]
        out += [f"W002 {m.name}: {n}" for n in sorted({n for n in names if names.count(n) > 1})]
        out += [f"W004 {m.name}: {c}" for c in m.options.get("tags", {}) if c not in m.options.get("masks", {})]
        if m.strategy == "incremental" and "freshness" not in m.options:
            out.append(f"W005 {m.name}")
        if m.strategy == "merge" and (not m.keys or not set(m.keys) <= set(names)):
            out.append(f"W006 {m.name}")
    return out
