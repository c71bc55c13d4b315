"""Rewrites that let SQL models of other dialects run: QUALIFY, SAFE_CAST, IFF, STRPOS, COUNT(), run variables and macros."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


class MissingVariable(KeyError):
    """E028: a run variable without a value and without a default."""


_MASK = re.compile(r"'(?:[^']|'')*'|--[^\n]*")


def _outside(sql: str, change) -> str:
    """Applies ``change`` to everything but string literals and comments."""
    out, i = [], 0
    for m in _MASK.finditer(sql):
        out += [change(sql[i : m.start()]), m[0]]
        i = m.end()
    return "".join([*out, change(sql[i:])])


_NAMES = [(r"\bSAFE_CAST\s*\(", "TRY_CAST("), (r"\b(?:IFF|IIF)\s*\(", "IF("), (r"\bSTRPOS\s*\(", "INSTR("), (r"\bCOUNT\s*\(\s*\)", "COUNT(1)"), (r"\bCOUNT_DISTINCT\s*\(", "COUNT(DISTINCT "), (r"\bTODAY\s*\(\s*\)", "CURRENT_DATE()"), (r"\bLEN\s*\(", "LENGTH("), (r"\bFORMAT\s*\(", "FORMAT_STRING(")]


def names(sql: str) -> str:
    def change(part: str) -> str:
        for a, b in _NAMES:
            part = re.sub(a, b, part, flags=re.I)
        return part

    return _outside(sql, change)


def qualify(sql: str) -> str:
    """``SELECT ... QUALIFY cond``: the condition's window becomes a column of a subquery that is filtered."""
    hidden: list[str] = []

    def hide(m: re.Match) -> str:
        hidden.append(m[0])
        return f"\0{len(hidden) - 1}\0"

    text = _MASK.sub(hide, sql)
    m = re.search(r"\bQUALIFY\b(.*?)(?=\bORDER\s+BY\b(?![^()]*\))|\bLIMIT\b|\Z)", text, re.I | re.S)
    if m:
        body, cond, rest = text[: m.start()], m[1].strip(), text[m.end() :]
        s = re.match(r"(\s*(?:WITH\b.*\)\s*)?SELECT\s+(?:DISTINCT\s+)?)(.*)", body, re.I | re.S)
        if not s:
            raise ValueError("QUALIFY outside of a SELECT")
        text = f"SELECT * EXCEPT (__qualify) FROM ({s[1]}({cond}) AS __qualify, {s[2]}) WHERE __qualify {rest}"
    return re.sub(r"\0(\d+)\0", lambda m: hidden[int(m[1])], text)


def variables(sql: str, values: dict[str, str] | None = None) -> str:
    """``@var(name)`` and ``@var(name, default)``."""

    def one(m: re.Match) -> str:
        n, default = m[1], m[2]
        if values and n in values:
            return str(values[n])
        if default is None:
            raise MissingVariable(f"E028 run variable {n!r} has no value")
        return default.strip()

    return re.sub(r"@var\(\s*(\w+)\s*(?:,\s*([^()]*?))?\s*\)", one, sql)


def macros(sql: str, defined: dict[str, tuple[list[str], str]], depth: int = 16) -> str:
    """``@name(args)`` replaced by the macro's body with its parameters filled in, macros within macros too."""
    for _ in range(depth + 1):
        m = next((m for m in re.finditer(r"@(\w+)\(([^()]*)\)", sql) if m[1] in defined), None)
        if not m:
            return sql
        params, body = defined[m[1]]
        args = [a.strip() for a in m[2].split(",")] if m[2].strip() else []
        if len(args) != len(params):
            raise ValueError(f"macro {m[1]} takes {len(params)} arguments")
        for p, a in zip(params, args):
            body = re.sub(rf"\b{p}\b", lambda _, a=a: a, body)
        sql = sql[: m.start()] + body + sql[m.end() :]
    raise ValueError(f"macros nested more than {depth} deep")


def rewrite(sql: str, values: dict[str, str] | None = None, defined: dict[str, tuple[list[str], str]] | None = None) -> str:
    return qualify(names(macros(variables(sql, values), defined or {})))


def run_sql(spark: SparkSession, sql: str, values: dict[str, str] | None = None, defined: dict[str, tuple[list[str], str]] | None = None) -> DataFrame:
    return spark.sql(rewrite(sql, values, defined))


_PORTABILITY = {
    "QUALIFY": r"\bQUALIFY\b", "ILIKE": r"\bILIKE\b", "SAFE_CAST": r"\bSAFE_CAST\s*\(", "IFF": r"\bIFF\s*\(", "STRPOS": r"\bSTRPOS\s*\(",
    "COUNT()": r"\bCOUNT\s*\(\s*\)", "NVL": r"\bNVL\s*\(", "DATEADD": r"\bDATEADD\s*\(", "::": r"::",
}


def portability(sql: str) -> list[str]:
    """P001: constructs that not every dialect has."""
    text = _MASK.sub("", sql)
    return [f"P001 {k}" for k, p in _PORTABILITY.items() if re.search(p, text, re.I)]
