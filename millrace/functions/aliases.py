"""Function names of the query language and of SQL models, resolved to Spark's built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def _trunc(x: Column, n: Column | None = None) -> Column:
    # towards zero; Spark's own trunc() is for dates
    return F.signum(x) * F.floor(F.abs(x)) if n is None else F.signum(x) * F.floor(F.abs(x) * F.pow(F.lit(10.0), n)) / F.pow(F.lit(10.0), n)


def _chain(*pairs: Column) -> Column:
    """DECODE(x, a, r, b, s, ..., default): equality treats NULLs as equal."""
    x, rest = pairs[0], list(pairs[1:])
    default = rest.pop() if len(rest) % 2 else F.lit(None)
    out = None
    for a, r in zip(rest[::2], rest[1::2]):
        out = F.when(x.eqNullSafe(a), r) if out is None else out.when(x.eqNullSafe(a), r)
    return out.otherwise(default)


#: Names that Spark lacks or reads differently.
ALIASES: dict[str, Callable[..., Column]] = {
    "iff": lambda c, a, b: F.when(c, a).otherwise(b),
    "iif": lambda c, a, b: F.when(c, a).otherwise(b),
    "if": lambda c, a, b: F.when(c, a).otherwise(b),
    "strpos": lambda s, x: F.call_function("instr", s, x).cast("bigint"),
    "instr": lambda s, x: F.call_function("instr", s, x).cast("bigint"),
    "position": lambda x, s: F.call_function("instr", s, x).cast("bigint"),
    "trunc": _trunc,
    "truncate": _trunc,
    "format": lambda f, *a: F.call_function("format_string", f, *a),
    "log": lambda x: F.log10(x),
    "len": lambda s: F.length(s).cast("bigint"),
    "length": lambda s: F.length(s).cast("bigint"),
    "char_length": lambda s: F.length(s).cast("bigint"),
    "character_length": lambda s: F.length(s).cast("bigint"),
    "octet_length": lambda s: F.octet_length(s).cast("bigint"),
    "ceil": lambda x: F.ceil(x).cast("bigint"),
    "ceiling": lambda x: F.ceil(x).cast("bigint"),
    "floor": lambda x: F.floor(x).cast("bigint"),
    "today": lambda: F.current_date(),
    "count_distinct": lambda *a: F.countDistinct(*a),
    "count": lambda *a: F.count(*a) if a else F.count(F.lit(1)),
    "decode": _chain,
    "dateadd": lambda d, n: F.date_add(d, n.cast("int")),
    "datesub": lambda d, n: F.date_sub(d, n.cast("int")),
    "cardinality": lambda a: F.size(a),
    "startswith": lambda s, x: F.startswith(s, x),
    "endswith": lambda s, x: F.endswith(s, x),
}

#: Functions whose result depends on more than their arguments.
VOLATILE = frozenset("now current_timestamp current_date today rand randn random uuid shuffle monotonically_increasing_id spark_partition_id input_file_name".split())
#: Aggregates whose result depends on the order of rows.
ORDER_DEPENDENT = frozenset("first last any_value array_agg collect_list collect_set mode first_value last_value".split())


#: Window functions that number rows; bigint as all counts are.
RANKS = frozenset("row_number rank dense_rank ntile".split())


def call(name: str, args: list[Column], window: WindowSpec | None = None) -> Column:
    n = name.lower()
    c = ALIASES[n](*args) if n in ALIASES else F.call_function(n, *args)
    if window is None:
        return c
    c = c.over(window)
    return c.cast("bigint") if n in RANKS else c


def is_deterministic(names: list[str]) -> bool:
    return not any(n.lower() in VOLATILE or n.lower() in ORDER_DEPENDENT for n in names)
