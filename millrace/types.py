"""Type rules of diagnostics and contracts: common supertype, assignability, names of types."""

from __future__ import annotations

import re

from pyspark.sql import types as T


class Unknown(T.NullType):
    """Not inferred; compatible with everything. Never part of a DataFrame's schema."""


_INT_DIGITS = {T.IntegerType: 10, T.LongType: 19}


def common_supertype(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The narrowest type both fit in by the diagnostics' rules, None if there is none."""
    if a == b:
        return a
    for x, y in ((a, b), (b, a)):
        if isinstance(x, Unknown):
            return y
        tx = type(x)
        if tx in _INT_DIGITS:
            if tx is T.IntegerType and isinstance(y, T.LongType):
                return y
            if isinstance(y, (T.FloatType, T.DoubleType)):
                return T.DoubleType()
            if isinstance(y, T.DecimalType):
                return T.DecimalType(min(38, max(y.precision, _INT_DIGITS[tx])), y.scale)
        if isinstance(x, T.FloatType) and isinstance(y, T.DoubleType):
            return y
        if isinstance(x, T.DecimalType) and isinstance(y, T.DecimalType):
            return T.DecimalType(max(x.precision, y.precision), max(x.scale, y.scale))
        if isinstance(x, T.TimestampType) and isinstance(y, T.TimestampNTZType):
            return x
    return None


def is_assignable(source: T.DataType, target: T.DataType) -> bool:
    """Whether every value of ``source`` fits ``target``."""
    if source == target or isinstance(source, Unknown) or isinstance(target, Unknown):
        return True
    if isinstance(source, T.DecimalType) and isinstance(target, T.DecimalType):
        return source.scale <= target.scale and source.precision - source.scale <= target.precision - target.scale
    if type(source) in _INT_DIGITS and isinstance(target, T.DecimalType):
        return target.precision - target.scale >= _INT_DIGITS[type(source)]
    if isinstance(source, T.IntegerType):
        return isinstance(target, (T.LongType, T.DoubleType))
    if isinstance(source, T.LongType):
        return isinstance(target, T.DoubleType)
    return isinstance(source, T.FloatType) and isinstance(target, T.DoubleType)


_NAMES = {
    "boolean": T.BooleanType(), "bool": T.BooleanType(), "tinyint": T.IntegerType(), "smallint": T.IntegerType(), "int": T.IntegerType(), "integer": T.IntegerType(),
    "bigint": T.LongType(), "long": T.LongType(), "float": T.FloatType(), "real": T.FloatType(), "double": T.DoubleType(), "string": T.StringType(), "varchar": T.StringType(),
    "text": T.StringType(), "char": T.StringType(), "date": T.DateType(), "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType(), "binary": T.BinaryType(), "variant": T.VariantType(),
}


def parse_type(name: str) -> T.DataType:
    """A type from its warehouse name; a bare DECIMAL is (38, 0), an unheard-of name is Unknown."""
    n = name.strip().lower()
    if m := re.fullmatch(r"(?:decimal|numeric)(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?", n):
        return T.DecimalType(int(m[1] or 38), int(m[2] or 0))
    n = re.sub(r"\(.*\)$", "", n).strip()
    return _NAMES.get(n, Unknown())


#: Changes of a column's type that keep every value (old, new).
WIDENING = [("int", "bigint"), ("int", "double"), ("float", "double"), ("date", "timestamp"), ("date", "timestamp_ntz")]


def widens(old: T.DataType, new: T.DataType) -> bool:
    if isinstance(old, T.DecimalType) and isinstance(new, T.DecimalType):
        return is_assignable(old, new)
    return (old.simpleString(), new.simpleString()) in WIDENING or isinstance(new, T.StringType) and not isinstance(old, (T.ArrayType, T.MapType, T.StructType))
