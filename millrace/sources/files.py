"""File sources: CSV, TSV, Parquet and JSON lines; seeds with inferred types; discovery of tables by name pattern."""

from __future__ import annotations

import re
from pathlib import PurePath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = {".csv": "csv", ".tsv": "csv", ".parquet": "parquet", ".jsonl": "json", ".ndjson": "json", ".json": "json", ".orc": "orc"}


def format_of(path: str) -> str:
    f = FORMATS.get(PurePath(path).suffix.lower())
    if f is None:
        raise ValueError(f"no format for {path!r}")
    return f


def load(spark: SparkSession, path: str, schema: T.StructType | str | None = None, delimiter: str | None = None, header: bool = True) -> DataFrame:
    """Reads a file or folder by its extension; CSV without a schema is read as text."""
    if ".." in PurePath(path).parts:
        raise ValueError("a path must not go up")
    f = format_of(path)
    r = spark.read.format(f)
    if f == "csv":
        d = delimiter or ("\t" if path.endswith(".tsv") else ",")
        if len(d) != 1:
            raise ValueError("a delimiter is one character")
        r = r.option("header", header).option("sep", d).option("quote", '"').option("escape", '"').option("multiLine", True)
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)


def seed(spark: SparkSession, path: str, types: dict[str, str] | None = None) -> DataFrame:
    """A CSV or TSV file with types inferred from all of its rows; ``types`` overrides some, and a value that isn't of its type fails.

    The file is read by Spark, wherever it lies, once for the types and once for the rows.
    """
    d = "\t" if path.endswith(".tsv") else ","
    text = load(spark, path, None, d)
    over = types or {}
    kinds = {"bool": r"(?i)true|false", "int": r"[+-]?\d{1,18}", "float": r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", "ts": r"\d{4}-\d{2}-\d{2}.*"}
    cols = [c for c in text.columns if c not in over]
    fits = [F.bool_and((F.col(f"`{c}`") == "") | F.col(f"`{c}`").rlike(f"^({p})$")).alias(f"{i}_{k}") for i, c in enumerate(cols) for k, p in kinds.items()]
    seen = [F.count(F.when(F.col(f"`{c}`") != "", 1)).alias(f"{i}_n") for i, c in enumerate(cols)]
    r = text.agg(*fits, *seen).first() if cols else {}

    def kind(i: int) -> T.DataType:
        if not r[f"{i}_n"]:
            return T.StringType()
        found = [t for k, t in (("bool", T.BooleanType()), ("int", T.LongType()), ("float", T.DoubleType()), ("ts", T.TimestampType())) if r[f"{i}_{k}"]]
        return found[0] if found else T.StringType()

    target = {c: T.StructType.fromDDL(f"x {over[c]}")[0].dataType if c in over else kind(cols.index(c)) for c in text.columns}
    # an ANSI cast: what doesn't fit is an error, not a NULL
    checked = [F.coalesce(F.col(f"`{c}`").try_cast(t), F.when(F.col(f"`{c}`") != "", F.raise_error(F.concat(F.lit(f"{c} is no {t.simpleString()}: "), F.col(f"`{c}`"))).cast(t))).alias(c) for c, t in target.items()]
    return text.select(*checked)


def write(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    f = format_of(path)
    w = df.write.format(f).mode(mode)
    if f == "csv":
        w = w.option("header", True).option("sep", "\t" if path.endswith(".tsv") else ",").option("escape", '"')
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def parse_schema_name(name: str, pattern: str) -> dict[str, str | list[str]] | None:
    """Parts of a schema name such as ``src__acme__eu__west__shop`` by ``src__{tenant}__{regions...}__{source}``."""
    parts = re.split(r"(\{\w+(?:\.\.\.)?\})", pattern)
    rx = "".join(f"(?P<{p[1:-1].removesuffix('...')}>" + (r"[A-Za-z0-9_]+?" if p.endswith("...}") else r"[A-Za-z0-9]+(?:_[A-Za-z0-9]+)*?") + ")" if p.startswith("{") else re.escape(p) for p in parts)
    m = re.fullmatch(rx, name)
    if not m:
        return None
    many = {p[1:-4] for p in parts if p.endswith("...}")}
    return {k: v.split("__") if k in many else v for k, v in m.groupdict().items()}


def discover(spark: SparkSession, pattern: str) -> list[dict]:
    """Databases of the catalog whose names match the pattern, with their tables."""
    out = []
    for db in spark.catalog.listDatabases():
        if (p := parse_schema_name(db.name, pattern)) is not None:
            out.append({"schema": db.name, **p, "tables": sorted(t.name for t in spark.catalog.listTables(db.name))})
    return out
