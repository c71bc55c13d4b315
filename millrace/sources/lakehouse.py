"""DDL of lakehouse tables, and parquet tables whose folder is named by their content."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.compare import row_hash
from ..store import _NAME, TableStore


def ddl(name: str, schema: T.StructType, fmt: str = "delta", partition_by: list[str] | None = None, cluster_by: list[str] | None = None, properties: dict[str, str] | None = None, replace: bool = True) -> str:
    """CREATE TABLE for Delta, Iceberg or parquet. Partitioning and clustering exclude each other."""
    if fmt not in ("delta", "iceberg", "parquet"):
        raise ValueError(f"no such format: {fmt!r}")
    if not _NAME.match(name):
        raise ValueError(f"not a table name: {name!r}")
    if partition_by and cluster_by:
        raise ValueError("a table is partitioned or clustered")
    known = {f.name for f in schema}
    if missing := {*(partition_by or []), *(cluster_by or [])} - known:
        raise ValueError(f"no such columns: {sorted(missing)}")
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in schema)
    out = f"CREATE {'OR REPLACE ' if replace and fmt != 'parquet' else ''}TABLE {name} ({cols}) USING {fmt}"
    if partition_by:
        out += f" PARTITIONED BY ({', '.join(f'`{c}`' for c in partition_by)})"
    if cluster_by:
        out += f" CLUSTER BY ({', '.join(f'`{c}`' for c in cluster_by)})"
    if properties:
        out += " TBLPROPERTIES (" + ", ".join(f"'{k}' = '{v}'" for k, v in sorted(properties.items())) + ")"
    return out


def content_hash(df: DataFrame) -> str:
    """A hash of rows and schema that does not depend on the order of rows."""
    h = row_hash(df.columns)
    r = df.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first()
    return hashlib.sha256(f"{json.dumps(df.schema.jsonValue(), sort_keys=True)}|{r[0]}|{r[1]}|{r[2]}".encode()).hexdigest()


def content_addressed(store: TableStore, table: str, df: DataFrame, buckets: int = 8) -> tuple[DataFrame, int]:
    """(table, files written): a version made of files that are named by the hash of their content.

    Rows are spread over ``buckets`` files by their hash and sorted, so equal rows give equal files; a file whose name is there
    already is not kept twice, and versions share what they have in common. The version files are the table's log. Rows are
    computed and written once; the hashes are read from the written files, in parallel.
    """
    spark = df.sparkSession
    bucket = F.pmod(row_hash(df.columns), F.lit(buckets))
    order = [F.col(f"`{c}`").cast("string") if isinstance(f.dataType, T.MapType) else F.col(f"`{c}`") for c, f in zip(df.columns, df.schema)]
    staged = store._at(table, f"staged-{uuid.uuid4().hex}")
    spread = df.withColumn("__b", bucket).repartition(buckets, "__b").sortWithinPartitions("__b", *order)
    spread.write.partitionBy("__b").parquet(staged)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(staged).select("path", F.sha2("content", 256).alias("h")).collect()
    names, new = [], 0
    for r in sorted(found, key=lambda r: r.h):  # one row per file
        to = store._path(store._at(table, "content", f"{r.h}.parquet"))
        if not store._fs.exists(to):
            store._fs.mkdirs(to.getParent())
            store._fs.rename(store._path(r.path), to)
            new += 1
        names.append(f"content/{r.h}.parquet")
    store._fs.delete(store._path(staged), True)
    _, old = store.version(table)
    if old and old["dirs"] == names and old["schema"] == df.schema.jsonValue():
        return store.read(table), 0
    return store.commit_files(table, df.schema, names), new
