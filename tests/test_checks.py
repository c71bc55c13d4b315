"""Compile-time checks and lakehouse tables."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import types as T

from millrace.plans import checks
from millrace.plans.project import Model
from millrace.sources import lakehouse
from millrace.store import TableStore

S = T.StructType.fromDDL


def test_join_keys(spark):
    f = {"a": spark.sql("SELECT 1 AS k, 'x' AS s, 1 AS n"), "b": spark.sql("SELECT 1L AS k, 1 AS s, 1 AS n")}
    assert checks.join_keys(f, {"m": {"a", "b"}, "n": {"a"}}) == ["W001 m: k is int in a and bigint in b", "E001 m: s is string in a and int in b"]


def test_time_interval():
    m = lambda text="@start_date @end_date", **o: Model("m", text, strategy="time_interval", options=o)
    assert checks.time_interval(m(), S("d date not null")) == ["E020 m"]
    assert checks.time_interval(m(time_column="x"), S("d date")) == ["E021 m: x"]
    assert checks.time_interval(m("", time_column="d"), S("d date not null")) == []
    assert checks.time_interval(m("SELECT 1", time_column="d", grain="hour", first_period="2024-1-1"), S("d date")) == ["E023 m: d", "E024 m", "E025 m: d", "E026 m: 2024-1-1"]
    assert checks.time_interval(m(time_column="d"), S("d int not null")) == ["E022 m: d is int"]
    assert checks.fill_interval("t >= @start_date AND t < @end_date", datetime(2024, 1, 1), datetime(2024, 1, 2)) == "t >= TIMESTAMP '2024-01-01 00:00:00' AND t < TIMESTAMP '2024-01-02 00:00:00'"


def test_cost_and_declarations(spark):
    est, over = checks.cost([("f", "filter", ["a"]), ("j", "inner", ["f", "b"]), ("x", "cross", ["a", "b"]), ("g", "aggregate", ["a"])], {"a": 100.0, "b": 50.0}, 1000)
    assert est["f"] == 80 and est["j"] == 50 and est["g"] == 10 and over == ["E027 x"]
    assert checks.explain_estimate(spark.range(10))["rows"] == 10
    ms = [Model("a", strategy="merge", keys=("nope",), options={"tags": {"s": "pii"}}), Model("b", strategy="incremental")]
    assert checks.declarations(ms, lambda n: S("k int, s string")) == ["W004 a: s", "W006 a", "W005 b"]


def test_lakehouse(spark, tmp_path):
    s = S("a int not null, b string")
    assert lakehouse.ddl("c.t", s, partition_by=["b"], properties={"x": "1"}) == "CREATE OR REPLACE TABLE c.t (`a` int NOT NULL, `b` string) USING delta PARTITIONED BY (`b`) TBLPROPERTIES ('x' = '1')"
    for bad in (dict(fmt="csv"), dict(partition_by=["a"], cluster_by=["b"]), dict(cluster_by=["z"])):
        with pytest.raises(ValueError):
            lakehouse.ddl("t", s, **bad)
    with pytest.raises(ValueError):
        lakehouse.ddl("t; drop", s)
    st, df = TableStore(spark, str(tmp_path / "s")), spark.range(100)
    assert lakehouse.content_addressed(st, "t", df)[1] and not lakehouse.content_addressed(st, "t", df.orderBy("id", ascending=False))[1]
    assert lakehouse.content_addressed(st, "t", df.unionByName(df.limit(1)))[1]
