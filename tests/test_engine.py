"""Types, stores, strategies, snapshots, quality, comparison, projects, files and streams."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import types as mt
from millrace.operators import compare as cmp
from millrace.operators import materialize as mat
from millrace.operators import quality as q
from millrace.operators.joins import asof_join, range_join
from millrace.plans import project as pj
from millrace.sources import files
from millrace.store import TableStore
from millrace.streaming import stream

D = T.DecimalType


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        (T.IntegerType(), T.LongType(), T.LongType()), (T.IntegerType(), T.FloatType(), T.DoubleType()), (T.FloatType(), T.DoubleType(), T.DoubleType()),
        (T.IntegerType(), D(5, 2), D(10, 2)), (T.LongType(), D(5, 2), D(19, 2)), (D(10, 2), D(8, 4), D(10, 4)), (T.TimestampType(), T.TimestampNTZType(), T.TimestampType()),
        (mt.Unknown(), T.DateType(), T.DateType()), (T.StringType(), T.LongType(), None), (T.BooleanType(), T.BooleanType(), T.BooleanType()),
    ],
)
def test_common_supertype(a, b, want):
    assert mt.common_supertype(a, b) == want == mt.common_supertype(b, a)


def test_assignable_and_names():
    assert mt.is_assignable(D(8, 2), D(10, 2)) and not mt.is_assignable(D(10, 2), D(10, 4)) and mt.is_assignable(T.IntegerType(), D(12, 2)) and not mt.is_assignable(T.LongType(), T.IntegerType())
    assert mt.parse_type("DECIMAL") == D(38, 0) and mt.parse_type("numeric(10, 2)") == D(10, 2) and mt.parse_type("VARCHAR(20)") == T.StringType() and isinstance(mt.parse_type("geography"), mt.Unknown)


def test_store_swaps_and_partitions(spark, tmp_path):
    st = TableStore(spark, str(tmp_path / "s"))
    with pytest.raises(KeyError):
        st.read("t")
    with pytest.raises(ValueError):
        st.replace("../t", spark.range(1))
    st.replace("t", spark.range(3))
    st.replace("t", st.read("t").filter("id > 0"))  # reads what it replaces
    assert rows(st.read("t")) == [(1,), (2,)]
    p = spark.createDataFrame([(1, "a"), (2, "b")], "x int, k string")
    st.replace_partitions("p", p, "k")
    st.replace_partitions("p", p.filter("false"), "k", ["a"])
    assert rows(st.read("p"), "x", "k") == [(2, "b")]
    st.append("p", spark.createDataFrame([("c", 3, 1)], "k string, x int, extra int"))
    assert st.exists("p") and not st.exists("q")
    st.put("a", {"b": 1})
    st.put("a", 2)
    assert st.get("a") == 2 and st.history("a") == [{"b": 1}, 2] and st.get("none", 5) == 5


def test_versions_are_whole_or_not_there(spark, tmp_path):
    root = tmp_path / "s"
    st = TableStore(spark, str(root))
    st.replace("t", spark.range(2))
    n, _ = st.version("t")
    (root / "t" / "_versions" / f"{n + 1:012d}.json").write_text('{"schema": {"ty')  # a writer died here
    assert st.version("t")[0] == n and st.read("t").count() == 2
    st.append("t", spark.range(5, 6))
    assert rows(st.read("t")) == [(0,), (1,), (5,)] and rows(st.read("t", n)) == [(0,), (1,)]
    from millrace.store import ConcurrentWrite

    with pytest.raises(ConcurrentWrite):
        st._commit(st._at("t", "_versions"), n, {})
    st.replace("t", spark.range(1))
    assert st.vacuum("t") == 2 and rows(st.read("t")) == [(0,)]
    st.replace("e", spark.range(0).withColumn("k", F.lit("a")), ["k"])
    assert st.read("e").count() == 0 and st.append("e", spark.range(1).withColumn("k", F.lit("x y/=z"))).count() == 1
    assert st.replace_partitions("e", st.read("e").limit(0), "k", ["x y/=z"]).count() == 0


def test_incremental_after_a_crash(spark, tmp_path, monkeypatch):
    st = TableStore(spark, str(tmp_path / "s"))
    src = spark.createDataFrame([(1, datetime(2024, 1, 1)), (2, datetime(2024, 1, 2))], "id int, ts timestamp")
    with monkeypatch.context() as m:
        m.setattr(TableStore, "_commit", lambda *a: (_ for _ in ()).throw(OSError("died")))
        with pytest.raises(OSError):
            mat.incremental(st, "t", src, "ts")
    assert not st.exists("t")
    for _ in range(2):
        assert rows(mat.incremental(st, "t", src, "ts"), "id") == [(1,), (2,)]


def test_time_interval_windows_of_several_periods(spark, tmp_path):
    st = TableStore(spark, str(tmp_path / "s"))
    src = spark.createDataFrame([(i, datetime(2024, 1, 1 + i % 3, i % 24)) for i in range(9)], "id int, ts timestamp")
    build = lambda d: lambda a, b: d.filter((F.col("ts") >= F.lit(a)) & (F.col("ts") < F.lit(b)))
    P = lambda **kw: mat.plan_periods("day", **kw)
    mat.time_interval(st, "t", build(src), "ts", P(first="2024-01-01", last="2024-01-04", batch=3), "day")
    mat.time_interval(st, "t", build(src), "ts", P(single="2024-01-02"), "day")
    assert rows(st.read("t"), "id") == [(i,) for i in range(9)] and rows(st.read("t").select("period").distinct()) == [("2024-01-01",), ("2024-01-02",), ("2024-01-03",)]
    # a period whose rows are gone is emptied
    mat.time_interval(st, "t", build(src.filter("day(ts) <> 2")), "ts", P(first="2024-01-01", last="2024-01-03", batch=2), "day")
    assert st.read("t").count() == 6


def test_content_named_files(spark, tmp_path):
    from millrace.sources.lakehouse import content_addressed

    st = TableStore(spark, str(tmp_path / "s"))
    df = spark.range(1000).withColumn("s", F.concat(F.lit("x"), F.col("id")))
    a, n = content_addressed(st, "t", df)
    assert n == 8 and a.count() == 1000 and content_addressed(st, "t", df.orderBy(F.rand()))[1] == 0
    b, n = content_addressed(st, "t", df.withColumn("s", F.when(F.col("id") == 5, "y").otherwise(F.col("s"))))
    assert 1 <= n <= 2 and b.filter("s = 'y'").count() == 1 and len(list((tmp_path / "s" / "t" / "content").glob("*.parquet"))) == 8 + n


def test_incremental_takes_strictly_later(spark, tmp_path):
    st = TableStore(spark, str(tmp_path / "s"))
    src = spark.createDataFrame([(1, datetime(2024, 1, 1)), (2, datetime(2024, 1, 2)), (3, None)], "id int, ts timestamp")
    mat.incremental(st, "t", src, "ts")
    more = src.unionByName(spark.createDataFrame([(4, datetime(2024, 1, 2)), (5, datetime(2024, 1, 3))], "id int, ts timestamp"))
    assert rows(mat.incremental(st, "t", more, "ts"), "id") == [(1,), (2,), (5,)]  # an equal stamp isn't later
    assert rows(mat.incremental(st, "t", more.limit(0), "ts"), "id") == [(1,), (2,), (5,)]


def test_merge_and_snapshot_are_idempotent(spark):
    a = spark.createDataFrame([(1, "a", None), (2, "b", 2)], "k int, s string, v int")
    b = spark.createDataFrame([(2, "B", 9), (3, None, 3)], "k int, s string, v int")
    m = mat.merged(a, b, ["k"])
    assert rows(m) == rows(mat.merged(m, b, ["k"])) == [(1, "a", None), (2, "B", 9), (3, None, 3)]
    assert rows(mat.merged(a, b, ["k"], ["v"])) == [(1, "a", None), (2, "b", 9), (3, None, 3)]
    with pytest.raises(ValueError):
        mat.merged(a, b, [])
    s = mat.Snapshot(("k",), check=("s", "v"), hard_deletes=True)
    h = s.run(s.first(a, "2024-01-01"), b, "2024-01-02")
    again = s.run(h, b, "2024-01-03")
    assert rows(h) == rows(again) and h.count() == 4
    back = s.run(h, a.unionByName(b.filter("k = 3")), "2024-01-04").filter("is_current")
    assert rows(back, "k") == [(1,), (2,), (3,)]


def test_periods():
    P = mat.plan_periods
    d = lambda *a: datetime(*a)
    assert P("month", first="2023-12", last="2024-01") == [(d(2023, 12, 1), d(2024, 1, 1)), (d(2024, 1, 1), d(2024, 2, 1))]
    assert P("day", single="2024-02-29", lookback=2)[0][0] == d(2024, 2, 27)
    assert P("day", first="2024-01-01", last="2024-01-05", batch=2) == [(d(2024, 1, 1), d(2024, 1, 3)), (d(2024, 1, 3), d(2024, 1, 5)), (d(2024, 1, 5), d(2024, 1, 6))]
    assert P("hour", latest=d(2024, 1, 1, 5, 30)) == [(d(2024, 1, 1, 4), d(2024, 1, 1, 5))]
    assert P("day", first="2024-01-01", last="2024-01-03", built={"2024-01-02"}) == [(d(2024, 1, 1), d(2024, 1, 2)), (d(2024, 1, 3), d(2024, 1, 4))]
    with pytest.raises(ValueError):
        mat.parse_key("2024-1-1", "day")


def test_rules_pass_nulls_and_filters(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, None, None), (2, "zz", 99)], "k int, s string, v int")
    R = q.Rule
    n = lambda r: r.failing(df).count()
    assert [n(R("not_null", "s")), n(R("unique", "k")), n(R("accepted_values", "s", values=("a",))), n(R("in_range", "v", high=10)), n(R("regex_match", "s", pattern="^[a-z]$")), n(R("expression", expression="v < 50"))] == [1] * 6
    assert n(R("not_null", "s", where="v > 0")) == 0 and n(R("in_range", "v", high=10, where="k = 1")) == 0
    assert n(R("aggregate", "v", op="max", cmp="<", value=10)) == 1 and n(R("row_count_range", low=1, high=3)) == 0 and n(R("row_count_range", low=4)) == 1
    with pytest.raises(ValueError):
        n(R("regex_match", "s", pattern="a'b"))
    good, bad = q.split(df, [R("not_null", "s"), R("in_range", "v", high=10), R("not_null", "s")])
    assert good.count() == 1 and bad.columns[-3:] == ["_error_not_null_s", "_error_in_range_v", "_error_not_null_s_2"]
    assert rows(q.run_rules(df, [R("not_null", "s"), R("unique", "k", severity="warning")]), "rule", "failures") == [("not_null_s", 1), ("unique_k", 1)]


def test_masks_anomalies_contracts(spark):
    df = spark.createDataFrame([("abcdef",), ("abcd",), (None,)], "s string")
    assert [r[0] for r in df.select(q.mask(F.col("s"), "partial")).collect()] == ["ab***ef", "***", None]
    assert [r[0] for r in df.select(q.mask(F.col("s"), "redact")).collect()] == ["***"] * 3
    assert not q.anomaly([], 5) and q.anomaly([0], 1) and not q.anomaly([10, 10], 14) and q.anomaly([10, 10], 16)
    assert q.health([1.0]) == 1 and q.health([6.0]) == 0 and q.health([4.0]) == 0.5
    C = q.ContractColumn
    s = T.StructType.fromDDL("a int, b string, c int not null")
    assert q.contract(s, [C("a", T.LongType()), C("b", T.IntegerType()), C("d"), C("A", nullable=False)], ("e",), T.StructType.fromDDL("e int"), True) == ["E011 b: string is not int", "E010 d", "E012 A", "E013 e", "W010 c"]


def test_profile_from_sketches(spark):
    df = spark.range(5000).withColumn("g", F.col("id") % 7)
    a, b = ({r["column_name"]: r for r in q.profile(df, exact=e).collect()} for e in (True, False))
    assert a["id"]["distinct_values"] == 5000 and abs(b["id"]["distinct_values"] - 5000) < 400 and a["g"] == b["g"]


def test_compare(spark):
    a = spark.createDataFrame([(i, f"v{i}", i * 7) for i in range(2000)] + [(None, "n", 0)], "id int, s string, v int")
    b = a.filter("id is null or id <> 5").withColumn("s", F.when(F.col("id") == 1000, None).otherwise(F.col("s"))).unionByName(spark.createDataFrame([(5000, "x", 1)], a.schema))
    want = [(1000, "changed"), (5, "removed"), (5000, "added")]
    assert rows(cmp.row_diff(a, b, "id")) == want == rows(cmp.chunked_diff(a, b, "id")) == rows(cmp.chunked_diff(a, b, "id", 10))
    assert rows(cmp.samples(cmp.row_diff(a, b, "id"), "id")) == [("added", 1, [5000]), ("changed", 1, [1000]), ("removed", 1, [5])]
    assert rows(a.select(cmp.chunk_of("id", 10, 20, 2).alias("c")).distinct()) == sorted([(-1,), (0,), (1,), (2,), (None,)], key=str)
    assert cmp.split_range(0, 10, 3) == [(0, 3), (3, 6), (6, 11)] and cmp.split_range(0, 1, 5) == [(0, 2)]
    x = spark.createDataFrame([("p", 1), ("p", 1), ("q", 2)], "k string, v int")
    y = spark.createDataFrame([("p", 1), ("q", 2), ("r", 3)], "k string, v int")
    assert rows(cmp.changed_partitions(cmp.partition_checksums(x, F.col("k")), cmp.partition_checksums(y, F.col("k")))) == [("p", "changed"), ("q", "unchanged"), ("r", "changed")]
    assert cmp.schema_diff(T.StructType.fromDDL("a int, b int, c int"), T.StructType.fromDDL("c int, a bigint, d int")) == ["removed b", "added d", "type a: int to bigint", "order"]
    drift = cmp.detect_drift(T.StructType.fromDDL("a bigint, b string, n int"), T.StructType.fromDDL("A int, b string, old int"))
    assert (drift.action, drift.added, drift.widened, drift.gone) == ("evolve", ("n",), ("a",), ("old",))
    assert cmp.detect_drift(T.StructType.fromDDL("a date"), T.StructType.fromDDL("a int")).action == "recreate"
    assert cmp.grace({"x": "2024-01-01"}, ("x", "y"), (), "2024-01-08", 7) == ({"y": "2024-01-08"}, ["y"], ["x"])
    assert cmp.grace({"x": "2024-01-01"}, (), ("x",), "2024-01-08", 7) == ({}, [], [])


def test_joins_equal_brute_force(spark):
    import random

    rng = random.Random(2)
    left = [(i, rng.choice("ab"), rng.randrange(-500, 500)) for i in range(120)]
    right = [(rng.choice("ab"), rng.randrange(-500, 500), j) for j in range(90)]
    ldf, rdf = spark.createDataFrame(left, "i int, k string, t long"), spark.createDataFrame(right, "k string, u long, j int")
    got = rows(range_join(ldf, rdf, "t", "u", -30, 10, ["k"]), "i", "j")
    assert got == sorted(((i, j) for i, k, t in left for k2, u, j in right if k == k2 and t - 30 <= u <= t + 10), key=str)
    once = {(k, u): j for k, u, j in right}
    r2 = spark.createDataFrame([(k, u, j) for (k, u), j in once.items()], "k string, t long, j int")
    want = []
    for i, k, t in left:
        before = [u for (k2, u) in once if k2 == k and u <= t]
        want.append((i, once[k, max(before)] if before else None))
    for span in (7, 100, 10_000):
        assert rows(asof_join(ldf, r2, "t", ["k"], ["j"], span), "i", "j") == sorted(want, key=str)


def test_project(spark, tmp_path):
    assert pj.layers({"c": {"a", "b"}, "b": {"a"}, "a": set(), "z": set()}) == [["a", "z"], ["b"], ["c"]]
    with pytest.raises(pj.CycleError):
        pj.topo({"a": {"b"}, "b": {"a"}})
    spark.range(10).selectExpr("id", "id % 3 AS g").write.parquet(str(tmp_path / "src"))
    src = spark.read.parquet(str(tmp_path / "src"))
    M = pj.Model
    p = pj.Project([M("stg_x", "SELECT id, g FROM src_x WHERE id > @var(least, 1)"), M("sum_x", "from stg_x group g { n: count() }", language="dsl"), M("bad", "SELECT nope FROM stg_x"), M("after_bad", "SELECT * FROM bad")], {"src_x": src})
    frames, problems = p.compile(spark)
    assert set(frames) == {"stg_x", "sum_x"} == set(p.frames(spark)) and [x.split()[:2] for x in problems] == [["E001", "bad:"], ["E001", "after_bad:"]]
    st = TableStore(spark, str(tmp_path / "store"))
    assert p.run(spark, st, skip_unchanged=True) == {"stg_x": "built", "bad": "failed", "sum_x": "built", "after_bad": "skipped"}
    again = p.run(spark, st, skip_unchanged=True)
    assert again["stg_x"] == "unchanged" and again.reasons["stg_x"] == "inputs unchanged" and "nope" in again.errors["bad"]
    assert [r["states"]["bad"] for r in st.history("_runs")] == ["failed", "failed"]
    assert p.run(spark, st, {"least": "5"}, skip_unchanged=True)["stg_x"] == "built"
    assert pj.star_blast_radius(p) == ["P002 after_bad"]
    lin = pj.lineage(spark.sql("SELECT g, CAST(id AS STRING) AS c, id + g AS e FROM (SELECT id, g FROM {t})", t=src))
    assert lin == {"g": {("g", "direct")}, "c": {("id", "cast")}, "e": {("id", "expression"), ("g", "expression")}}
    assert pj.lineage(src.groupBy("g").agg(F.sum("id").alias("s")))["s"] == {("id", "aggregation")}
    assert pj.consumed_columns(src.select("g")) == {"g"}
    assert pj.is_deterministic(src) and not pj.is_deterministic(src.withColumn("r", F.rand()))
    assert pj.propagate({"a": {"x"}}, {"b": {"a": {"x"}}, "c": {"a": {"y"}}, "d": {"b": {"z"}}}) == {"b", "d"}
    assert pj.breaking_changes(src, src.selectExpr("CAST(id AS INT) AS id", "1 AS n")) == ["E030 g", "W030 n", "E031 id"]
    assert pj.recommend(10, True, True, 0.1) == "full_refresh" and pj.recommend(10**7, True, False, 0.1) == "incremental"
    ok, _ = pj.unit_test(spark.sql("SELECT 1 AS a, 2 AS b"), spark.sql("SELECT 1 AS a"))
    assert ok and not pj.unit_test(spark.sql("SELECT 1 AS a UNION ALL SELECT 1"), spark.sql("SELECT 1 AS a"))[0]


def test_files(spark, tmp_path):
    f = tmp_path / "s.csv"
    f.write_text('id,name,ok,x,at,empty\n1,"a,b",true,1,2024-01-01 10:00:00,\n2,"say ""hi""",false,2.5,2024-01-02 00:00:00,\n')
    df = files.seed(spark, str(f))
    assert [t for _, t in df.dtypes] == ["bigint", "string", "boolean", "double", "timestamp", "string"]
    assert [r["name"] for r in df.collect()] == ["a,b", 'say "hi"']
    assert files.seed(spark, str(f), {"id": "string"}).dtypes[0] == ("id", "string")
    g = tmp_path / "late.csv"
    g.write_text("n,m\n" + "1,1\n" * 3000 + "x,2.5\n")
    assert [t for _, t in files.seed(spark, str(g)).dtypes] == ["string", "double"] and files.seed(spark, str(g)).count() == 3001
    with pytest.raises(Exception, match="n is no bigint: x"):
        files.seed(spark, str(g), {"n": "bigint"}).collect()
    with pytest.raises(ValueError):
        files.load(spark, "../x.csv")
    with pytest.raises(ValueError):
        files.format_of("x.xlsx")
    assert files.parse_schema_name("src__acme__eu__west__shop", "src__{tenant}__{regions...}__{source}") == {"tenant": "acme", "regions": ["eu", "west"], "source": "shop"}
    assert files.parse_schema_name("other", "src__{tenant}") is None


def test_stream_takes_only_new_files(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(5).coalesce(1).write.parquet(src)
    run = lambda: stream.microbatch(spark, src, "id long", lambda d: d.filter("id % 2 = 0"), out, str(tmp_path / "cp")).count()
    assert run() == 3 and run() == 3
    spark.range(10, 15).coalesce(1).write.mode("append").parquet(src)
    assert run() == 6


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 10
