"""Projects: dependencies, typed compile, strategies, skip gate, lineage graph, shadows."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.plans import dsl, infer
from millrace.plans import project as pj
from millrace.store import TableStore
from millrace.types import Unknown

M = pj.Model


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "store"))


@pytest.fixture
def src(spark):
    return spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, "a", 30)], "id int, k string, v int")


def test_dependencies_are_relations_not_words(spark, src):
    p = pj.Project([
        M("k", "SELECT v AS big FROM src"), M("big", "SELECT k, 'from v' AS v FROM src -- FROM k"), M("v", "from src derive { big: v + 1 } select { k, big }", language="dsl"),
        M("both", "WITH k AS (SELECT * FROM src) SELECT big.k FROM big WHERE k IN (SELECT k FROM v) AND EXISTS (SELECT 1 FROM k)"),
    ], {"src": src})
    assert p.dependencies(spark) == {"k": set(), "big": set(), "v": set(), "both": {"big", "v"}}
    assert p.reads("v") == {"src"} and pj.topo(p.dependencies(spark))


def test_types_from_trees_equal_sparks(spark):
    from millrace.queries import language
    from millrace.session import table

    d, seen = "/root/testdata/sf0.001", 0
    schema = lambda n: {f.name: f.dataType for f in table(spark, d, n).schema}
    for text in language.TEXTS:
        got, want = infer.schema_of(dsl.parse(text), schema), dsl.run(text, lambda t: table(spark, d, t)).schema
        assert list(got) == list(dict.fromkeys(want.names)), text
        for f in want:
            if not isinstance(got[f.name], Unknown) and want.names.count(f.name) == 1:
                assert got[f.name] == f.dataType, (text, f)
                seen += 1
    assert seen > 60


def test_compile_without_running(spark, src):
    p = pj.Project([
        M("a", "from src where id > 1 derive { w: v * 2, s: upper(k) }", language="dsl"), M("b", "SELECT k, sum(w) AS w, max(s) AS s FROM a GROUP BY k"),
        M("c", "from b join a on k { keep b.k, a.id, b.w } where b.w > 1", language="dsl"), M("x", "from a select { nope }", language="dsl"), M("y", "from x take 1", language="dsl"), M("z", "from ( bad", language="dsl"),
    ], {"src": src})
    schemas, problems = p.compile(spark)
    assert {n: [(f.name, f.dataType.simpleString()) for f in s] for n, s in schemas.items()} == {
        "a": [("id", "int"), ("k", "string"), ("v", "int"), ("w", "int"), ("s", "string")], "b": [("k", "string"), ("w", "bigint"), ("s", "string")], "c": [("k", "string"), ("id", "int"), ("w", "bigint")],
    }
    assert [x.split(":")[0] for x in sorted(problems)] == ["E001 x", "E001 y", "E001 z"]
    assert {n: f.schema.names for n, f in p.frames(spark).items()} == {n: s.names for n, s in schemas.items()}


def test_views_of_the_session_stay(spark, src, store):
    spark.range(7).createOrReplaceTempView("src")
    assert pj.Project([M("m", "SELECT max(v) AS v FROM src")], {"src": src}).run(spark, store) == {"m": "built"}
    assert spark.table("src").count() == 7 and rows(store.read("m")) == [(30,)]
    spark.catalog.dropTempView("src")


def test_strategies_by_name(spark, store):
    ev = spark.createDataFrame([(i, datetime(2024, 1, 1 + i % 4, i)) for i in range(12)], "id int, ts timestamp")
    text = "SELECT id, ts FROM ev WHERE ts >= @start_date AND ts < @end_date"
    opts = {"time_column": "ts", "grain": "day"}
    ms = lambda **o: [M("t", text, strategy="time_interval", options={**opts, **o}), M("n", "SELECT count(*) AS n FROM t"), M("once", "SELECT 1 AS x", strategy="bootstrap"), M("ca", "SELECT id FROM ev", strategy="content_addressed")]
    p = pj.Project(ms(), {"ev": ev})
    assert set(p.run(spark, store).values()) == {"built"} and rows(store.read("n")) == [(0,)]
    r = pj.Project(ms(first="2024-01-01", last="2024-01-04", batch=3), {"ev": ev}).run(spark, store)
    assert r["once"] == "failed" and "there already" in r.errors["once"] and rows(store.read("n")) == [(12,)] and store.read("ca").count() == 12
    for _ in range(2):
        assert pj.Project(ms(single="2024-01-03", lookback=1), {"ev": ev}).run(spark, store)["t"] == "built" and store.read("t").count() == 12
    assert pj.Project([M("t", "SELECT 1", strategy="nothing")]).run(spark, store).errors["t"].startswith("ValueError: unknown strategy")


def test_skip_gate(spark, store, tmp_path, src):
    path = str(tmp_path / "src")
    src.write.parquet(path)
    read = lambda: spark.read.schema(src.schema).parquet(path)
    ms = [M("a", "SELECT id, k, v FROM src"), M("b", "SELECT k, count(*) AS n FROM a GROUP BY k", options={"column_skip": True}), M("c", "SELECT sum(v) AS v FROM a", options={"column_skip": True}), M("r", "SELECT k, rand() AS x FROM a", options={"column_skip": True})]
    go = lambda **kw: pj.Project(ms, {"src": read()}).run(spark, store, skip_unchanged=True, **kw)
    assert set(go().values()) == {"built"}
    r = go()
    assert set(r.values()) == {"unchanged"} and r.reasons["b"] == "inputs unchanged"
    assert set(go(environment={"engine": "2"}).values()) == {"built"} and go(environment={"engine": "2"})["a"] == "unchanged"
    # only v changes: what doesn't consume it stays, unless it isn't deterministic
    src.withColumn("v", F.col("v") + 1).write.mode("overwrite").parquet(path)
    r = go(environment={"engine": "2"})
    assert (r["a"], r["b"], r["c"], r["r"]) == ("built", "unchanged", "built", "built") and r.reasons["b"] == "consumed columns unchanged"
    assert rows(store.read("c")) == [(63,)]
    # another row: everything
    src.unionByName(src.limit(1)).write.mode("overwrite").parquet(path)
    assert set(go(environment={"engine": "2"}).values()) == {"built"}


def test_evidence_of_a_source(spark, store, src):
    m = [M("a", "SELECT max(v) AS v FROM src", options={"evidence": "id"})]
    go = lambda df: pj.Project(m, {"src": df}).run(spark, store, skip_unchanged=True)["a"]
    df = src.unionByName(spark.createDataFrame([(9, "z", 1)], src.schema))
    assert [go(src), go(src), go(df), go(df)] == ["built", "unchanged", "built", "unchanged"]
    assert set(pj.prune_unchanged(store, {"s": src, "d": df}, "id")) == {"s", "d"} and set(pj.prune_unchanged(store, {"s": df, "d": df}, "id")) == {"s"}


def test_semantic_graph(spark, src):
    p = pj.Project([
        M("stg", "SELECT id, k, CAST(v AS STRING) AS s, try_cast(k AS INT) AS t FROM src"), M("agg", "from stg group k { n: count(), last: max(s) }", language="dsl"),
        M("mart", "SELECT a.k, a.n * 2 AS n2, b.id FROM agg a JOIN stg b ON a.k = b.k"), M("self", "SELECT x.id, y.s FROM stg x JOIN stg y ON x.id = y.id"), M("ex", "SELECT explode(array(id, v)) AS e FROM src"),
        M("cube", "SELECT k, sum(v) AS v FROM src GROUP BY CUBE (k)"), M("bad", "SELECT nope FROM src"),
    ], {"src": src})
    g = pj.SemanticGraph(p, spark)
    assert set(g.incomplete) == {"bad"}
    assert g.edges["stg", "s"] == {("src", "v", "cast")} and g.edges["stg", "t"] == {("src", "k", "try_cast")} and g.edges["agg", "last"] == {("stg", "s", "aggregation")}
    assert g.up("mart", "n2") == set() or g.up("mart", "n2") == {("agg", "n")}
    assert g.up("agg", "last") == {("stg", "s"), ("src", "v")} and ("agg", "last") in g.down("src", "v") and ("self", "s") in g.down("src", "v")
    assert g.edges["ex", "e"] == {("src", "id", "expression"), ("src", "v", "expression")} and g.edges["cube", "k"] and g.edges["cube", "v"] == {("src", "v", "aggregation")}
    assert g.consumers("stg")["id"] == {"mart", "self"} and g.consumers("agg")["n"] == {"mart"}


def test_shadow_tables_and_overrides(spark, store, src):
    ms = [M("a", "SELECT id, k FROM src"), M("b", "SELECT count(*) AS n FROM a")]
    pj.Project(ms, {"src": src}).run(spark, store)
    p = pj.Project(ms, {"src": src.limit(1)}, {"b": {"text": "SELECT count(*) AS n, 1 AS one FROM a"}})
    assert set(p.run(spark, store, suffix="__shadow").values()) == {"built"} and rows(store.read("b")) == [(3,)] and rows(store.read("b__shadow")) == [(1, 1)]
    d = p.compare_shadow(store, "__shadow")
    assert (d["a"]["left_rows"], d["a"]["right_rows"], d["a"]["verdict"]) == (3, 1, "fail") and d["b"]["schema"] == ["added one"]


def test_breaking_config():
    old = M("m", strategy="merge", keys=("a",), options={"grain": "day", "lag": 1})
    assert pj.breaking_config(old, old) == []
    assert pj.breaking_config(old, M("m", strategy="append", keys=("b",), stamp="t", options={"grain": "hour", "lag": 2})) == ["E033 merge to append", "E034 keys", "E035 stamp", "E036 grain", "W033 lag"]


def test_star_outside_of_count(spark, src):
    p = pj.Project([M("a", "SELECT id FROM src"), M("b", "SELECT count(*) AS n, 2 * 3 AS m FROM a"), M("c", "SELECT a.* FROM a"), M("d", "SELECT 'SELECT *' AS s FROM a")], {"src": src})
    assert pj.star_blast_radius(p) == ["P002 c"]


def test_infer_unknown_names():
    s = {"a": T.IntegerType()}
    for bad in ("from t select { b }", "from t where z > 1", "from t join t as u on q", "from t group a { n: count() } where b > 1"):
        with pytest.raises(infer.UnknownName):
            infer.schema_of(dsl.parse(bad), lambda n: s)
