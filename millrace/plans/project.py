"""Projects of models: dependencies, layers, a runner, skipping of unchanged models, lineage and diagnostics."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import nullcontext
from dataclasses import dataclass, field, replace
from datetime import datetime
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import compare as cmp
from ..operators import materialize as mat
from ..sources.lakehouse import content_addressed
from ..store import TableStore
from ..types import Unknown
from . import dsl, infer, sqlcompat


@dataclass(frozen=True)
class Model:
    """A model's text is SQL or, with ``language='dsl'``, a pipeline; or it is a function of a table lookup."""

    name: str
    text: str | None = None
    build: Callable[[Callable[[str], DataFrame]], DataFrame] | None = None
    language: str = "sql"
    strategy: str = "full_refresh"
    keys: tuple[str, ...] = ()
    stamp: str | None = None
    needs: tuple[str, ...] = ()
    options: dict = field(default_factory=dict)


class CycleError(ValueError):
    pass


def topo(deps: dict[str, set[str]]) -> list[str]:
    """Names in dependency order, alphabetical among those that are ready."""
    left = {n: {d for d in ds if d in deps} for n, ds in deps.items()}
    users: dict[str, list[str]] = {}
    for n, ds in left.items():
        for d in ds:
            users.setdefault(d, []).append(n)
    count = {n: len(ds) for n, ds in left.items()}
    ready = [n for n, c in count.items() if not c]
    heapq.heapify(ready)
    out = []
    while ready:
        n = heapq.heappop(ready)
        out.append(n)
        for u in users.get(n, ()):
            count[u] -= 1
            if not count[u]:
                heapq.heappush(ready, u)
    if len(out) < len(deps):
        raise CycleError("models depend on each other: " + ", ".join(sorted(set(deps) - set(out))))
    return out


def layers(deps: dict[str, set[str]]) -> list[list[str]]:
    """Models that can be built at once: one layer beyond the last of what they need."""
    at: dict[str, int] = {}
    for n in topo(deps):
        at[n] = 1 + max((at[d] for d in deps[n] if d in deps), default=-1)
    return [sorted(n for n, k in at.items() if k == i) for i in range(max(at.values(), default=-1) + 1)]


class Run(dict):
    """{model: built | unchanged | failed | skipped}; ``errors`` has what failed, ``reasons`` why a model was built or left."""

    def __init__(self) -> None:
        super().__init__()
        self.errors: dict[str, str] = {}
        self.reasons: dict[str, str] = {}


#: Names of a session's views are shared, so a SQL text is resolved under this lock; plans run without it.
_VIEWS = threading.RLock()
_NO_ROWS: dict[int, object] = {}


class Views:
    """Temporary views while texts are resolved; views of these names that were there before are put back in the end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.there, self.before = spark, set(), {}

    def __enter__(self) -> Views:
        _VIEWS.acquire()
        return self

    def add(self, name: str, table: Callable[[str], DataFrame]) -> None:
        if name in self.there:
            return
        df = table(name)
        if self.spark._jsparkSession.sessionState().catalog().getTempView(name).isDefined():
            self.before[name] = self.spark.table(name)
        df.createOrReplaceTempView(name)
        self.there.add(name)

    def __exit__(self, *_: object) -> None:
        try:
            for n in self.there:
                self.spark.catalog.dropTempView(n)
            for n, df in self.before.items():
                df.createOrReplaceTempView(n)
        finally:
            _VIEWS.release()


def empty(spark: SparkSession, schema: T.StructType | DataFrame) -> DataFrame:
    """A table of this schema without rows, made on the JVM's side."""
    j = schema._jdf.schema() if isinstance(schema, DataFrame) else spark._jsparkSession.parseDataType(schema.json())
    if id(spark._jvm) not in _NO_ROWS:
        _NO_ROWS[id(spark._jvm)] = spark._jvm.java.util.ArrayList()
    return DataFrame(spark._jsparkSession.createDataFrame(_NO_ROWS[id(spark._jvm)], j), spark)


def relations(spark: SparkSession, text: str, values: dict[str, str] | None = None) -> set[str]:
    """Tables that a SQL text reads, from Spark's parse of it."""
    try:
        tree = spark._jsparkSession.sessionState().sqlParser().parsePlan(sqlcompat.rewrite(text, values)).toString()
    except Exception:  # noqa: BLE001 -- not parsable yet: the words after FROM and JOIN
        return {m[1] for m in re.finditer(r"\b(?:FROM|JOIN)\s+([A-Za-z_][\w.]*)", sqlcompat._MASK.sub("", text), re.I)}
    own = {n.strip() for m in re.finditer(r"CTE \[([^\]]*)\]", tree) for n in m[1].split(",")}
    return {".".join(p.strip() for p in m[1].split(",")) for m in re.finditer(r"'UnresolvedRelation \[([^\]]*)\]", tree)} - own


class Project:
    """Models and the sources they read. ``overrides`` changes fields of the models whose names match a pattern, in turn."""

    def __init__(self, models: list[Model], sources: dict[str, DataFrame] | None = None, overrides: dict[str, dict] | None = None):
        for pattern, changes in (overrides or {}).items():
            models = [replace(m, **changes) if fnmatch(m.name, pattern) else m for m in models]
        self.models = {m.name: m for m in models}
        self.sources = sources or {}
        self._trees: dict[str, dsl.Query] = {}
        self._reads: dict[tuple, set[str]] = {}

    def tree(self, name: str) -> dsl.Query:
        if name not in self._trees:
            self._trees[name] = dsl.parse(self.models[name].text)
        return self._trees[name]

    def reads(self, name: str, spark: SparkSession | None = None, values: dict[str, str] | None = None) -> set[str]:
        """Every table a model reads, whether a model or a source."""
        m, key = self.models[name], (name, repr(values))
        if key in self._reads:
            return self._reads[key]
        if m.build or not m.text:
            return set(m.needs)
        if m.language == "dsl":
            try:
                return infer.tables_of(self.tree(name)) | set(m.needs)
            except dsl.DslError:
                return set(m.needs)
        spark = spark or SparkSession.getActiveSession()
        if not spark:
            return set(m.needs)
        self._reads[key] = relations(spark, m.text, values) | set(m.needs)
        return self._reads[key]

    def dependencies(self, spark: SparkSession | None = None, values: dict[str, str] | None = None) -> dict[str, set[str]]:
        """The other models that each model reads or declares."""
        return {n: (self.reads(n, spark, values) & self.models.keys()) - {n} for n in self.models}

    def frame(self, spark: SparkSession, name: str, table: Callable[[str], DataFrame], values: dict[str, str] | None = None, views: Views | None = None) -> DataFrame:
        """The model's DataFrame over those of ``table``; ``views`` keeps what is registered for one text for the next."""
        m = self.models[name]
        if m.build:
            return m.build(table)
        if m.language == "dsl":
            return dsl.to_df(self.tree(name), table)
        with nullcontext(views) if views else Views(spark) as v:
            for d in sorted(self.reads(name, spark, values)):
                if d in self.models and d != name or d in self.sources:
                    v.add(d, table)
            return sqlcompat.run_sql(spark, m.text, values)

    def compile(self, spark: SparkSession, values: dict[str, str] | None = None) -> tuple[dict[str, T.StructType], list[str]]:
        """Schemas of all models, nothing run, and diagnostics of those that don't resolve.

        Models of the query language are typed from their trees. Others are analysed by Spark against empty tables with their upstreams'
        schemas, so that no plan contains another model's.
        """
        schemas: dict[str, infer.Schema] = {n: {f.name: f.dataType for f in df.schema} for n, df in self.sources.items()}
        out: dict[str, T.StructType] = {}
        problems: list[str] = []
        stubs: dict[str, DataFrame] = {}

        def schema(n: str) -> infer.Schema:
            if n not in schemas:
                raise KeyError(f"E001 no such table: {n}")
            return schemas[n]

        def stub(n: str) -> DataFrame:
            if n not in stubs:
                s = schema(n)
                if any(isinstance(t, Unknown) for t in s.values()):
                    stubs[n] = empty(spark, self.frame(spark, n, stub, values, views))  # its types are Spark's to say
                else:
                    stubs[n] = empty(spark, T.StructType([T.StructField(c, t) for c, t in s.items()]))
            return stubs[n]

        with Views(spark) as views:
            for n in topo(self.dependencies(spark, values)):
                m = self.models[n]
                try:
                    if m.language == "dsl" and not m.build:
                        schemas[n] = infer.schema_of(self.tree(n), schema)
                    else:
                        df = self.frame(spark, n, stub, values, views)
                        schemas[n], stubs[n] = {f.name: f.dataType for f in df.schema}, empty(spark, df)
                    out[n] = T.StructType([T.StructField(c, t) for c, t in schemas[n].items()])
                except Exception as e:  # noqa: BLE001
                    problems.append(f"{'E028' if isinstance(e, sqlcompat.MissingVariable) else 'E001'} {n}: {str(e).splitlines()[0][:200]}")
        return out, problems

    def frames(self, spark: SparkSession, values: dict[str, str] | None = None) -> dict[str, DataFrame]:
        """DataFrames of all models that resolve, each over the next."""
        done: dict[str, DataFrame] = {}
        with Views(spark) as views:
            for n in topo(self.dependencies(spark, values)):
                try:
                    done[n] = self.frame(spark, n, lambda t: done[t] if t in self.models else self.sources[t], values, views)
                    done[n].schema
                except Exception:  # noqa: BLE001 -- compile() tells why
                    done.pop(n, None)
        return done

    def run(self, spark: SparkSession, store: TableStore, values: dict[str, str] | None = None, threads: int = 4, skip_unchanged: bool = False, environment: dict[str, str] | None = None, suffix: str = "") -> Run:
        """Builds layer by layer; what depends on a failed model is skipped.

        ``suffix`` builds shadow tables beside the real ones: models read the shadows of what was built with them.
        """
        deps, state = self.dependencies(spark, values), Run()

        def table(n: str) -> DataFrame:
            if n in self.models:
                m = self.models[n]
                return self.frame(spark, n, table, values) if m.strategy in ("ephemeral", "view") else store.read(n + suffix)
            if n in self.sources:
                return self.sources[n]
            raise KeyError(f"E001 no such table: {n}")

        def one(n: str) -> str:
            if any(state[d] in ("failed", "skipped") for d in deps[n]):
                return "skipped"
            try:
                gate = SkipGate(self, store, spark, values, environment or {}, suffix) if skip_unchanged else None
                return self._build(spark, store, n, table, values, gate, state, suffix)
            except Exception as e:  # noqa: BLE001
                state.errors[n] = f"{type(e).__name__}: {e}"
                return "failed"

        with ThreadPoolExecutor(threads) as pool:
            for layer in layers(deps):
                state.update(zip(layer, pool.map(one, layer)))
        store.put("_runs", {"states": dict(state), "errors": state.errors, "reasons": state.reasons})
        return state

    def _build(self, spark: SparkSession, store: TableStore, n: str, table: Callable[[str], DataFrame], values: dict[str, str] | None, gate: SkipGate | None, state: Run, suffix: str) -> str:
        m, to = self.models[n], n + suffix
        if m.strategy in ("ephemeral", "view"):
            self.frame(spark, n, table, values)  # resolved with what reads it, and here to tell whether it can be
            return "built"
        if gate:
            skip, state.reasons[n] = gate.decide(n, table)
            if skip:
                return "unchanged"
        if m.strategy == "time_interval":
            self._intervals(spark, store, m, to, table, values)
        else:
            df = self.frame(spark, n, table, values)
            if m.strategy == "full_refresh":
                mat.full_refresh(store, to, df)
            elif m.strategy == "bootstrap":
                mat.bootstrap(store, to, df)
            elif m.strategy == "content_addressed":
                content_addressed(store, to, df)
            elif m.strategy in ("incremental", "microbatch"):
                mat.incremental(store, to, df, m.stamp) if m.stamp else store.append(to, df)
            elif m.strategy == "merge":
                mat.merge(store, to, df, list(m.keys), m.options.get("update"))
            elif m.strategy == "delete_insert":
                mat.delete_insert(store, to, df, list(m.keys))
            elif m.strategy in ("materialized_view", "dynamic_table"):
                store.replace(to, df)
            elif m.strategy == "snapshot":
                s = mat.Snapshot(m.keys, m.options.get("updated_at"), tuple(m.options.get("check", ())), m.options.get("hard_deletes", False))
                store.replace(to, s.run(store.read(to), df, m.options["run_ts"]) if store.exists(to) else s.first(df, m.options["run_ts"]))
            else:
                raise ValueError(f"unknown strategy {m.strategy!r}")
        if gate:
            gate.record(n, table)
        return "built"

    def _intervals(self, spark: SparkSession, store: TableStore, m: Model, to: str, table: Callable[[str], DataFrame], values: dict[str, str] | None) -> None:
        """A time-interval model: its text has ``@start_date`` and ``@end_date``; options name column, grain and periods."""
        from .checks import fill_interval

        o = m.options
        grain = o.get("grain", "day")

        def build(start: datetime, end: datetime) -> DataFrame:
            filled = Project([replace(m, text=fill_interval(m.text, start, end))], self.sources)
            filled.models = {**self.models, m.name: filled.models[m.name]}
            return filled.frame(spark, m.name, table, values)

        kw = {k: o[k] for k in ("single", "first", "last", "latest", "lookback", "batch") if k in o}
        if not kw:
            mat.time_interval_bootstrap(store, to, build, grain)
        else:
            mat.time_interval(store, to, build, o["time_column"], mat.plan_periods(grain, **kw), grain)

    def compare_shadow(self, store: TableStore, suffix: str) -> dict[str, dict]:
        """Per stored model: row counts of the real and the shadow table with their verdict, and the schemas' differences."""
        out = {}
        for n, m in self.models.items():
            if m.strategy not in ("ephemeral", "view") and store.exists(n) and store.exists(n + suffix):
                a, b = store.read(n), store.read(n + suffix)
                out[n] = {**cmp.row_counts(a, b).first().asDict(), "schema": cmp.schema_diff(a.schema, b.schema)}
        return out


@dataclass
class SkipGate:
    """Decides from evidence whether a model must be built; whatever isn't known means it must.

    A model is left as it is if its table is there, its recipe (text, strategy, keys, options, variables, environment) is the one
    it was built by and none of its inputs has changed. The evidence of a stored model is the number of its version, of a source
    the files it reads and, if ``options['evidence']`` of the model names a column, MAX of it and COUNT. If an input has changed, the model is still left
    if it is deterministic, all columns that it consumes of that input are known, and these columns' rows, as a multiset, are
    those it was built from.
    """

    project: Project
    store: TableStore
    spark: SparkSession
    values: dict[str, str] | None = None
    environment: dict[str, str] = field(default_factory=dict)
    suffix: str = ""

    def recipe(self, n: str) -> str:
        m = self.project.models[n]
        inlined = [self.recipe(d) for d in sorted(self.project.reads(n, self.spark, self.values)) if d in self.project.models and d != n and self.project.models[d].strategy in ("ephemeral", "view")]
        # functions have no text to compare: such a model is built every time
        text = m.text if not m.build else uuid.uuid4().hex
        parts = [text, m.language, m.strategy, list(m.keys), m.stamp, sorted((k, str(v)) for k, v in m.options.items()), sorted((self.values or {}).items()), sorted(self.environment.items()), inlined]
        return hashlib.sha256(json.dumps(parts, default=str).encode()).hexdigest()

    def inputs(self, n: str) -> set[str]:
        """Stored models and sources behind a model, through those that are inlined."""
        out: set[str] = set()
        for d in self.project.reads(n, self.spark, self.values) - {n}:
            m = self.project.models.get(d)
            out |= self.inputs(d) if m and m.strategy in ("ephemeral", "view") else {d}
        return out

    def evidence(self, n: str) -> dict[str, object]:
        out: dict[str, object] = {}
        for d in sorted(self.inputs(n)):
            if d in self.project.models:
                out[d] = self.store.version(d + self.suffix)[0]
            elif d in self.project.sources:
                df = self.project.sources[d]
                out[d] = {"files": sorted(df.inputFiles()), "plan": str(df.semanticHash())}
                column = self.project.models[n].options.get("evidence")
                if column and column in df.columns:
                    r = df.agg(F.max(column).cast("string"), F.count(F.lit(1))).first()
                    out[d] = {"plan": out[d]["plan"], "max": r[0], "count": r[1]}
                elif not out[d]["files"]:
                    out[d] = uuid.uuid4().hex  # nothing to tell by
            else:
                out[d] = uuid.uuid4().hex
        return json.loads(json.dumps(out, default=str))

    def columns(self, n: str, table: Callable[[str], DataFrame]) -> dict[str, list]:
        """{input: [consumed columns, checksum of their rows]} for the inputs of which that is known."""
        frames = {d: table(d) for d in self.inputs(n)}
        df = self.project.frame(self.spark, n, lambda t: frames[t] if t in frames else table(t), self.values)
        if not is_deterministic(df):
            return {}
        used = consumed_from(df, frames)
        return {d: [sorted(cs), checksum(frames[d], sorted(cs))] for d, cs in used.items() if cs is not None}

    def decide(self, n: str, table: Callable[[str], DataFrame]) -> tuple[bool, str]:
        """(whether to leave the model, why)."""
        if not self.store.exists(n + self.suffix):
            return False, "no table"
        old = self.store.get(f"gate.{n}{self.suffix}")
        if old is None:
            return False, "no record"
        if old["recipe"] != self.recipe(n):
            return False, "recipe changed"
        now = self.evidence(n)
        changed = sorted(d for d in {*now, *old["evidence"]} if now.get(d) != old["evidence"].get(d))
        if not changed:
            return True, "inputs unchanged"
        if self.project.models[n].options.get("column_skip"):
            try:
                cols = self.columns(n, table)
            except Exception:  # noqa: BLE001
                return False, "columns unknown"
            if all(d in cols and cols[d] == old["columns"].get(d) for d in changed):
                return True, "consumed columns unchanged"
        return False, "changed: " + ", ".join(changed)

    def record(self, n: str, table: Callable[[str], DataFrame]) -> None:
        cols = {}
        if self.project.models[n].options.get("column_skip"):
            try:
                cols = self.columns(n, table)
            except Exception:  # noqa: BLE001
                cols = {}
        self.store.put(f"gate.{n}{self.suffix}", {"recipe": self.recipe(n), "evidence": self.evidence(n), "columns": cols})


def checksum(df: DataFrame, cols: list[str]) -> list[str]:
    """Count and checksums of some columns' rows, as a multiset."""
    h = cmp.row_hash(cols) if cols else F.lit(0).cast("long")
    r = df.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first()
    return [str(x) for x in r]


def consumed_from(df: DataFrame, inputs: dict[str, DataFrame]) -> dict[str, set[str] | None]:
    """Columns that the optimised plan of ``df`` still reads of each input; None (fail closed) where that can't be told."""
    seq = lambda s: [s.apply(i) for i in range(s.size())]
    plan = df._jdf.queryExecution().optimizedPlan()
    used = {a.exprId().id() for a in seq(plan.output())}
    there: set[int] = set()

    def visit(p) -> None:
        kids = seq(p.children())
        there.update(a.exprId().id() for a in seq(p.output()))
        used.update(a.exprId().id() for a in seq(p.references().toSeq()))
        for c in kids:
            visit(c)

    visit(plan)
    out: dict[str, set[str] | None] = {}
    for n, d in inputs.items():
        ids = {a.exprId().id(): a.name() for a in seq(d._jdf.queryExecution().analyzed().output())}
        out[n] = {c for i, c in ids.items() if i in used} if ids.keys() & there else None
    return out


class SemanticGraph:
    """Columns of all models and what they are made of: edges (model, column) <- (upstream, column, kind)."""

    def __init__(self, project: Project, spark: SparkSession, values: dict[str, str] | None = None):
        # every table is an empty one of its own, so lineage goes one step
        self.edges: dict[tuple[str, str], set[tuple[str, str, str]]] = {}
        self.incomplete: dict[str, str] = {}
        stubs: dict[str, DataFrame] = {}
        owners: dict[int, tuple[str, str]] = {}

        def own(n: str, df: DataFrame) -> DataFrame:
            stubs[n] = empty(spark, df)
            owners.update({i: (n, c) for i, c in _ids(stubs[n]).items()})
            return stubs[n]

        for n, df in project.sources.items():
            own(n, df)
        with Views(spark) as views:
            self._trace(project, spark, values, views, stubs, owners, own)

    def _trace(self, project: Project, spark: SparkSession, values: dict[str, str] | None, views: Views, stubs: dict[str, DataFrame], owners: dict[int, tuple[str, str]], own: Callable) -> None:
        for n in topo(project.dependencies(spark, values)):
            reads = project.reads(n, spark, values)
            try:
                df = project.frame(spark, n, stubs.__getitem__, values, views)
                own(n, df)
            except Exception as e:  # noqa: BLE001
                self.incomplete[n] = f"doesn't resolve: {str(e).splitlines()[0][:120]}"
                continue
            traced = lineage(df, owners, frozenset(reads))
            self.edges.update({(n, c): {(*x[0], x[1]) for x in e if isinstance(x[0], tuple)} for c, e in traced.items()})
            lost = sorted(c for c, e in traced.items() if any(not isinstance(x[0], tuple) for x in e))
            if lost:
                self.incomplete[n] = "untraced columns: " + ", ".join(lost)
            elif project.models[n].build:
                self.incomplete[n] = "built by a function"

    def up(self, model: str, column: str) -> set[tuple[str, str]]:
        """Everything a column is made of, over all models."""
        return self._walk((model, column), lambda k: {(m, c) for m, c, _ in self.edges.get(k, ())})

    def down(self, model: str, column: str) -> set[tuple[str, str]]:
        """Every column that is made of this one."""
        return self._walk((model, column), lambda k: {t for t, es in self.edges.items() if any((m, c) == k for m, c, _ in es)})

    def consumers(self, model: str) -> dict[str, set[str]]:
        """{column: models that read it}."""
        out: dict[str, set[str]] = {}
        for (m, _), es in self.edges.items():
            for u, c, _ in es:
                if u == model:
                    out.setdefault(c, set()).add(m)
        return out

    @staticmethod
    def _walk(start: tuple[str, str], step: Callable) -> set[tuple[str, str]]:
        seen, todo = set(), [start]
        while todo:
            for k in step(todo.pop()) - seen:
                seen.add(k)
                todo.append(k)
        return seen


def _ids(df: DataFrame) -> dict[int, str]:
    # name#id of every output attribute in one call
    text = df._jdf.queryExecution().analyzed().output().mkString("\n")
    return {int(i): n for n, _, i in (re.sub(r"(L|\(.*\))?$", "", x).rpartition("#") for x in text.split("\n") if x)}


def is_deterministic(df: DataFrame) -> bool:
    return bool(df._jdf.queryExecution().analyzed().deterministic())


def lineage(df: DataFrame, owners: dict[int, tuple[str, str]] | None = None, tables: frozenset[str] = frozenset()) -> dict[str, set[tuple]]:
    """{output column: {(source column, kind)}}; kind is direct, cast, try_cast, aggregation or expression.

    ``owners`` gives the (table, column) that an attribute stands for; tracing ends there, and that is the source column.
    So it does at further copies of a view named in ``tables``, whose attributes a self-join has renumbered.

    Read from the analysed plan: every expression id is followed to the attributes of the leaves it is made of.
    """
    plan = df._jdf.queryExecution().analyzed()
    made: dict[int, tuple[str, list[tuple[int, str]]]] = {}
    seq = lambda s: [s.apply(i) for i in range(s.size())]

    def kind_of(e) -> str:
        n = e.getClass().getSimpleName()
        if n == "AttributeReference":
            return "direct"
        if n == "Cast":
            return "try_cast" if e.evalMode().toString() == "TRY" else "cast"
        if n == "AggregateExpression":
            return "aggregation"
        kids = [kind_of(c) for c in seq(e.children())]
        return "aggregation" if "aggregation" in kids else "expression"

    def refs(e) -> list[int]:
        return [a.exprId().id() for a in seq(e.references().toSeq())]

    def visit(p) -> None:
        n = p.getClass().getSimpleName()
        for c in seq(p.children()):
            visit(c)
        if n == "Project" or n == "Aggregate":
            for e in seq(p.projectList() if n == "Project" else p.aggregateExpressions()):
                if e.getClass().getSimpleName() == "Alias":
                    made[e.exprId().id()] = (kind_of(e.child()), [(r, "") for r in refs(e)])
        elif n == "Window":
            for e in seq(p.windowExpressions()):
                made[e.exprId().id()] = ("expression", [(r, "") for r in refs(e)])
        elif n == "SubqueryAlias" and owners is not None and p.identifier().name() in tables and p.child().getClass().getSimpleName() in ("LocalRelation", "View", "LogicalRDD"):
            for a in seq(p.output()):
                owners.setdefault(a.exprId().id(), (p.identifier().name(), a.name()))
        elif n == "Generate":
            for a in seq(p.generatorOutput()):
                made[a.exprId().id()] = ("expression", [(r, "") for r in refs(p.generator())])
        elif n == "Expand":
            # an output column of a grouping set is what it is in any of the projections
            rows = [seq(r) for r in seq(p.projections())]
            for i, a in enumerate(seq(p.output())):
                made.setdefault(a.exprId().id(), ("direct", [(r, "") for row in rows for r in refs(row[i]) if r != a.exprId().id()]))
        elif n == "Union":
            outs = [seq(c.output()) for c in seq(p.children())]
            for i, o in enumerate(seq(p.output())):
                made.setdefault(o.exprId().id(), ("direct", [(x[i].exprId().id(), "") for x in outs if x[i].exprId().id() != o.exprId().id()]))
        elif not seq(p.children()):
            for a in seq(p.output()):
                names.setdefault(a.exprId().id(), a.name())

    names: dict[int, str] = {}
    order = ["direct", "cast", "try_cast", "expression", "aggregation"]

    def trace(i: int, kind: str, seen: frozenset[int]) -> set[tuple[str, str]]:
        if i in seen:
            return set()
        if owners and i in owners:
            return {(owners[i], kind)}
        if i in made and made[i][1]:
            k = max(kind, made[i][0], key=order.index)
            return set().union(*[trace(r, k, seen | {i}) for r, _ in made[i][1]])
        return {(names[i], kind)} if i in names else set()

    visit(plan)
    return {a.name(): trace(a.exprId().id(), "direct", frozenset()) for a in seq(plan.output())}


def consumed_columns(df: DataFrame) -> set[str]:
    """Columns that the optimised plan still reads from its leaves."""
    plan = df._jdf.queryExecution().optimizedPlan()
    seq = lambda s: [s.apply(i) for i in range(s.size())]
    used = {a.exprId().id() for a in seq(plan.output())}
    leaves: dict[int, str] = {}

    def visit(p) -> None:
        kids = seq(p.children())
        if not kids:
            leaves.update({a.exprId().id(): a.name() for a in seq(p.output())})
        else:
            used.update(a.exprId().id() for a in seq(p.references().toSeq()))
        for c in kids:
            visit(c)

    visit(plan)
    return {n for i, n in leaves.items() if i in used}


def propagate(changed: dict[str, set[str]], reads: dict[str, dict[str, set[str]]]) -> set[str]:
    """Models to be rebuilt: those that consume a changed column of an upstream ({model: {upstream: columns}})."""
    stale: set[str] = set()
    todo = dict(changed)
    while True:
        new = {m for m, ups in reads.items() if m not in stale and any((u in stale) or (u in todo and cols & todo[u]) for u, cols in ups.items())}
        if not new:
            return stale
        stale |= new


def breaking_changes(old: DataFrame, new: DataFrame) -> list[str]:
    """E030 removed, E031 narrowed, E032 now nullable; W030 added, W031 widened."""
    from ..types import widens

    a, b = {f.name: f for f in old.schema}, {f.name: f for f in new.schema}
    out = [f"E030 {n}" for n in a if n not in b] + [f"W030 {n}" for n in b if n not in a]
    for n in a:
        if n in b and a[n].dataType != b[n].dataType:
            out.append(f"{'W031' if widens(a[n].dataType, b[n].dataType) else 'E031'} {n}")
        elif n in b and b[n].nullable and not a[n].nullable:
            out.append(f"E032 {n}")
    return out


def breaking_config(old: Model, new: Model) -> list[str]:
    """E033 another strategy, E034 other keys, E035 another stamp or time column, E036 another grain; W033 other options."""
    out = [f"E033 {old.strategy} to {new.strategy}"] if old.strategy != new.strategy else []
    if tuple(old.keys) != tuple(new.keys):
        out.append("E034 keys")
    if old.stamp != new.stamp or old.options.get("time_column") != new.options.get("time_column"):
        out.append("E035 stamp")
    if old.options.get("grain") != new.options.get("grain"):
        out.append("E036 grain")
    rest = {*old.options, *new.options} - {"time_column", "grain"}
    return out + [f"W033 {k}" for k in sorted(rest) if old.options.get(k) != new.options.get(k)]


def prune_unchanged(store: TableStore, sources: dict[str, DataFrame], stamp: str) -> dict[str, DataFrame]:
    """The sources whose MAX(stamp) or COUNT has changed since this was last asked."""
    out = {}
    for n, df in sources.items():
        r = df.agg(F.max(stamp).cast("string"), F.count(F.lit(1))).first()
        if store.get(f"seen.{n}") != [r[0], r[1]]:
            out[n] = df
            store.put(f"seen.{n}", [r[0], r[1]])
    return out


def incrementality_hint(df: DataFrame, keyed: bool = False) -> list[tuple[str, int]]:
    """Columns that could carry a watermark, best first: 2 for a telling name, 2 for a time type, 1 if the model has keys."""
    out = []
    for f in df.schema:
        s = 2 * bool(re.search(r"(updated|modified|created|synced|loaded|event|ingested)_?(at|time|ts|on|date)?$|_at$|_ts$", f.name, re.I))
        t = 2 * f.dataType.simpleString().startswith(("timestamp", "date"))
        if s and t:
            out.append((f.name, s + t + keyed))
    return sorted(out, key=lambda p: (-p[1], p[0]))


def estimate_rows(kind: str, left: float, right: float = 0.0, selectivity: float = 0.8) -> float:
    """Row estimate of an operator: inner = min, left = left, full = max, cross = product, aggregate = root, filter."""
    return {"inner": min(left, right), "left": left, "right": right, "full": max(left, right), "cross": left * right, "aggregate": left**0.5, "filter": left * selectivity}[kind]


def recommend(rows: int, has_stamp: bool, has_keys: bool, change_share: float) -> str:
    """A strategy for a model from its size and how it changes."""
    if rows < 100_000 or change_share > 0.5:
        return "full_refresh"
    if has_keys:
        return "merge"
    return "incremental" if has_stamp else "full_refresh"


def star_blast_radius(project: Project) -> list[str]:
    """P002: models that pass on every column of another model, by a star in their text outside of COUNT(*)."""
    deps = project.dependencies()
    star = lambda m: re.search(r"(?:SELECT\s+(?:DISTINCT\s+)?|,\s*)(?:\w+\.)?\*", sqlcompat._MASK.sub("''", m.text), re.I)
    return [f"P002 {n}" for n, m in project.models.items() if m.text and m.language == "sql" and deps[n] and star(m)]


def unit_test(df: DataFrame, expected: DataFrame, ordered: bool = False) -> tuple[bool, DataFrame]:
    """(passed, rows of one side): only the expected columns count, as a multiset; ``ordered`` compares positions too."""
    got = df.select(*expected.columns)
    if ordered:
        from pyspark.sql import Window

        at = lambda d: d.withColumn("__at", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))
        got, expected = at(got), at(expected)
    diff = got.exceptAll(expected).withColumn("_side", F.lit("actual")).unionByName(expected.exceptAll(got).withColumn("_side", F.lit("expected")))
    return diff.isEmpty(), diff
