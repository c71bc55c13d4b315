"""Queries that build, snapshot, compare and stream tables. Earlier states are derived from the tables by plain attributes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compare as cmp
from ..operators import materialize as mat
from ..plans.project import Model, Project
from ..session import shared_dir, table
from ..sources import files
from ..sources.lakehouse import content_addressed
from ..store import TableStore
from ..streaming import stream
from .base import Catalogue

C = Catalogue()

# Two states of the customers: balances of debtors rise, furniture buyers leave, suppliers become customers.
_V1 = "v1 AS (SELECT c_custkey AS k, c_name AS n, c_mktsegment AS seg, c_acctbal AS bal FROM customer)"
_V2 = "v2 AS (SELECT c_custkey AS k, c_name AS n, c_mktsegment AS seg, CASE WHEN c_acctbal < 0 THEN c_acctbal + 1000 ELSE c_acctbal END AS bal FROM customer WHERE c_mktsegment <> 'FURNITURE' UNION ALL SELECT s_suppkey + 1000000000, s_name, 'SUPPLIER', s_acctbal FROM supplier)"
_WITH = f"WITH {_V1}, {_V2} "


def v1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("n"), F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("bal"))


def v2(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select((F.col("s_suppkey") + 1_000_000_000).alias("k"), F.col("s_name").alias("n"), F.lit("SUPPLIER").alias("seg"), F.col("s_acctbal").alias("bal"))
    return v1(spark, d).filter("seg <> 'FURNITURE'").withColumn("bal", F.when(F.col("bal") < 0, F.col("bal") + 1000).otherwise(F.col("bal"))).unionByName(s)


@C.query(_WITH + "SELECT * FROM v2")
def mat_full_refresh(spark, d):
    st = TableStore(spark)
    mat.full_refresh(st, "t", v1(spark, d))
    return mat.full_refresh(st, "t", v2(spark, d))


@C.query("SELECT event_id, ts, user_id FROM events")
def mat_incremental_watermark(spark, d):
    """Two runs: up to the middle of the month, then all; the second takes only what is stamped later."""
    st, e = TableStore(spark), table(spark, d, "events").select("event_id", "ts", "user_id")
    mat.incremental(st, "t", e.filter("ts <= timestamp'2024-01-15 00:00:00'"), "ts")
    mat.incremental(st, "t", e, "ts")
    return mat.incremental(st, "t", e, "ts")


@C.query(_WITH + "SELECT * FROM v2 UNION ALL SELECT * FROM v1 WHERE k NOT IN (SELECT k FROM v2)")
def mat_merge_upsert(spark, d):
    st = TableStore(spark)
    mat.merge(st, "t", v1(spark, d), ["k"])
    mat.merge(st, "t", v2(spark, d), ["k"])
    return mat.merge(st, "t", v2(spark, d), ["k"])


@C.query(_WITH + "SELECT v1.k, v1.n, v1.seg, coalesce(v2.bal, v1.bal) AS bal FROM v1 LEFT JOIN v2 USING (k) UNION ALL SELECT * FROM v2 WHERE k NOT IN (SELECT k FROM v1)")
def mat_merge_partial_cols(spark, d):
    st = TableStore(spark)
    mat.merge(st, "t", v1(spark, d), ["k"])
    return mat.merge(st, "t", v2(spark, d).withColumn("n", F.upper("n")).withColumn("n", F.when(F.col("seg") == "SUPPLIER", F.initcap("n")).otherwise(F.col("n"))), ["k"], ["bal"])


@C.query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users, strftime(ts, '%Y-%m') AS period FROM events GROUP BY 1, 2, 5")
def mat_time_interval(spark, d):
    """January built by the month, then built again: the partition is replaced, not added to."""
    st, e = TableStore(spark), table(spark, d, "events")

    def model(start: datetime, end: datetime) -> DataFrame:
        part = e.filter((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")))
        return part.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("users"))

    periods = mat.plan_periods("month", first="2023-12", last="2024-02")
    mat.time_interval(st, "t", model, "day", periods, "month")
    return mat.time_interval(st, "t", model, "day", periods[1:], "month").withColumn("period", F.col("period").cast("string"))


def _rollup(e: DataFrame):
    """A time-interval model: events per type within a window, by whatever period their time lies in."""
    return lambda a, b: e.filter((F.col("ts") >= F.lit(a)) & (F.col("ts") < F.lit(b))).groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@C.query("SELECT g AS grain, CASE g WHEN 'hour' THEN strftime(ts, '%Y-%m-%dT%H') WHEN 'day' THEN strftime(ts, '%Y-%m-%d') WHEN 'month' THEN strftime(ts, '%Y-%m') ELSE strftime(ts, '%Y') END AS period, CAST(count(*) AS BIGINT) AS n FROM events, (VALUES ('hour'), ('day'), ('month'), ('year')) AS k(g) GROUP BY ALL")
def time_grain_rollup(spark, d):
    """One model built in every grain, a batch of periods at a time."""
    st, e, out = TableStore(spark), table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), None
    ends = {"hour": ("2023-12-31T00", "2024-02-01T23", 400), "day": ("2023-12-31", "2024-02-01", 20), "month": ("2023-12", "2024-02", 2), "year": ("2023", "2024", 1)}
    for grain, (first, last, batch) in ends.items():
        t = mat.time_interval(st, grain, _rollup(e), "hour", mat.plan_periods(grain, first=first, last=last, batch=batch), grain)
        part = t.groupBy(F.lit(grain).alias("grain"), "period").agg(F.sum("n").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@C.query("SELECT strftime(ts, '%Y-%m-%d') AS period, event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events WHERE value < 50 OR ts >= TIMESTAMP '2024-01-26' GROUP BY ALL")
def part_late_data(spark, d):
    """Days are built without the rows that arrive late, in batches of ten; the run for the last day looks five days back and picks up
    late rows there, but not before. It is run twice."""
    st, e = TableStore(spark), table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    mat.time_interval(st, "t", _rollup(e.filter("value < 50")), "hour", mat.plan_periods("day", first="2023-12-31", last="2024-01-31", batch=10), "day")
    again = mat.plan_periods("day", single="2024-01-31", lookback=5, batch=4)
    mat.time_interval(st, "t", _rollup(e), "hour", again, "day")
    return mat.time_interval(st, "t", _rollup(e), "hour", again, "day").withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@C.query("SELECT 'day' AS kind, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-10' UNION ALL SELECT 'empty', 0")
def time_interval_bootstrap(spark, d):
    """A table without rows first; its first periods later."""
    st, e = TableStore(spark), table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    empty = mat.time_interval_bootstrap(st, "t", _rollup(e), "day").agg(F.lit("empty").alias("kind"), F.count(F.lit(1)).alias("n"))
    full = mat.time_interval(st, "t", _rollup(e), "hour", mat.plan_periods("day", first="2023-12-30", last="2024-01-09", batch=30), "day")
    return full.agg(F.lit("day").alias("kind"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n")).unionByName(empty)


@C.query(_WITH + "SELECT * FROM v1 WHERE seg NOT IN (SELECT seg FROM v2) UNION ALL SELECT * FROM v2")
def mat_delete_insert(spark, d):
    st = TableStore(spark)
    mat.delete_insert(st, "t", v1(spark, d), ["seg"])
    return mat.delete_insert(st, "t", v2(spark, d), ["seg"])


@C.query("SELECT o_custkey, count(*) AS n FROM (SELECT * FROM orders WHERE o_totalprice > 100000) GROUP BY 1")
def mat_ephemeral(spark, d):
    """An ephemeral model is inlined into the one that uses it."""
    p = Project([
        Model("big", "SELECT * FROM src_orders WHERE o_totalprice > 100000", strategy="ephemeral"),
        Model("per_customer", "SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey"),
    ], {"src_orders": table(spark, d, "orders")})
    st = TableStore(spark)
    p.run(spark, st)
    return st.read("per_customer")


@C.query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def mat_view(spark, d):
    """A view is stored as its text; what reads it sees the sources as they are then."""
    p = Project([
        Model("in_credit", "SELECT * FROM src_customer WHERE c_acctbal > 0", strategy="view"),
        Model("per_segment", "SELECT c_mktsegment, count(*) AS n FROM in_credit GROUP BY c_mktsegment"),
    ], {"src_customer": table(spark, d, "customer")})
    st = TableStore(spark)
    p.run(spark, st)
    return st.read("per_segment")


@C.query(_WITH + "SELECT * FROM v1 EXCEPT SELECT * FROM v2")
def mat_content_addressed(spark, d):
    """Two versions of files named by their content; what the first had beyond the second."""
    st = TableStore(spark)
    content_addressed(st, "t", v1(spark, d))
    first, _ = st.version("t")
    content_addressed(st, "t", v1(spark, d).orderBy("n"))
    assert st.version("t")[0] == first  # equal content makes no version
    content_addressed(st, "t", v2(spark, d))
    return st.read("t", first).subtract(st.read("t"))


@C.query("SELECT event_id, event_type, value FROM events")
def mat_transform_incremental(spark, d):
    """An incremental model of a project, run three times while its source grows; every row comes once."""
    e, st = table(spark, d, "events"), TableStore(spark)
    for until in ("2024-01-12", "2024-01-20", "2030-01-01"):
        p = Project([Model("inc", "SELECT event_id, event_type, value, ts FROM src_events", strategy="incremental", stamp="ts")], {"src_events": e.filter(F.col("ts") < F.lit(until))})
        p.run(spark, st)
        p.run(spark, st)
    return st.read("inc").drop("ts")


@C.query(_WITH + "SELECT * FROM v1")
def mat_bootstrap(spark, d):
    """Only a table that isn't there is bootstrapped."""
    st = TableStore(spark)
    mat.bootstrap(st, "t", v1(spark, d))
    try:
        mat.bootstrap(st, "t", v2(spark, d))
    except ValueError:
        return st.read("t")


@C.query("SELECT row_id, md5(coalesce(CAST(order_id AS VARCHAR), '_dbt_utils_surrogate_key_null_') || '-' || coalesce(CAST(customer_id AS VARCHAR), '_dbt_utils_surrogate_key_null_') || '-' || coalesce(status, '_dbt_utils_surrogate_key_null_')) AS key FROM raw_orders")
def mat_surrogate_key(spark, d):
    return table(spark, d, "raw_orders").select("row_id", mat.surrogate_key(["order_id", "customer_id", "status"]).alias("key"))


@C.query("SELECT n_nationkey, n_name, n_regionkey, CAST('run-1' AS VARCHAR) AS _run, CAST(1 AS BIGINT) AS _batch FROM nation")
def mat_metadata_columns(spark, d):
    return mat.metadata_columns(table(spark, d, "nation"), {"_run": ("'run-1'", "string"), "_batch": ("1", "bigint")})


@C.query("SELECT event_id FROM events WHERE NOT coalesce(ts < TIMESTAMP '2024-01-10', false)")
def retention_archive(spark, d):
    return mat.archive(table(spark, d, "events"), "ts", "2024-01-10 00:00:00")[0].select("event_id")


@C.query("SELECT o_orderkey, o_totalprice FROM orders")
def mat_compact(spark, d):
    st = TableStore(spark)
    st.replace("t", table(spark, d, "orders").select("o_orderkey", "o_totalprice"))
    return mat.compact(st, "t", 2, ["o_orderkey"])


@C.query("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, CAST(NULL AS VARCHAR) AS c_phone FROM customer")
def drift_evolve(spark, d):
    t = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    new = t.withColumn("c_nationkey", F.col("c_nationkey").cast("bigint")).withColumn("c_phone", F.lit("x")).schema
    return cmp.evolve(t, new)


# snapshots
_T1, _T2 = "2024-01-01 00:00:00", "2024-02-01 00:00:00"


def _snapshot(spark: SparkSession, d: str, hard: bool) -> DataFrame:
    s = mat.Snapshot(("k",), check=("seg", "bal"), hard_deletes=hard)
    h = s.first(v1(spark, d), _T1)
    return s.run(h, v2(spark, d), _T2).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("valid_from", "valid_to")})


_SNAP = _WITH + f"""SELECT v1.*, TIMESTAMP '{_T1}' AS valid_from, CASE WHEN {{gone}} (v2.k IS NOT NULL AND (v1.seg IS DISTINCT FROM v2.seg OR v1.bal IS DISTINCT FROM v2.bal)) THEN TIMESTAMP '{_T2}' END AS valid_to,
NOT ({{gone}} (v2.k IS NOT NULL AND (v1.seg IS DISTINCT FROM v2.seg OR v1.bal IS DISTINCT FROM v2.bal))) AS is_current FROM v1 LEFT JOIN v2 USING (k)
UNION ALL SELECT v2.*, TIMESTAMP '{_T2}', NULL, true FROM v2 LEFT JOIN v1 USING (k) WHERE v1.k IS NULL OR v1.seg IS DISTINCT FROM v2.seg OR v1.bal IS DISTINCT FROM v2.bal"""
C.add("scd2_check", lambda spark, d: _snapshot(spark, d, False), _SNAP.format(gone=""))
C.add("scd2_hard_delete", lambda spark, d: _snapshot(spark, d, True), _SNAP.format(gone="v2.k IS NULL OR"))


@C.query("""WITH a AS (SELECT order_id, status, _fivetran_synced AS at, row_id, row_number() OVER (PARTITION BY order_id ORDER BY _fivetran_synced, row_id) AS i, row_number() OVER (PARTITION BY order_id ORDER BY _fivetran_synced DESC, row_id DESC) AS j FROM raw_orders WHERE _fivetran_synced IS NOT NULL)
SELECT f.order_id, f.status, f.at AS valid_from, CASE WHEN l.at IS DISTINCT FROM f.at THEN l.at END AS valid_to, l.at IS NOT DISTINCT FROM f.at AS is_current FROM a f JOIN a l ON f.order_id = l.order_id AND l.j = 1 WHERE f.i = 1
UNION ALL SELECT l.order_id, l.status, l.at, NULL, true FROM a l JOIN a f ON f.order_id = l.order_id AND f.i = 1 WHERE l.j = 1 AND l.at IS DISTINCT FROM f.at""")
def scd2_timestamp(spark, d):
    """A snapshot of the first deliveries, then of the last."""
    r = table(spark, d, "raw_orders").filter("_fivetran_synced is not null")
    state = lambda f: r.groupBy("order_id").agg(f(F.struct(F.col("_fivetran_synced").alias("at"), "row_id", "status")).alias("m")).select("order_id", "m.status", "m.at")
    s = mat.Snapshot(("order_id",), updated_at="at")
    out = s.run(s.first(state(F.min), _T1), state(F.max), _T2).drop("at")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("valid_from", "valid_to")})


# comparison
@C.query(_WITH + "SELECT (SELECT count(*) FROM v1) AS left_rows, (SELECT count(*) FROM v2) AS right_rows, (SELECT count(*) FROM v2) - (SELECT count(*) FROM v1) AS diff, round(abs((SELECT count(*) FROM v2) - (SELECT count(*) FROM v1)) * 100.0 / (SELECT count(*) FROM v1), 6) AS pct, CASE WHEN abs((SELECT count(*) FROM v2) - (SELECT count(*) FROM v1)) * 100.0 / (SELECT count(*) FROM v1) > 5 THEN 'fail' WHEN abs((SELECT count(*) FROM v2) - (SELECT count(*) FROM v1)) * 100.0 / (SELECT count(*) FROM v1) > 1 THEN 'warn' ELSE 'pass' END AS verdict")
def cmp_row_counts(spark, d):
    return cmp.row_counts(v1(spark, d), v2(spark, d)).withColumn("pct", F.col("pct").cast("double"))


C.add("diff_except", lambda spark, d: cmp.except_both(v1(spark, d), v2(spark, d)), _WITH + "SELECT *, 'left' AS _diff_side FROM (SELECT * FROM v1 EXCEPT SELECT * FROM v2) UNION ALL SELECT *, 'right' FROM (SELECT * FROM v2 EXCEPT SELECT * FROM v1)")
C.add("diff_except_all", lambda spark, d: cmp.except_both(v1(spark, d).select("seg"), v2(spark, d).select("seg"), True), _WITH + "SELECT *, 'left' AS _diff_side FROM (SELECT seg FROM v1 EXCEPT ALL SELECT seg FROM v2) UNION ALL SELECT *, 'right' FROM (SELECT seg FROM v2 EXCEPT ALL SELECT seg FROM v1)")
_DIFF = _WITH + "SELECT k, CASE WHEN v1.n IS NULL THEN 'added' WHEN v2.n IS NULL THEN 'removed' ELSE 'changed' END AS change FROM v1 FULL JOIN v2 USING (k) WHERE v1.n IS NULL OR v2.n IS NULL OR (v1.n, v1.seg, v1.bal) IS DISTINCT FROM (v2.n, v2.seg, v2.bal)"
C.add("bisect_row_diff", lambda spark, d: cmp.row_diff(v1(spark, d), v2(spark, d), "k"), _DIFF)
C.add("bisect_chunked_diff", lambda spark, d: cmp.chunked_diff(v1(spark, d), v2(spark, d), "k", 50), _DIFF)
C.add("bisect_samples", lambda spark, d: cmp.samples(cmp.chunked_diff(v1(spark, d), v2(spark, d), "k"), "k").withColumn("keys", F.array_join(F.col("keys").cast("array<string>"), ",")),
      _DIFF.replace(_WITH, _WITH.rstrip() + ", d AS (") + ") SELECT change, count(*) AS rows, array_to_string(list(k ORDER BY k)[1:5], ',') AS keys FROM d GROUP BY 1")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    lo, hi = o.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    return cmp.chunk_checksums(o, "o_orderkey", lo, hi, 32)


C.add("chunk_row_counts", lambda spark, d: _chunks(spark, d).select("chunk", "rows"), """WITH b AS (SELECT min(o_orderkey) AS lo, (max(o_orderkey) - min(o_orderkey)) // 32 AS step FROM orders)
SELECT least(CAST(floor((o_orderkey - lo) / step) AS BIGINT), 31) AS chunk, count(*) AS rows FROM orders, b GROUP BY 1""")
C.add("chunk_checksum", _chunks)
C.add("part_checksum", lambda spark, d: cmp.partition_checksums(table(spark, d, "orders"), F.date_format("o_orderdate", "yyyy-MM")))
C.add("part_checksum_diff", lambda spark, d: cmp.changed_partitions(cmp.partition_checksums(v1(spark, d), F.col("seg")), cmp.partition_checksums(v2(spark, d), F.col("seg"))),
      _WITH + ", a AS (SELECT seg, list(row(k, n, bal) ORDER BY k) AS l FROM v1 GROUP BY 1), b AS (SELECT seg, list(row(k, n, bal) ORDER BY k) AS l FROM v2 GROUP BY 1) SELECT seg AS part, CASE WHEN a.l IS NOT DISTINCT FROM b.l THEN 'unchanged' ELSE 'changed' END AS state FROM a FULL JOIN b USING (seg)")
C.add("dedup_stats", lambda spark, d: cmp.shared_partitions({n: cmp.partition_checksums(f(spark, d).filter("seg <> 'SUPPLIER'"), F.col("seg")) for n, f in (("before", v1), ("after", v2), ("third", lambda s, x: v1(s, x).filter("seg <> 'MACHINERY'")))}).select("rows", "tables", "copies"),
      _WITH + """, c AS (SELECT seg, 'before' AS t, list(row(k, n, bal) ORDER BY k) AS l FROM v1 GROUP BY seg UNION ALL SELECT seg, 'after', list(row(k, n, bal) ORDER BY k) FROM v2 WHERE seg <> 'SUPPLIER' GROUP BY seg
        UNION ALL SELECT seg, 'third', list(row(k, n, bal) ORDER BY k) FROM v1 WHERE seg <> 'MACHINERY' GROUP BY seg)
        SELECT CAST(len(l) AS BIGINT) AS rows, count(DISTINCT t) AS tables, count(*) AS copies FROM c GROUP BY l HAVING count(DISTINCT t) > 1""")
C.add("cmp_null_keys", lambda spark, d: cmp.null_keys(table(spark, d, "raw_customers"), table(spark, d, "raw_orders"), "customer_id"), "SELECT count(*) AS null_keys, 'left' AS side FROM raw_customers WHERE customer_id IS NULL UNION ALL SELECT count(*), 'right' FROM raw_orders WHERE customer_id IS NULL")


# files
def _roundtrip(suffix: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        df, path = table(spark, d, "customer"), f"{shared_dir(spark, 'files')}.{suffix}"
        files.write(df, path)
        return files.load(spark, path, None if suffix == "parquet" else df.schema)

    return run


for _s, _n in (("csv", "io_csv_roundtrip"), ("tsv", "io_tsv_roundtrip"), ("parquet", "io_parquet_roundtrip"), ("jsonl", "io_json_roundtrip"), ("orc", "io_orc_roundtrip")):
    C.add(_n, _roundtrip(_s), "SELECT * FROM customer")


# streams
@C.query("SELECT event_id, user_id, event_type FROM events WHERE value > 10")
def stream_microbatch(spark, d):
    schema = table(spark, d, "events").schema
    return stream.microbatch(spark, d, schema, lambda s: s.filter("value > 10").select("event_id", "user_id", "event_type"), glob="events.parquet")


_n = lambda: [F.count(F.lit(1)).alias("n")]
_ntz = lambda df: df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})
C.add("win_tumbling", lambda spark, d: _ntz(stream.tumbling(table(spark, d, "events"), "ts", "1 hour", ["event_type"], _n())), "SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL")
C.add("win_sliding", lambda spark, d: _ntz(stream.sliding(table(spark, d, "events"), "ts", "2 hours", "1 hour", ["event_type"], _n())), "SELECT w AS window_start, w + INTERVAL 2 HOUR AS window_end, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY ALL")
C.add("win_session", lambda spark, d: _ntz(stream.sessions(table(spark, d, "events"), "ts", "30 minutes", ["user_id"], _n())),
      "SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*) AS n FROM (SELECT *, count(*) FILTER (WHERE p IS NULL OR ts >= p + INTERVAL 30 MINUTE) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY user_id, s")


@C.query("SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events) GROUP BY ALL")
def stream_tumbling_late(spark, d):
    """A stream that waits two hours for late rows: windows that have closed when the input ends."""
    e = table(spark, d, "events")
    as_ts = lambda s: s.withColumn("ts", F.col("ts").cast("timestamp"))
    return _ntz(stream.microbatch(spark, d, e.schema, lambda s: stream.tumbling(as_ts(s), "ts", "1 hour", ["event_type"], _n(), "2 hours"), glob="events.parquet"))


@C.query("SELECT c_mktsegment, count(*) AS customers, CAST(sum(orders) AS BIGINT) AS orders FROM (SELECT c_custkey, c_mktsegment, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2) GROUP BY 1")
def project_run(spark, d):
    """A project of a SQL model, a pipeline and a mart, run in dependency order."""
    p = Project([
        Model("mart_segments", 'from int_customers group c_mktsegment { customers: count(), orders: sum(orders) }', language="dsl"),
        Model("stg_orders_x", "SELECT o_orderkey, o_custkey FROM src_orders"),
        Model("int_customers", "SELECT c_custkey, c_mktsegment, count(o_orderkey) AS orders FROM src_customer LEFT JOIN stg_orders_x ON c_custkey = o_custkey GROUP BY c_custkey, c_mktsegment"),
    ], {"src_orders": table(spark, d, "orders"), "src_customer": table(spark, d, "customer")})
    st = TableStore(spark)
    p.run(spark, st)
    return st.read("mart_segments")


QUERIES, ORACLE = C.QUERIES, C.ORACLE

