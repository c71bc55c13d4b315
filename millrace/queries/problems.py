"""Queries of the general data problems (p1, p2, p3, p5, p6) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.change_capture import ChangeCapture, committed_offsets
from ..operators.entity_history import EntityHistory
from ..operators.lambda_periods import LambdaPeriods
from ..operators.regular_grid import RegularGrid, epoch_seconds
from ..operators.spikes import Spikes
from ..session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """What the scheduled batches have added to the fast layer's periods, over the whole log."""
    p, log = LambdaPeriods(), table(spark, d, "models")
    _, members = p.run(log, p.schedule(log))
    return p.corrections(members).select(F.col("id").alias("execution_id"))


def _epoch(text: str) -> int:
    from datetime import UTC, datetime

    return int(datetime.fromisoformat(text).replace(tzinfo=UTC).timestamp())


#: Scheduled batches of p1_period_view (fixed, so that the SQL can name them).
BATCHES = ("2019-01-21", "2019-02-11")


def p1_period_view(spark: SparkSession, d: str) -> DataFrame:
    view, _ = LambdaPeriods().run(table(spark, d, "models"), [_epoch(t) for t in BATCHES])
    return view.select(F.col("key").alias("model_name"), F.col("period_end").alias("period_end_s"), "executions", "rows_copied", "late_executions", "frozen")


#: Between the batches: readers see the first batch's view and what the fast layer has counted since.
P1_NOW = "2019-01-24 06:00:00"


def p1_served_view(spark: SparkSession, d: str) -> DataFrame:
    p, log, t = LambdaPeriods(), table(spark, d, "models"), _epoch(BATCHES[0])
    view, _ = p.run(log, [t])
    served = p.serve(view, p.fast(log, t, _epoch(P1_NOW)))
    return served.select(F.col("key").alias("model_name"), F.col("period_end").alias("period_end_s"), "executions", "rows_copied", "late_executions", "frozen", "provisional")


def p2_grid(spark: SparkSession, d: str) -> DataFrame:
    g = RegularGrid()
    samples, runs = table(spark, d, "samples"), table(spark, d, "runs")
    fd = g.slots(samples, "soak_id", "fd_total", epoch_seconds(F.col("t")), F.col("fd_total") > 0, F.col("fd_total"), "sample_id")
    started = F.unix_seconds(F.col("started_at").cast("timestamp"))
    return g.grid([fd, g.slots(runs, "soak_id", "runs", started, count_of="run_id")]).select(F.col("source").alias("soak_id"), "series", F.col("slot").alias("slot_start"), "value", "missing", "converged")


def p2_observed(spark: SparkSession, d: str) -> DataFrame:
    """The grid's slots with a value of their own."""
    return p2_grid(spark, d).filter("not missing").select("soak_id", "series", "slot_start", "value")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_grid(spark, d).filter("missing").select("soak_id", "series", "slot_start")


def _capture(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    return ChangeCapture().run(table(spark, d, "raw_orders"), floors=committed_offsets(table(spark, d, "models"), "stg_orders"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The batch as it stands in the sink after its commit."""
    return ChangeCapture.changes(_capture(spark, d)[0]).select(F.col("key").alias("order_id"))


def p3_sink(spark: SparkSession, d: str) -> DataFrame:
    c, (_, folder) = ChangeCapture(), _capture(spark, d)
    return c.sink(spark, folder).select(F.col("key").alias("order_id"), F.col("ord").alias("row_id"), "v.status", "v.total_amount")


def p3_next_run(spark: SparkSession, d: str) -> DataFrame:
    """The run after: nothing has arrived since, so nothing is read and nothing changes."""
    c, (_, folder) = ChangeCapture(), _capture(spark, d)
    batch, _ = c.run(table(spark, d, "raw_orders"), folder)
    return batch.agg(F.count(F.lit(1)).alias("rows"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return Spikes().flags(table(spark, d, "models")).select(F.col("id").alias("execution_id"), "reading")


def p5_impossible(spark: SparkSession, d: str) -> DataFrame:
    """The readings beyond the physical bound among the flags."""
    return Spikes().flags(table(spark, d, "models")).filter("reason = 'impossible'").select(F.col("id").alias("execution_id"), "reading", F.col("value").cast("long").alias("value"))


def _stamp(c: str) -> F.Column:
    return F.date_format(F.timestamp_micros(c), "yyyy-MM-dd HH:mm:ss")


def p6_versions(spark: SparkSession, d: str) -> DataFrame:
    h = EntityHistory()
    v = h.validity(*h.build(table(spark, d, "raw_customers")))
    return v.select(F.col("e").alias("customer_id"), "tier", _stamp("valid_from").alias("valid_from"), F.coalesce(_stamp("valid_to"), F.lit("open")).alias("valid_to"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_versions(spark, d).select("customer_id", "valid_from", "valid_to")


P6_MOMENT = "2019-01-25 12:00:00"


def p6_as_of(spark: SparkSession, d: str) -> DataFrame:
    h = EntityHistory(attributes=("tier", "email"))
    return h.as_of(*h.build(table(spark, d, "raw_customers")), _epoch(P6_MOMENT) * 1_000_000).withColumnRenamed("e", "customer_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_period_view, p1_served_view, p2_found, p2_grid, p2_observed, p3_found, p3_sink, p3_next_run, p5_found, p5_impossible, p6_found, p6_versions, p6_as_of)}

# keys by their digits; without a key the bounds
_PERIODS = """
WITH d AS (SELECT *, regexp_replace(partition_key, '[^0-9]', '', 'g') AS k FROM models WHERE lower(trim(status)) = 'success'),
p AS (SELECT execution_id, model_name, started_at, recorded_at, rows_copied,
  CASE WHEN length(k) >= 10 THEN try_strptime(substr(k, 1, 10), '%Y%m%d%H') + INTERVAL 1 HOUR
       WHEN length(k) = 8 THEN try_strptime(k, '%Y%m%d') + INTERVAL 1 DAY
       WHEN length(k) = 6 THEN try_strptime(k || '01', '%Y%m%d') + INTERVAL 1 MONTH
       ELSE partition_end END AS e FROM d),
u AS (SELECT execution_id, any_value(model_name) AS model_name, any_value(started_at) AS ts, min(recorded_at) AS arrived, any_value(e) AS e, any_value(rows_copied) AS rows_copied
      FROM p WHERE e IS NOT NULL GROUP BY execution_id)
"""
_FREEZE = "to_timestamp(ceil((epoch(e) + 216 * 3600) / 86400) * 86400)::TIMESTAMP"
_P6 = """
WITH r AS (SELECT customer_id AS c, _fivetran_synced AS ts, coalesce(_fivetran_deleted, false) AS gone, lower(trim(tier)) AS t, lower(trim(email)) AS m,
  row_number() OVER (PARTITION BY customer_id, _fivetran_synced ORDER BY row_id DESC) AS i FROM raw_customers WHERE customer_id IS NOT NULL AND _fivetran_synced IS NOT NULL),
s AS (SELECT c, ts, gone, t, m, CASE WHEN gone THEN 'gone' ELSE 'is:' || coalesce(t, chr(0)) END AS st FROM r WHERE i = 1),
g AS (SELECT *, lag(st) OVER (PARTITION BY c ORDER BY ts) AS p FROM s),
v AS (SELECT *, lead(ts) OVER (PARTITION BY c ORDER BY ts) AS nx FROM g WHERE p IS DISTINCT FROM st)
"""
_P6_TIMES = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS valid_from, coalesce(strftime(nx, '%Y-%m-%d %H:%M:%S'), 'open') AS valid_to"
_GRID = """
WITH o AS (SELECT soak_id, 'fd_total' AS series, (s // 300) * 300 AS slot, avg(fd_total) AS v FROM (
    SELECT DISTINCT soak_id, sample_id, fd_total, CASE WHEN abs(t) < 100000000000 THEN t WHEN abs(t) < 100000000000000 THEN t // 1000 WHEN abs(t) < 100000000000000000 THEN t // 1000000 ELSE t // 1000000000 END AS s
    FROM samples WHERE fd_total > 0 AND soak_id IS NOT NULL AND t IS NOT NULL) GROUP BY ALL
  UNION ALL SELECT soak_id, 'runs', (epoch_us(started_at) // 300000000) * 300, count(DISTINCT run_id) FROM runs WHERE soak_id IS NOT NULL AND started_at IS NOT NULL GROUP BY ALL),
b AS (SELECT soak_id, series, min(slot) AS lo, max(slot) AS hi FROM o GROUP BY ALL),
g AS (SELECT soak_id, series, unnest(generate_series(lo, hi, 300)) AS slot FROM b)
"""

ORACLE = {
    "p1_found": _PERIODS + "SELECT execution_id FROM u WHERE ts > e + INTERVAL 2 HOUR AND ts <= e + INTERVAL 72 HOUR",
    "p1_period_view": _PERIODS + f""", f AS (SELECT *, {_FREEZE} AS fz FROM u WHERE ts <= e + INTERVAL 72 HOUR AND arrived <= TIMESTAMP '{BATCHES[1]}')
        SELECT model_name, CAST(epoch(e) AS BIGINT) AS period_end_s, count(*) AS executions, CAST(coalesce(sum(rows_copied), 0) AS BIGINT) AS rows_copied, count(*) FILTER (WHERE ts > e + INTERVAL 2 HOUR) AS late_executions, fz <= TIMESTAMP '{BATCHES[1]}' AS frozen
        FROM f WHERE model_name IS NOT NULL AND arrived <= fz AND (fz > TIMESTAMP '{BATCHES[0]}' OR arrived <= TIMESTAMP '{BATCHES[0]}') GROUP BY model_name, e, fz""",
    "p1_served_view": _PERIODS + f""", v AS (SELECT model_name, e, rows_copied, ts > e + INTERVAL 2 HOUR AS late, {_FREEZE} <= TIMESTAMP '{BATCHES[0]}' AS frozen, false AS provisional
          FROM u WHERE ts <= e + INTERVAL 72 HOUR AND arrived <= TIMESTAMP '{BATCHES[0]}' AND arrived <= {_FREEZE}
        UNION ALL SELECT model_name, e, rows_copied, false, false, true FROM p WHERE started_at <= e + INTERVAL 2 HOUR AND recorded_at > TIMESTAMP '{BATCHES[0]}' AND recorded_at <= TIMESTAMP '{P1_NOW}')
        SELECT model_name, CAST(epoch(e) AS BIGINT) AS period_end_s, count(*) AS executions, CAST(coalesce(sum(rows_copied), 0) AS BIGINT) AS rows_copied, count(*) FILTER (WHERE late) AS late_executions, bool_or(frozen) AS frozen, bool_or(provisional) AS provisional
        FROM v WHERE model_name IS NOT NULL GROUP BY model_name, e""",
    "p2_found": _GRID + "SELECT g.soak_id, g.series, g.slot AS slot_start FROM g LEFT JOIN o USING (soak_id, series, slot) WHERE o.slot IS NULL",
    "p2_observed": _GRID + "SELECT soak_id, series, slot AS slot_start, CAST(v AS DOUBLE) AS value FROM o",
    "p3_found": """
        WITH w AS (SELECT tenant, arg_max(metadata_watermark, (started_at, execution_id)) AS w FROM (SELECT * FROM models WHERE model_name = 'stg_orders' AND lower(trim(status)) = 'success') GROUP BY tenant),
        r AS (SELECT o.*, w.w IS NULL OR o._fivetran_synced > w.w AS new FROM raw_orders o LEFT JOIN w USING (tenant) WHERE o._fivetran_synced IS NOT NULL AND order_id IS NOT NULL AND tenant IS NOT NULL),
        n AS (SELECT *, row_number() OVER (PARTITION BY order_id, new ORDER BY _fivetran_synced DESC, row_id DESC) AS i FROM r)
        SELECT a.order_id FROM n a LEFT JOIN n b ON a.order_id = b.order_id AND b.i = 1 AND NOT b.new
        WHERE a.new AND a.i = 1 AND (b.order_id IS NULL OR (a.customer_id, a.order_date, a.status, a.total_amount) IS DISTINCT FROM (b.customer_id, b.order_date, b.status, b.total_amount))""",
    "p5_impossible": "SELECT DISTINCT execution_id, reading, value FROM (SELECT execution_id, model_name, 'duration_ms' AS reading, duration_ms AS value FROM models UNION ALL SELECT execution_id, model_name, 'rows_copied', rows_copied FROM models) WHERE value < 0 AND execution_id IS NOT NULL AND model_name IS NOT NULL",
    "p6_found": _P6 + f"SELECT c AS customer_id, {_P6_TIMES} FROM v WHERE NOT gone",
    "p6_versions": _P6 + f"SELECT c AS customer_id, t AS tier, {_P6_TIMES} FROM v WHERE NOT gone",
    "p6_as_of": _P6 + f", l AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY ts DESC) AS i FROM s WHERE ts <= TIMESTAMP '{P6_MOMENT}') SELECT c AS customer_id, t AS tier, m AS email FROM l WHERE i = 1 AND NOT gone",
}
ORACLE["p3_sink"] = "SELECT order_id, row_id, status, total_amount FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY _fivetran_synced DESC, row_id DESC) AS i FROM raw_orders WHERE _fivetran_synced IS NOT NULL AND order_id IS NOT NULL AND tenant IS NOT NULL AND row_id IS NOT NULL) WHERE i = 1"
ORACLE["p3_next_run"] = "SELECT CAST(0 AS BIGINT) AS rows"
