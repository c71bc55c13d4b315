"""Queries of the data-quality layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as q
from ..operators.quality import Rule
from ..session import table
from .base import Catalogue

C = Catalogue()
NOW = "2024-01-20 00:00:00"


def rule(name: str, t: str, sql: str, **kw) -> None:
    C.add(name, lambda spark, d: Rule(**{k: v(spark, d) if callable(v) else v for k, v in kw.items()}).failing(table(spark, d, t)), sql)


rule("dq_not_null", "raw_orders", "SELECT * FROM raw_orders WHERE status IS NULL", kind="not_null", column="status")
rule("dq_unique", "models", "SELECT execution_id, count(*) AS n FROM models GROUP BY 1 HAVING count(*) > 1", kind="unique", column="execution_id")
rule("dq_accepted_values", "raw_orders", "SELECT DISTINCT status FROM raw_orders WHERE status NOT IN ('pending', 'completed')", kind="accepted_values", column="status", values=("pending", "completed"))
rule("dq_relationships", "orders", "SELECT * FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)", kind="relationships", column="o_custkey", to=lambda s, d: table(s, d, "customer").filter("c_acctbal > 0"), to_column="c_custkey")
rule("dq_expression", "models", "SELECT execution_id, run_id FROM models WHERE NOT (duration_ms >= 0)", kind="expression", expression="duration_ms >= 0")
C.QUERIES["dq_expression"] = lambda spark, d: Rule("expression", expression="duration_ms >= 0").failing(table(spark, d, "models")).select("execution_id", "run_id")
rule("dq_row_count_range", "customer", "SELECT count(*) AS n FROM customer HAVING count(*) > 10", kind="row_count_range", low=0, high=10)
rule("dq_in_range", "lineitem", "SELECT * FROM lineitem WHERE l_discount < 0.01 OR l_discount > 0.09", kind="in_range", column="l_discount", low=0.01, high=0.09)
rule("dq_regex_match", "raw_customers", "SELECT row_id, email FROM raw_customers WHERE NOT regexp_matches(email, '^[a-z0-9]+@mail[0-4]\\.example$')", kind="regex_match", column="email", pattern="^[a-z0-9]+@mail[0-4]\\.example$")
C.QUERIES["dq_regex_match"] = lambda spark, d: Rule("regex_match", "email", pattern="^[a-z0-9]+@mail[0-4]\\.example$").failing(table(spark, d, "raw_customers")).select("row_id", "email")
rule("dq_aggregate", "orders", "SELECT max(o_totalprice) AS value FROM orders HAVING NOT (max(o_totalprice) < 1000)", kind="aggregate", column="o_totalprice", op="max", cmp="<", value=1000)
rule("dq_composite_unique", "lineitem", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1", kind="composite_unique", columns=("l_orderkey", "l_linenumber"))
rule("dq_unique_expr", "raw_customers", "SELECT lower(email) AS key, count(*) AS n FROM raw_customers GROUP BY 1 HAVING count(*) > 1", kind="unique_expr", expression="lower(email)")
rule("dq_not_in_future", "events", f"SELECT * FROM events WHERE ts > TIMESTAMP '{NOW}'", kind="not_in_future", column="ts", run_ts=NOW)
rule("dq_older_than", "events", "SELECT * FROM events WHERE CAST(ts AS DATE) > DATE '2024-01-13'", kind="older_than_n_days", column="ts", run_ts=NOW, days=7)


@C.query("""SELECT 'not_null_status' AS rule, 'error' AS severity, count(*) AS failures, count(*) = 0 AS passed FROM raw_orders WHERE status IS NULL UNION ALL
SELECT 'in_range_total_amount', 'error', count(*), count(*) = 0 FROM raw_orders WHERE total_amount > 100 UNION ALL SELECT 'unique_row_id', 'warning', count(*), count(*) = 0 FROM (SELECT row_id FROM raw_orders GROUP BY 1 HAVING count(*) > 1)""")
def dq_run_all(spark, d):
    return q.run_rules(table(spark, d, "raw_orders"), [Rule("not_null", "status"), Rule("in_range", "total_amount", high=100), Rule("unique", "row_id", severity="warning")])


# quarantine
_R = [Rule("not_null", "customer_id"), Rule("accepted_values", "status", values=("pending", "completed", "cancelled")), Rule("in_range", "total_amount", low=0, high=400, where="tenant = 'shop_00000'")]
_BAD = {
    "not_null_customer_id": "customer_id IS NULL",
    "accepted_values_status": "coalesce(status NOT IN ('pending', 'completed', 'cancelled'), false)",
    "in_range_total_amount": "coalesce(tenant = 'shop_00000' AND (total_amount < 0 OR total_amount > 400), false)",
}
_ANY = " OR ".join(_BAD.values())
_TAGS = ", ".join(f"CASE WHEN {p} THEN '{n}' END AS _error_{n}" for n, p in _BAD.items())
C.add("quar_split_valid", lambda spark, d: q.split(table(spark, d, "raw_orders"), _R)[0], f"SELECT * FROM raw_orders WHERE NOT ({_ANY})")
C.add("quar_split_bad", lambda spark, d: q.split(table(spark, d, "raw_orders"), _R)[1], f"SELECT *, {_TAGS} FROM raw_orders WHERE {_ANY}")
C.add("quar_tag", lambda spark, d: q.tag(table(spark, d, "raw_orders"), _R), f"SELECT *, {_TAGS} FROM raw_orders")
C.add("quar_drop", lambda spark, d: q.drop(table(spark, d, "raw_orders"), _R).select("row_id"), f"SELECT row_id FROM raw_orders WHERE NOT ({_ANY})")

# masks
C.add("mask_hash", lambda spark, d: table(spark, d, "raw_customers").select("row_id", q.mask(F.col("email"), "hash").alias("email")), "SELECT row_id, sha256(email) AS email FROM raw_customers")
C.add("mask_partial", lambda spark, d: table(spark, d, "raw_customers").select("row_id", q.mask(F.col("name"), "partial").alias("name"), q.mask(F.col("tier"), "partial").alias("tier")), "SELECT row_id, CASE WHEN length(name) < 5 THEN '***' ELSE left(name, 2) || '***' || right(name, 2) END AS name, CASE WHEN length(tier) < 5 THEN '***' ELSE left(tier, 2) || '***' || right(tier, 2) END AS tier FROM raw_customers")
C.add("mask_redact", lambda spark, d: table(spark, d, "raw_customers").select("row_id", q.mask(F.col("email"), "redact").alias("email")), "SELECT row_id, '***' AS email FROM raw_customers")
C.add("preview_masked", lambda spark, d: table(spark, d, "raw_customers").select("row_id", q.mask(F.col("email"), "partial").alias("email")).limit(20))

# checks
C.add("chk_row_count", lambda spark, d: q.row_count_check(table(spark, d, "orders"), table(spark, d, "raw_orders")), "SELECT a.n AS source_rows, b.n AS target_rows, a.n = b.n AS passed FROM (SELECT count(*) AS n FROM orders) a, (SELECT count(*) AS n FROM raw_orders) b")
C.add("chk_freshness", lambda spark, d: q.freshness(table(spark, d, "events"), "ts", "2024-02-01 00:00:00", 86400), "SELECT CAST(epoch(TIMESTAMP '2024-02-01') AS BIGINT) - CAST(floor(epoch(max(ts))) AS BIGINT) AS lag_s, CAST(epoch(TIMESTAMP '2024-02-01') AS BIGINT) - CAST(floor(epoch(max(ts))) AS BIGINT) <= 86400 AS passed FROM events")
_NULLS = ("customer_id", "status", "total_amount", "_fivetran_synced")
C.add("chk_null_rate", lambda spark, d: q.null_rates(table(spark, d, "raw_orders"), list(_NULLS), 0.02), " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls, count(*) AS rows, (count(*) - count({c})) / count(*) AS null_rate, (count(*) - count({c})) / count(*) <= 0.02 AS passed FROM raw_orders" for c in _NULLS))
C.add("chk_custom", lambda spark, d: q.custom_check(table(spark, d, "orders"), "SELECT count(*) FROM {target} WHERE o_totalprice < 0", 0), "SELECT CAST(count(*) AS DOUBLE) AS value, count(*) <= 0 AS passed FROM orders WHERE o_totalprice < 0")
C.add("chk_cross_source_overlap", lambda spark, d: q.overlap({"c": table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), "s": table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))}, ["k"]), "SELECT k, count(DISTINCT s) AS sources FROM (SELECT c_nationkey AS k, 'c' AS s FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier) WHERE k IS NOT NULL GROUP BY 1 HAVING count(DISTINCT s) > 1")


@C.query("""WITH n AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT *, avg(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS m FROM n)
SELECT day, event_type, n, round(m, 6) AS mean_before, CASE WHEN m IS NULL THEN false WHEN m = 0 THEN n <> 0 ELSE abs(n - m) / abs(m) * 100 > 20 END AS is_anomaly FROM m""")
def chk_anomaly(spark, d):
    n = table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return q.anomalies(n, ["event_type"], "day", "n", 7, 20).withColumn("mean_before", F.round("mean_before", 6))


@C.query("""WITH n AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2), m AS (SELECT *, avg(n) OVER w AS a, stddev_pop(n) OVER w AS s, count(n) OVER w AS k FROM n WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
SELECT day, event_type, n, round(a, 4) AS mean, round(s, 4) AS std, k AS samples, round(CASE WHEN k >= 2 AND s > 0 THEN (n - a) / s END, 4) AS z FROM m""")
def stats_rolling_zscore(spark, d):
    n = table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return q.rolling_stats(n, ["event_type"], ["day"], "n", 7).withColumns({c: F.round(c, 4) for c in ("mean", "std", "z")})


# profiles
_P = ("c_custkey", "c_name", "c_mktsegment")
_num = lambda c: (f"round(avg(CAST({c} AS DOUBLE)), 4)", f"round(stddev_samp(CAST({c} AS DOUBLE)), 4)") if c == "c_custkey" else ("CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)")
_profile_sql = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values, min(CAST({c} AS VARCHAR)) AS min_text, max(CAST({c} AS VARCHAR)) AS max_text, {_num(c)[0]} AS mean, {_num(c)[1]} AS std FROM customer" for c in _P)
C.add("profile_columns", lambda spark, d: q.profile(table(spark, d, "customer"), list(_P)).withColumns({c: F.round(c, 4) for c in ("mean", "std")}), _profile_sql)
C.add("profile_top_k", lambda spark, d: q.top_values(table(spark, d, "raw_orders"), "status", 3), "SELECT status AS value, count(*) AS n FROM raw_orders GROUP BY 1 ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 3")


@C.query("""WITH a AS (SELECT count(*) AS r, count(*) - count(c_mktsegment) AS n, count(DISTINCT c_mktsegment) AS k FROM customer), b AS (SELECT count(*) AS r, count(*) - count(c_mktsegment) AS n, count(DISTINCT c_mktsegment) AS k FROM customer WHERE c_acctbal > 0)
SELECT 'c_mktsegment' AS column_name, round((b.r - a.r) / a.r, 6) AS row_change, round(b.n / b.r - a.n / a.r, 6) AS null_rate_change, round((b.k - a.k) / a.k, 6) AS distinct_change,
CASE WHEN (b.r - a.r) / a.r <= -0.5 THEN 'critical' WHEN abs((b.r - a.r) / a.r) >= 0.1 OR abs((b.k - a.k) / a.k) >= 0.2 THEN 'warning' ELSE 'ok' END AS severity FROM a, b""")
def profile_diff(spark, d):
    c = table(spark, d, "customer")
    return q.profile_diff(q.profile(c, ["c_mktsegment"]), q.profile(c.filter("c_acctbal > 0"), ["c_mktsegment"]))


QUERIES, ORACLE = C.QUERIES, C.ORACLE
