"""SQL models: aggregates, joins, set operations and scalar functions, each with DuckDB's spelling where it differs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.aliases import call
from ..session import table
from .base import Catalogue

C = Catalogue()

# aggregates
C.sql("agg_count", "SELECT l_returnflag, count(*) AS n, count() AS m, count(l_tax) AS k FROM lineitem GROUP BY l_returnflag")
C.sql("agg_count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag")
C.sql("agg_sum", "SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS s, CAST(sum(l_linenumber) AS BIGINT) AS k FROM lineitem GROUP BY l_returnflag")
C.sql("agg_avg", "SELECT l_returnflag, round(avg(l_quantity), 6) AS a FROM lineitem GROUP BY l_returnflag")
C.sql("agg_min_max", "SELECT l_shipmode, min(d) AS lo, max(d) AS hi FROM (SELECT l_returnflag AS l_shipmode, l_shipdate AS d FROM lineitem) GROUP BY l_shipmode")
C.sql("agg_stddev_var", "SELECT c_mktsegment, round(stddev(c_acctbal), 4) AS a, round(stddev_pop(c_acctbal), 4) AS b, round(var_samp(c_acctbal), 2) AS c, round(var_pop(c_acctbal), 2) AS d FROM customer GROUP BY c_mktsegment")
C.sql("agg_corr_covar", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS a, round(covar_pop(l_quantity, l_discount), 6) AS b, round(covar_samp(l_quantity, l_discount), 6) AS c FROM lineitem GROUP BY l_returnflag")
C.sql("agg_median", "SELECT c_mktsegment, round(median(c_acctbal), 4) AS m FROM customer GROUP BY c_mktsegment")
C.sql("agg_bit", "SELECT l_returnflag, bit_and(l_linenumber) AS a, bit_or(l_linenumber) AS b, bit_xor(l_linenumber) AS c FROM lineitem GROUP BY l_returnflag")
C.sql("agg_bool", "SELECT l_returnflag, bool_and(l_quantity > 0) AS a, bool_or(l_quantity > 49) AS b FROM lineitem GROUP BY l_returnflag")
C.sql("agg_collect_sorted", "SELECT r_name, array_join(sort_array(collect_list(n_name)), ',') AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
      "SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
C.sql("agg_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
C.sql("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
C.sql("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
C.sql("agg_filter", "SELECT l_returnflag, count(*) FILTER (WHERE l_discount > 0.05) AS n FROM lineitem GROUP BY l_returnflag")
C.sql("agg_mode", "SELECT tenant, mode() WITHIN GROUP (ORDER BY status) AS status FROM raw_orders GROUP BY tenant",
      "SELECT tenant, status FROM (SELECT tenant, status, row_number() OVER (PARTITION BY tenant ORDER BY n DESC, status) AS i FROM (SELECT tenant, status, count(*) AS n FROM raw_orders WHERE status IS NOT NULL GROUP BY ALL)) WHERE i = 1")
C.sql("agg_any_value", "SELECT n_regionkey, any_value(r_name) AS r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey")
C.sql("agg_collect_set", "SELECT o_custkey, array_join(sort_array(collect_set(o_orderstatus)), ',') AS states FROM orders GROUP BY o_custkey", "SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS states FROM orders GROUP BY o_custkey")


@C.query()
def agg_approx_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))


# joins
C.sql("sql_star_join", """SELECT r_name, n_name, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""")
C.sql("sql_semi_join", "SELECT c_custkey, c_name FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
C.sql("sql_anti_join", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
C.sql("sql_theta_join", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
C.sql("sql_recursive_cte", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT n FROM t")
C.sql("sql_lateral_join", "SELECT n_name, x.hi FROM nation, LATERAL (SELECT max(s_acctbal) AS hi FROM supplier WHERE s_nationkey = n_nationkey) x")
C.sql("sql_ctes", "WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT c_custkey, c_mktsegment FROM customer) SELECT c_mktsegment, sum(n) AS n FROM c JOIN o ON c_custkey = o_custkey GROUP BY 1",
      "WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT c_custkey, c_mktsegment FROM customer) SELECT c_mktsegment, CAST(sum(n) AS BIGINT) AS n FROM c JOIN o ON c_custkey = o_custkey GROUP BY 1")
C.sql("sql_row_value_in", "SELECT o_orderkey FROM orders WHERE (o_orderstatus, o_orderpriority) IN (SELECT o_orderstatus, max(o_orderpriority) FROM orders GROUP BY o_orderstatus)")


@C.query("""SELECT e.event_id, count(*) AS near FROM events e JOIN events f ON f.user_id = e.user_id AND f.ts >= e.ts - INTERVAL 1 HOUR AND f.ts <= e.ts GROUP BY e.event_id""")
def sql_range_join(spark, d):
    """Events of the same user within the hour before: buckets of an hour make it an equi-join."""
    from ..operators.joins import range_join

    e = table(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    f = e.select(F.col("user_id"), F.col("t").alias("u"))
    return range_join(e, f, "t", "u", -3_600_000_000, 0, ["user_id"]).groupBy("event_id").agg(F.count(F.lit(1)).alias("near"))


@C.query("SELECT e.event_id, r.run_id FROM (SELECT * FROM events) e ASOF LEFT JOIN (SELECT max(run_id) AS run_id, started_at + INTERVAL 1820 DAY AS at FROM runs WHERE started_at IS NOT NULL GROUP BY started_at) r ON e.ts >= r.at")
def sql_asof_join(spark, d):
    """The last run started before each event (runs shifted onto the events' time)."""
    from ..operators.joins import asof_join

    e = table(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    r = table(spark, d, "runs").filter("started_at is not null").select((F.unix_micros(F.col("started_at").cast("timestamp")) + 1820 * 86_400_000_000).alias("t"), "run_id")
    return asof_join(e, r.groupBy("t").agg(F.max("run_id").alias("run_id")), "t", [], ["run_id"], 86_400_000_000).select("event_id", "run_id")


C.sql("win_qualify", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")

# set operations
C.sql("set_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
C.sql("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
C.sql("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
C.sql("set_except", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49")


@C.query()
def sample_rows(spark, d):
    return table(spark, d, "orders").sample(fraction=0.1, seed=7)


# scalar functions
C.sql("fn_conditional", "SELECT row_id, coalesce(status, 'none') AS a, nullif(status, 'pending') AS b, ifnull(customer_id, -1) AS c, greatest(customer_id, row_id) AS e, least(customer_id, row_id) AS f, nvl(status, '?') AS g, iff(customer_id > 100, 'x', 'y') AS h, nvl2(status, 'y', 'n') AS i FROM raw_orders",
      "SELECT row_id, coalesce(status, 'none') AS a, nullif(status, 'pending') AS b, ifnull(customer_id, -1) AS c, greatest(customer_id, row_id) AS e, least(customer_id, row_id) AS f, coalesce(status, '?') AS g, CASE WHEN customer_id > 100 THEN 'x' ELSE 'y' END AS h, CASE WHEN status IS NOT NULL THEN 'y' ELSE 'n' END AS i FROM raw_orders")
C.sql("fn_case", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'a' WHEN o_orderstatus = 'F' THEN 'b' END AS x, CASE o_orderstatus WHEN 'O' THEN 1 ELSE 0 END AS y FROM orders")
C.sql("fn_string_basic", "SELECT c_custkey, c_name || '-' || c_mktsegment AS a, concat_ws('/', c_name, c_mktsegment) AS b, upper(c_name) AS c, lower(c_mktsegment) AS d, trim('  x ') AS e, ltrim('  x') AS f, rtrim('x  ') AS g, replace(c_name, 'Customer', 'C') AS h, substring(c_name, 2, 5) AS i, left(c_name, 3) AS j, right(c_name, 3) AS k, lpad(c_mktsegment, 12, '*') AS l, rpad(c_mktsegment, 12, '*') AS m, reverse(c_name) AS n FROM customer")
C.sql("fn_initcap", "SELECT p_partkey, initcap(p_type) AS a FROM part", "SELECT p_partkey, list_aggregate(list_transform(string_split(lower(p_type), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), 'string_agg', ' ') AS a FROM part")
C.sql("fn_string_search", "SELECT p_partkey, CAST(length(p_name) AS BIGINT) AS a, CAST(char_length(p_type) AS BIGINT) AS b, CAST(octet_length(p_name) AS BIGINT) AS c, CAST(strpos(p_type, 'E') AS BIGINT) AS d, CAST(position('A' IN p_type) AS BIGINT) AS e FROM part",
      "SELECT p_partkey, length(p_name) AS a, length(p_type) AS b, CAST(octet_length(encode(p_name)) AS BIGINT) AS c, strpos(p_type, 'E') AS d, strpos(p_type, 'A') AS e FROM part")
C.sql("fn_string_extra", "SELECT p_partkey, translate(p_type, 'AE', '12') AS a, repeat(p_brand, 2) AS b, split_part(p_type, ' ', 1) AS c, startswith(p_type, 'S') AS d, endswith(p_type, 'L') AS e, contains(p_type, 'EE') AS f, ascii(p_type) AS g, chr(65) AS h, format_string('%s:%d', p_brand, p_size) AS i FROM part",
      "SELECT p_partkey, translate(p_type, 'AE', '12') AS a, repeat(p_brand, 2) AS b, split_part(p_type, ' ', 1) AS c, starts_with(p_type, 'S') AS d, ends_with(p_type, 'L') AS e, contains(p_type, 'EE') AS f, ascii(p_type) AS g, chr(65) AS h, printf('%s:%d', p_brand, p_size) AS i FROM part")
C.sql("fn_regex", "SELECT doc_id, regexp_replace(path, '[0-9]+', '#') AS a, regexp_extract(path, '([a-z]+)_', 1) AS b, path RLIKE '_hub_' AS c, CAST(regexp_count(path, '[0-9]') AS BIGINT) AS d FROM documents",
      "SELECT doc_id, regexp_replace(path, '[0-9]+', '#', 'g') AS a, regexp_extract(path, '([a-z]+)_', 1) AS b, regexp_matches(path, '_hub_') AS c, CAST(len(regexp_extract_all(path, '[0-9]')) AS BIGINT) AS d FROM documents")
C.sql("fn_like_ilike", "SELECT doc_id, source LIKE 'r%' AS a, source ILIKE 'R%' AS b, source NOT LIKE '%s' AS c FROM documents")
C.sql("fn_math_round", "SELECT c_custkey, abs(c_acctbal) AS a, CAST(ceil(c_acctbal) AS BIGINT) AS b, CAST(floor(c_acctbal) AS BIGINT) AS c, round(c_acctbal, 1) AS d, CAST(sign(c_acctbal) AS INT) AS e, mod(c_custkey, 7) AS f FROM customer")
C.sql("fn_math_float", "SELECT p_partkey, round(power(p_size, 2), 6) AS a, round(sqrt(p_size), 6) AS b, round(ln(p_size), 6) AS c, round(log10(p_size), 6) AS d, round(log2(p_size), 6) AS e, round(exp(p_size / CAST(50 AS DOUBLE)), 6) AS f, round(sin(p_size), 6) AS g, round(cos(p_size), 6) AS h, round(tan(p_size), 6) AS i, round(pi(), 6) AS j, round(degrees(p_size), 4) AS k, round(radians(p_size), 6) AS l, round(asin(p_size / CAST(51 AS DOUBLE)), 6) AS m, round(acos(p_size / CAST(51 AS DOUBLE)), 6) AS n, round(atan(p_size), 6) AS o, round(atan2(p_size, 3), 6) AS p, round(cbrt(p_size), 6) AS q FROM part")
C.sql("fn_date_parts", "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS a, CAST(month(o_orderdate) AS BIGINT) AS b, CAST(day(o_orderdate) AS BIGINT) AS c, CAST(hour(o_orderdate) AS BIGINT) AS d, CAST(quarter(o_orderdate) AS BIGINT) AS e, CAST(dayofweek(o_orderdate) AS BIGINT) AS f, CAST(dayofyear(o_orderdate) AS BIGINT) AS g, CAST(weekofyear(o_orderdate) AS BIGINT) AS h, CAST(extract(MINUTE FROM o_orderdate) AS BIGINT) AS i FROM orders",
      "SELECT o_orderkey, year(o_orderdate) AS a, month(o_orderdate) AS b, day(o_orderdate) AS c, hour(o_orderdate) AS d, quarter(o_orderdate) AS e, dayofweek(o_orderdate) + 1 AS f, dayofyear(o_orderdate) AS g, weekofyear(o_orderdate) AS h, extract(MINUTE FROM o_orderdate) AS i FROM orders")
C.sql("fn_date_arith", "SELECT o_orderkey, CAST(date_trunc('MONTH', o_orderdate) AS DATE) AS a, date_add(CAST(o_orderdate AS DATE), 10) AS b, date_sub(CAST(o_orderdate AS DATE), 10) AS c, CAST(datediff(DATE '2000-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS d, add_months(CAST(o_orderdate AS DATE), 1) AS e, last_day(CAST(o_orderdate AS DATE)) AS f FROM orders",
      "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS a, CAST(CAST(o_orderdate AS DATE) + 10 AS DATE) AS b, CAST(CAST(o_orderdate AS DATE) - 10 AS DATE) AS c, date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS d, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS e, last_day(CAST(o_orderdate AS DATE)) AS f FROM orders")
C.sql("fn_cast", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS a, CAST(l_linenumber AS STRING) AS b, CAST(l_extendedprice AS DECIMAL(18,1)) AS c, CAST(l_shipdate AS DATE) AS d, CAST(l_linenumber AS BOOLEAN) AS e FROM lineitem",
      "SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity) AS BIGINT) AS a, CAST(l_linenumber AS VARCHAR) AS b, CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)), 1) AS DECIMAL(18,1)) AS c, CAST(l_shipdate AS DATE) AS d, CAST(l_linenumber AS BOOLEAN) AS e FROM lineitem")
C.sql("fn_try_cast", "SELECT DISTINCT execution_id, partition_key, SAFE_CAST(partition_key AS BIGINT) AS a, TRY_CAST(partition_key AS DOUBLE) AS b FROM models",
      "SELECT DISTINCT execution_id, partition_key, TRY_CAST(partition_key AS BIGINT) AS a, TRY_CAST(partition_key AS DOUBLE) AS b FROM models")
C.sql("fn_json_extract", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
C.sql("fn_array_ops", "SELECT vec_id, CAST(size(embedding) AS BIGINT) AS n, element_at(embedding, 1) AS a, array_contains(array(1, 2, 3), label) AS b, round(CAST(array_max(embedding) AS DOUBLE), 5) AS c, CAST(array_position(array(3, 1, 2), label) AS BIGINT) AS d FROM embeddings",
      "SELECT vec_id, len(embedding) AS n, embedding[1] AS a, list_contains([1, 2, 3], label) AS b, round(CAST(list_max(embedding) AS DOUBLE), 5) AS c, CAST(coalesce(list_position([3, 1, 2], label), 0) AS BIGINT) AS d FROM embeddings")
C.sql("fn_explode", "SELECT doc_id, w AS word FROM (SELECT doc_id, explode(split(project, '_')) AS w FROM documents)", "SELECT doc_id, unnest(string_split(project, '_')) AS word FROM documents")
C.sql("fn_map_struct", "SELECT n_nationkey, element_at(map('name', n_name, 'region', CAST(n_regionkey AS STRING)), 'region') AS a, named_struct('k', n_nationkey, 'v', n_name).v AS b FROM nation",
      "SELECT n_nationkey, CAST(n_regionkey AS VARCHAR) AS a, {'k': n_nationkey, 'v': n_name}.v AS b FROM nation")
C.sql("fn_hash", "SELECT c_custkey, md5(c_name) AS a, sha2(c_name, 256) AS b FROM customer", "SELECT c_custkey, md5(c_name) AS a, sha256(c_name) AS b FROM customer")
C.sql("fn_predicates", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 50000 AND 60000 AND o_orderstatus IN ('O', 'F') AND NOT (o_orderpriority LIKE '1%') AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40)")


@C.query()
def fn_now(spark, d):
    return table(spark, d, "region").select("r_regionkey", (call("now", []) >= F.lit("2020-01-01").cast("timestamp")).alias("later"), (call("today", []) >= F.lit("2020-01-01").cast("date")).alias("later_day"))


@C.query("SELECT c_custkey, trunc(c_acctbal) AS a, CASE WHEN c_acctbal > 0 THEN 'p' ELSE 'n' END AS b, strpos(c_name, '0') AS c, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS e, length(c_name) AS f FROM customer")
def fn_aliases(spark, d):
    """Names that Spark lacks, through the alias table."""
    c = F.col
    return table(spark, d, "customer").select(
        "c_custkey", call("trunc", [c("c_acctbal")]).cast("double").alias("a"), call("iff", [c("c_acctbal") > 0, F.lit("p"), F.lit("n")]).alias("b"), call("strpos", [c("c_name"), F.lit("0")]).alias("c"),
        call("decode", [c("c_mktsegment"), F.lit("BUILDING"), F.lit(1), F.lit("MACHINERY"), F.lit(2), F.lit(0)]).alias("e"), call("length", [c("c_name")]).alias("f"),
    )


QUERIES, ORACLE = C.QUERIES, C.ORACLE
