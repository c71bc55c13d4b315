"""Queries in the pipe-style language: every step, expression and window."""

from __future__ import annotations

from .base import Catalogue

C = Catalogue()
_D = "CAST(CAST({} AS DECIMAL(18,2)) AS DECIMAL(18,2))"

C.dsl("dsl_flagship", """
from orders
where o_orderstatus != "P"
group o_custkey { total_revenue: sum(o_totalprice), order_count: count(), avg_order_value: sum(o_totalprice) / count() }
where total_revenue > 100
derive { revenue: round(total_revenue, 2), mean_value: round(avg_order_value, 2) }
select { o_custkey, revenue, order_count, mean_value }
sort revenue desc, o_custkey
take 10
""", """SELECT o_custkey, round(sum(o_totalprice), 2) AS revenue, count(*) AS order_count, round(sum(o_totalprice) / count(*), 2) AS mean_value FROM orders
WHERE o_orderstatus IS DISTINCT FROM 'P' GROUP BY o_custkey HAVING sum(o_totalprice) > 100 ORDER BY 2 DESC, 1 LIMIT 10""")
C.dsl("dsl_from_where", 'from lineitem as l where l.l_quantity > 30 where l_returnflag == "R" or l_returnflag == "A" select { l_orderkey, l_linenumber, l_quantity }',
      "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 30 AND (l_returnflag = 'R' OR l_returnflag = 'A')")
C.dsl("dsl_group_agg", "from lineitem group l_returnflag, l_linestatus { n: count(), qty: sum(l_quantity), lo: min(l_extendedprice), hi: max(l_extendedprice), parts: count_distinct(l_partkey) }",
      "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY ALL")
C.dsl("dsl_group_having", "from orders group o_custkey { n: count() } where n >= 12", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 12")
C.dsl("dsl_global_agg", "from customer group { n: count(), lo: min(c_acctbal), hi: max(c_acctbal) }", "SELECT count(*) AS n, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer")
C.dsl("dsl_derive", "from supplier derive { twice: s_acctbal * 2 } derive { more: twice + 1 } where more > 0", "SELECT *, s_acctbal * 2 AS twice, s_acctbal * 2 + 1 AS more FROM supplier WHERE s_acctbal * 2 + 1 > 0")
C.dsl("dsl_derive_after_group", "from events group event_type { n: count(), users: count_distinct(user_id) } derive { per_user: round(n / users, 6) }",
      "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(count(*) / count(DISTINCT user_id), 6) AS per_user FROM events GROUP BY 1")
C.dsl("dsl_select", "from part derive { big: p_size > 25 } select { p_partkey, p_name } select { p_partkey, big }", "SELECT p_partkey, p_size > 25 AS big FROM part")
_JOIN = 'from nation as n derive {{ r_regionkey: n_regionkey }} {} join region as r on r_regionkey select {{ n_name }}'
for how, sql in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")):
    step = "join" if how == "inner" else how + "_join"
    C.dsl(f"dsl_join_{how}", f"let c = from customer derive {{ custkey: c_custkey }} let o = from orders derive {{ custkey: o_custkey }} from c {step} o as o on custkey {{ keep c.c_name, o.o_orderkey, o.o_totalprice }}",
          f"SELECT c_name, o_orderkey, o_totalprice FROM customer {sql} orders ON c_custkey = o_custkey")
C.dsl("dsl_join_cross", "from nation as n cross join region as r { keep n.n_name, r.r_name }", "SELECT n_name, r_name FROM nation CROSS JOIN region")
C.dsl("dsl_join_multikey", "let a = from lineitem group l_suppkey, l_partkey { a_qty: sum(l_quantity) } let b = from lineitem group l_suppkey, l_partkey { b_n: count() } from a join b on l_suppkey, l_partkey { keep a.l_suppkey, a.l_partkey, a.a_qty, b.b_n }",
      "SELECT l_suppkey, l_partkey, sum(l_quantity) AS a_qty, count(*) AS b_n FROM lineitem GROUP BY 1, 2")
C.dsl("dsl_sort_take", "from orders take 20 sort o_totalprice desc, o_orderkey select { o_orderkey, o_totalprice }", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
C.dsl("dsl_distinct", "from lineitem select { l_returnflag, l_linestatus } distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
C.dsl("dsl_replicate", "replicate nation", "SELECT * FROM nation")
C.dsl("dsl_let_cte", "let big = from orders where o_totalprice > 200_000 let per = from big group o_custkey { n: count() } from per where n > 1", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY 1) SELECT * FROM per WHERE n > 1")
C.dsl("dsl_null_safe_neq", 'from raw_orders where status != "pending" select { row_id, status }', "SELECT row_id, status FROM raw_orders WHERE status IS DISTINCT FROM 'pending'")
C.dsl("dsl_match_case", 'from orders select { o_orderkey, band } derive { band: match o_totalprice { > 250000 => "high", > 100_000 => "middle", _ => "low" } } select { o_orderkey, band }',
      "SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS band FROM orders")
C.dsl("dsl_date_literal", "from orders where o_orderdate >= @1996-01-01 where o_orderdate < @1997-01-01T00:00:00Z select { o_orderkey }", "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01'")
C.dsl("dsl_arith_precedence", "from part derive { a: p_size + 2 * 3 - -p_size % 7, b: (p_size + 2) * 3 } select { p_partkey, a, b }", "SELECT p_partkey, p_size + 2 * 3 - -p_size % 7 AS a, (p_size + 2) * 3 AS b FROM part")
C.dsl("dsl_null_tests", "from models where partition_key is null and partition_start is not null select { execution_id }", "SELECT execution_id FROM models WHERE partition_key IS NULL AND partition_start IS NOT NULL")

_W = "from orders derive {{ x: {} over (partition o_custkey, sort {}) }} select {{ o_orderkey, x }}"
_S = "SELECT o_orderkey, {} OVER (PARTITION BY o_custkey ORDER BY {}) AS x FROM orders"
for name, f, sql, order, duck in (
    ("win_row_number", "row_number()", "row_number()", "-o_totalprice, o_orderkey", "o_totalprice DESC, o_orderkey"),
    ("win_rank", "rank()", "rank()", "o_orderpriority", "o_orderpriority"),
    ("win_dense_rank", "dense_rank()", "dense_rank()", "o_orderpriority", "o_orderpriority"),
    ("win_ntile", "ntile(4)", "ntile(4)", "o_orderdate, o_orderkey", "o_orderdate, o_orderkey"),
    ("win_percent_rank", "percent_rank()", "percent_rank()", "o_orderpriority", "o_orderpriority"),
    ("win_cume_dist", "cume_dist()", "cume_dist()", "o_orderpriority", "o_orderpriority"),
):
    C.dsl(name, _W.format(f, order), _S.format(sql, duck))
C.dsl("win_lag_lead", "from orders derive { before: lag(o_orderkey, 1) over (partition o_custkey, sort o_orderdate, o_orderkey), after: lead(o_orderkey, 2) over (partition o_custkey, sort o_orderdate, o_orderkey) } select { o_orderkey, before, after }",
      "SELECT o_orderkey, lag(o_orderkey, 1) OVER w AS before, lead(o_orderkey, 2) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
C.dsl("win_first_last_nth", "from orders derive { a: first_value(o_orderkey) over (partition o_custkey, sort o_orderdate, o_orderkey, rows unbounded..unbounded), z: last_value(o_orderkey) over (partition o_custkey, sort o_orderdate, o_orderkey, rows unbounded..unbounded), b: nth_value(o_orderkey, 2) over (partition o_custkey, sort o_orderdate, o_orderkey, rows unbounded..unbounded) } select { o_orderkey, a, b, z }",
      "SELECT o_orderkey, first_value(o_orderkey) OVER w AS a, nth_value(o_orderkey, 2) OVER w AS b, last_value(o_orderkey) OVER w AS z FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
C.dsl("win_running_sum", "from orders derive { total: round(sum(o_totalprice) over (partition o_custkey, sort o_orderdate, o_orderkey, rows unbounded..current), 2) } select { o_orderkey, total }",
      "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS total FROM orders")
C.dsl("win_moving_avg", "from lineitem derive { mean: round(avg(l_quantity) over (partition l_suppkey, sort l_shipdate, l_orderkey, l_linenumber, l_extendedprice, rows 2..current), 6) } select { l_orderkey, l_linenumber, mean }",
      "SELECT l_orderkey, l_linenumber, round(avg(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS mean FROM lineitem")
C.dsl("win_rows_frame", "from lineitem derive { m: max(l_quantity) over (partition l_suppkey, sort l_orderkey, l_linenumber, l_partkey, l_extendedprice, rows 1..2) } select { l_orderkey, l_linenumber, m }",
      "SELECT l_orderkey, l_linenumber, max(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS m FROM lineitem")
C.dsl("win_range_frame", "from lineitem derive { n: count() over (partition l_suppkey, sort l_quantity, range 5..5) } select { l_orderkey, l_linenumber, n }",
      "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_quantity RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n FROM lineitem")

QUERIES, ORACLE, TEXTS = C.QUERIES, C.ORACLE, C.texts
