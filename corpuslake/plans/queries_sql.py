"""Queries of the SQL surface: each family of relational operations on the driver tables, answered by the engine."""

from __future__ import annotations

from corpuslake.plans.engine import Engine
from corpuslake.plans.registry import query, table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations", "embeddings")


def engine(spark, d) -> Engine:
    return Engine(spark, {t: table(spark, d, t) for t in TABLES})


def both(name: str, text: str, oracle: str | None = None):
    query(name, oracle or text)(lambda spark, d, text=text: engine(spark, d).sql(text))


both("sql_predicates", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal BETWEEN 0 AND 1000 THEN 'low' ELSE 'high' END AS band FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') AND c_name ILIKE '%1%' AND c_nationkey IS NOT NULL")
both("sql_joins", """SELECT n.n_name AS nation, count(DISTINCT c.c_custkey) AS customers, count(o.o_orderkey) AS orders, round(sum(o.o_totalprice), 2) AS total
FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY n.n_name""")
both("sql_full_join", "SELECT coalesce(s_nationkey, c_nationkey) AS nation, ns, nc FROM (SELECT s_nationkey, count(*) AS ns FROM supplier GROUP BY 1) s FULL JOIN (SELECT c_nationkey, count(*) AS nc FROM customer GROUP BY 1) c ON s_nationkey = c_nationkey")
both("sql_semi_anti", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
both("sql_theta_join", "SELECT r.r_name AS region, count(*) AS pairs FROM region r JOIN nation n ON n.n_regionkey >= r.r_regionkey GROUP BY r.r_name")
both("sql_aggregates", """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS price, round(stddev(l_discount), 6) AS spread,
count(DISTINCT l_suppkey) AS suppliers, count(*) FILTER (WHERE l_tax > 0.04) AS taxed, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_returnflag, l_linestatus""")
both("sql_rollup", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
both("sql_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
both("sql_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
both("sql_windows", """SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr,
lag(o_orderkey) OVER w AS prev, lead(o_orderkey) OVER w AS next, first_value(o_orderkey) OVER w AS first_key, ntile(3) OVER w AS third,
round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
both("sql_range_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 500 PRECEDING AND CURRENT ROW) AS near FROM orders")
both("sql_top_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) t WHERE k <= 3", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
both("sql_order_limit", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10 OFFSET 5")
both("sql_set_ops", "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)")
both("sql_correlated", "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_quantity > (SELECT 1.5 * avg(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = l.l_partkey)")
both("sql_recursive", "WITH RECURSIVE t(n) MAX RECURSION LEVEL 1000 AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 250) SELECT count(*) AS n, CAST(sum(n) AS BIGINT) AS total FROM t", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 250) SELECT count(*) AS n, CAST(sum(n) AS BIGINT) AS total FROM t")
both("sql_lateral", "SELECT r_name, x.n_name FROM region r, LATERAL (SELECT n_name FROM nation n WHERE n.n_regionkey = r.r_regionkey ORDER BY n_name LIMIT 2) x")
both("sql_pivot", "SELECT * FROM (SELECT o_orderstatus, o_orderpriority, o_orderkey FROM orders) PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
both("sql_unpivot", "SELECT doc_id, kind, value FROM labels UNPIVOT (value FOR kind IN (quality, toxic))")
both("sql_strings", "SELECT c_custkey, upper(substring(c_name, 1, 4)) AS head, length(c_name) AS len, replace(c_name, '#', '-') AS dashed, trim(concat('  ', c_mktsegment)) AS seg, lpad(CAST(c_nationkey AS STRING), 3, '0') AS padded, split_part(c_name, '#', 2) AS tail FROM customer")
both("sql_regex", "SELECT doc_id, regexp_matches(text, 'ing[. ]') AS has_ing, regexp_replace(substring(lang, 1, 2), '[aeiou]', '_') AS masked, regexp_extract(source, '([0-9]+)', 1) AS number FROM documents")
both("sql_dates", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month_start, CAST(CAST(o_orderdate AS DATE) + INTERVAL 7 DAY AS DATE) AS next_week FROM orders", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month_start, CAST(CAST(o_orderdate AS DATE) + INTERVAL 7 DAY AS DATE) AS next_week FROM orders")
both("sql_math", "SELECT p_partkey, round(sqrt(p_retailprice), 6) AS root, round(ln(p_retailprice), 6) AS log, abs(p_size - 25) AS far, p_partkey % 7 AS rest, CAST(floor(p_retailprice / 100) AS BIGINT) AS hundreds, round(power(p_size, 0.5), 6) AS p FROM part")
both("sql_arrays", "SELECT vec_id, size(embedding) AS n, round(CAST(array_max(embedding) AS DOUBLE), 5) AS most, round(CAST(element_at(embedding, 1) AS DOUBLE), 5) AS first_value, size(filter(embedding, x -> x > 0)) AS positive FROM embeddings", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, round(CAST(list_max(embedding) AS DOUBLE), 5) AS most, round(CAST(embedding[1] AS DOUBLE), 5) AS first_value, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS positive FROM embeddings")
both("sql_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
both("sql_exclude", "SELECT * EXCLUDE (c_name, c_acctbal) FROM customer")
both("sql_group_all", "SELECT l_returnflag, l_linestatus, sum(l_linenumber) AS lines FROM lineitem GROUP BY ALL", "SELECT l_returnflag, l_linestatus, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY ALL")
both("sql_full_text", """WITH words AS (SELECT doc_id, explode(split(lower(text), '[^a-z]+')) AS w FROM documents), tf AS (SELECT doc_id, w, count(*) AS n FROM words WHERE w IN ('idiot', 'licensed', 'apache') GROUP BY doc_id, w)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS hits, count(*) AS terms FROM tf GROUP BY doc_id""", """WITH words AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM documents), tf AS (SELECT doc_id, w, count(*) AS n FROM words WHERE w IN ('idiot', 'licensed', 'apache') GROUP BY doc_id, w)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS hits, count(*) AS terms FROM tf GROUP BY doc_id""")
query("sql_approximate")(lambda spark, d: engine(spark, d).sql("SELECT l_returnflag, approx_count_distinct(l_partkey) AS parts, approx_percentile(l_quantity, 0.5) AS middle FROM lineitem GROUP BY l_returnflag"))
query("sql_sample")(lambda spark, d: engine(spark, d).sql("SELECT l_orderkey, l_linenumber FROM lineitem TABLESAMPLE (10 PERCENT) REPEATABLE (7)"))
both("label_counts", "SELECT quality AS label, count(*) AS n FROM labels GROUP BY quality")
