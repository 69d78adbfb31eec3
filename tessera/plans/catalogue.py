"""The registered queries of the engine, in its dialect, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.session import Session
from tessera.sources.readers import TABLES, read

ALL = "__same__"
#: name -> (query in the dialect, SQL for DuckDB, or ALL where the same text serves both).
TEXTS: dict[str, tuple[str, str | None]] = {
    "flagship_pricing": (
        "SELECT l_returnflag, l_linestatus, sum(l_quantity::decimal(18,2))::decimal(38,2) AS sum_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY 1, 2 ORDER BY 1, 2",
        "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS sum_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    ),
    "filter_between_in_case": (
        "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' END AS state, coalesce(CASE WHEN o_orderstatus = 'P' THEN 'p' END, 'other') AS c FROM orders WHERE o_totalprice BETWEEN 50000 AND 300000 AND o_orderstatus IN ('O', 'F', 'P') AND o_custkey NOT BETWEEN 10 AND 20 AND o_orderkey NOT IN (1, 2, 3)",
        ALL,
    ),
    "three_valued_logic": (
        "SELECT o_orderkey, (s = 'F') AS a, NOT (s = 'F') AS b, (s = 'F' AND o_totalprice > 0) AS c, (s = 'F' OR o_totalprice > 0) AS d, s IS NULL AS e, s IS NOT NULL AS f, (s = 'F') IS TRUE AS g, (s = 'F') IS NOT FALSE AS h FROM (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END AS s FROM orders) AS x",
        ALL,
    ),
    "int_div_mod": (
        "SELECT l_orderkey, l_partkey, (0 - l_partkey) / 7 AS d, l_orderkey / (l_linenumber - 1) AS z, (0 - l_partkey) % 7 AS m, l_orderkey % (l_linenumber - 1) AS y, 3 / 2.0 AS f FROM lineitem",
        "SELECT l_orderkey, l_partkey, (0 - l_partkey) // 7 AS d, l_orderkey // nullif(l_linenumber - 1, 0) AS z, (0 - l_partkey) % 7 AS m, l_orderkey % nullif(l_linenumber - 1, 0) AS y, CAST(1.5 AS DOUBLE) AS f FROM lineitem",
    ),
    "arithmetic": (
        "SELECT l_orderkey, l_linenumber, -l_linenumber AS neg, +l_linenumber AS pos, l_linenumber + 2 * 3 - 1 AS e, l_quantity * 2 AS q, l_quantity - 1.5 AS r, 'x' || l_linenumber AS s, (l_linenumber > 3) || (l_quantity > 40) AS t FROM lineitem",
        "SELECT l_orderkey, l_linenumber, -l_linenumber AS neg, l_linenumber AS pos, l_linenumber + 2 * 3 - 1 AS e, l_quantity * 2 AS q, CAST(l_quantity - 1.5 AS DOUBLE) AS r, 'x' || l_linenumber AS s, l_linenumber > 3 OR l_quantity > 40 AS t FROM lineitem",
    ),
    "regex_match": (
        "SELECT p_partkey, p_name ~ 'A' AS a, p_name !~* 'b' AS b, '^p' ?~ p_name AS c, grep('[a-z]+', p_name) AS d, grepn('([a-z])([a-z])', p_name, 2) AS e, subst('[aeiou]', p_name, '*') AS f FROM part",
        "SELECT p_partkey, regexp_matches(p_name, 'A', 'i') AS a, NOT regexp_matches(p_name, 'b', 'i') AS b, regexp_matches(p_name, '^p') AS c, nullif(regexp_extract(p_name, '[a-z]+'), '') AS d, CASE WHEN regexp_matches(p_name, '([a-z])([a-z])') THEN regexp_extract(p_name, '([a-z])([a-z])', 2) END AS e, regexp_replace(p_name, '[aeiou]', '*', 'g') AS f FROM part",
    ),
    "string_funcs": (
        "SELECT p_partkey, concat(p_name, '-', p_partkey) AS a, length(p_name) AS b, maxwidth(p_name, 5) AS c, substr(p_name, 1, 4) AS d, substr(p_name, 4, 1) AS e, splitcomp(p_name, ' ', 1) AS f, p_name.upper().lower() AS g, empty(p_name) AS h, format('%05d|%-4s|%.2f', p_partkey, 'ab', 1.5) AS i FROM part",
        "SELECT p_partkey, p_name || '-' || p_partkey AS a, CAST(length(p_name) AS BIGINT) AS b, CASE WHEN length(p_name) <= 5 THEN p_name ELSE substr(p_name, 1, 5) || '...' END AS c, substr(p_name, 2, 3) AS d, substr(p_name, 2, 3) AS e, string_split(p_name, ' ')[2] AS f, lower(p_name) AS g, length(p_name) = 0 AS h, printf('%05d|%-4s|%.2f', p_partkey, 'ab', 1.5) AS i FROM part",
    ),
    "math_funcs": (
        "SELECT o_orderkey, abs(0 - o_orderkey) AS a, round(o_totalprice::decimal(18,4))::decimal(18,2) AS b, safediv(o_orderkey, o_orderkey % 2)::double AS c, toFixed(o_orderkey, 2) AS d FROM orders",
        "SELECT o_orderkey, o_orderkey AS a, CAST(round(CAST(o_totalprice AS DECIMAL(18,4)), 2) AS DECIMAL(18,2)) AS b, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE o_orderkey / 1 END::DOUBLE AS c, o_orderkey || '.00' AS d FROM orders",
    ),
    "cast_funcs": (
        "SELECT o_orderkey, bool(o_orderkey - 1) AS a, int('x12y') AS b, int(o_totalprice) = int(o_totalprice) AS c, number('2.5') AS d, text(o_orderkey = 1) AS e, o_orderkey::text AS f, datetime('2024-02-03') AS g, timestamp('2024-02-03 04:05:06') AS h, numeric('1,234.5')::decimal(10,2) AS i FROM orders",
        "SELECT o_orderkey, o_orderkey <> 1 AS a, CAST(12 AS BIGINT) AS b, true AS c, CAST(2.5 AS DOUBLE) AS d, CASE WHEN o_orderkey = 1 THEN 'TRUE' ELSE 'FALSE' END AS e, CAST(o_orderkey AS VARCHAR) AS f, TIMESTAMP '2024-02-03' AS g, TIMESTAMP '2024-02-03 04:05:06' AS h, CAST(1234.5 AS DECIMAL(10,2)) AS i FROM orders",
    ),
    "date_funcs": (
        "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, yearmonth(o_orderdate) AS ym, quarter(o_orderdate) AS q, weekday(o_orderdate) AS w, date_diff(o_orderdate, '1992-01-01') AS diff, date_add(o_orderdate, 3) AS plus, date_trunc('week', o_orderdate) AS wk, date_end('month', o_orderdate) AS me, date_part('isodow', o_orderdate) AS dow, date_part('decade', o_orderdate) AS dec, o_orderdate.weekNumber AS wn, o_orderdate.ordinal AS od, o_orderdate + INTERVAL '1 day 2 hours' AS pi, to_char(o_orderdate, 'yyyy/MM/dd') AS ch FROM orders",
        "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS ym, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS q, strftime(o_orderdate, '%a') AS w, date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS diff, o_orderdate + INTERVAL 3 DAY AS plus, CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS wk, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH - INTERVAL 1 MILLISECOND AS TIMESTAMP) AS me, isodow(o_orderdate) AS dow, year(o_orderdate) // 10 AS dec, week(o_orderdate) AS wn, dayofyear(o_orderdate) AS od, o_orderdate + INTERVAL 26 HOUR AS pi, strftime(o_orderdate, '%Y/%m/%d') AS ch FROM orders",
    ),
    "date_bin_events": (
        "SELECT date_bin(INTERVAL '15 minutes', ts, '2020-01-01') AS b, count(*) AS n FROM events GROUP BY 1",
        "SELECT time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '2020-01-01') AS b, count(*) AS n FROM events GROUP BY 1",
    ),
    "json_subscript": (
        "SELECT event_id, getitem(props, 'k') AS a, getitem(props, 'missing', 'none') AS b FROM events",
        "SELECT event_id, json_extract_string(props, '$.k') AS a, coalesce(json_extract_string(props, '$.missing'), 'none') AS b FROM events",
    ),
    "array_map": (
        "SELECT p_partkey, map([p_partkey, 2, 3], value * 2 + index) AS a, joinstr(['x', p_name]) AS b, findFirst('^p', ['q', 'pa', 'pb']) AS c FROM part",
        "SELECT p_partkey, [p_partkey * 2, 5, 8] AS a, 'x, ' || p_name AS b, 'pa' AS c FROM part",
    ),
    "any_all_list": (
        "SELECT o_orderkey, o_orderkey = ANY(1, 2, 3) AS a, o_orderkey > ALL(1, 2, 3) AS b, 2 IN () AS c FROM orders",
        "SELECT o_orderkey, o_orderkey IN (1, 2, 3) AS a, o_orderkey > 3 AS b, false AS c FROM orders",
    ),
    "join_inner_multi": ("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", ALL),
    "join_left": ("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 300000) AS o ON c.c_custkey = o.o_custkey", ALL),
    "join_right": ("SELECT o.o_orderkey, c.c_custkey FROM (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 300000) AS o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey", ALL),
    "join_full": ("SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM (SELECT n_nationkey FROM nation WHERE n_nationkey < 15) AS a FULL JOIN (SELECT n_nationkey FROM nation WHERE n_nationkey > 9) AS b ON a.n_nationkey = b.n_nationkey", ALL),
    "join_cross": ("SELECT n_name, r_name FROM nation CROSS JOIN region", ALL),
    "join_comma": ("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey", ALL),
    "join_anti": (
        "SELECT c_custkey FROM customer ANTI JOIN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) AS o ON c_custkey = o.o_custkey",
        "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 200000 AND o_custkey = c_custkey)",
    ),
    "join_using": ("SELECT a.k, a.v AS x, b.v AS y FROM (SELECT n_nationkey AS k, n_name AS v FROM nation) AS a JOIN (SELECT r_regionkey AS k, r_name AS v FROM region) AS b USING (k)", ALL),
    "join_theta": ("SELECT a.n_nationkey AS x, b.r_regionkey AS y FROM nation a JOIN region b ON a.n_regionkey < b.r_regionkey", ALL),
    "join_subquery": ("SELECT c_custkey, t.n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) AS t ON c_custkey = t.o_custkey", ALL),
    "scalar_subquery": ("SELECT c_custkey, (SELECT max(n_nationkey) FROM nation) AS m FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)", ALL),
    "corr_scalar_neq": ("SELECT s_suppkey, (SELECT count(*) FROM supplier AS x WHERE x.s_suppkey < supplier.s_suppkey) AS n FROM supplier", ALL),
    "exists_neq": ("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM supplier AS x WHERE x.s_suppkey < supplier.s_suppkey AND x.s_nationkey = supplier.s_nationkey)", ALL),
    "in_subquery": ("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)", ALL),
    "not_in_subquery": ("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT CASE WHEN n_regionkey > 5 THEN NULL ELSE n_nationkey END FROM nation WHERE n_regionkey = 1)", ALL),
    "any_subquery": ("SELECT s_suppkey FROM supplier WHERE s_nationkey > ANY (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)", ALL),
    "all_subquery": ("SELECT s_suppkey FROM supplier WHERE s_nationkey > ALL (SELECT r_regionkey FROM region)", ALL),
    "cte_chain": ("WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT n, count(*) AS m FROM a GROUP BY n) SELECT n, m FROM b", ALL),
    "from_subquery": ("SELECT x.k, x.p FROM (SELECT o_orderkey AS k, o_totalprice AS p FROM orders) AS x WHERE x.p > 1000", ALL),
    "group_having": ("SELECT o_custkey, count(*) AS n, min(o_orderkey) AS lo FROM orders GROUP BY o_custkey HAVING count(*) > 12", ALL),
    "implicit_group": ("SELECT o_orderstatus, count(*) AS n FROM orders", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1"),
    "agg_filter": ("SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS n, max(o_orderkey) FILTER (WHERE o_custkey < 50) AS m FROM orders GROUP BY 1", ALL),
    "agg_distinct": ("SELECT o_orderstatus, count(DISTINCT o_custkey) AS n, sum(DISTINCT o_custkey)::bigint AS s FROM orders GROUP BY 1", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS s FROM orders GROUP BY 1"),
    "agg_min_max_avg": ("SELECT l_returnflag, min(l_quantity) AS a, max(l_quantity) AS b, round(avg(l_quantity), 4) AS c, min(l_shipdate) AS d FROM lineitem GROUP BY 1", ALL),
    "agg_empty": ("SELECT count(*) AS n, sum(o_orderkey) AS s, avg(o_orderkey) AS v FROM orders WHERE o_orderkey < 0", "SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS s, CAST(0 AS DOUBLE) AS v"),
    "array_agg_ordered": ("SELECT o_custkey, array_agg(o_orderkey ORDER BY o_orderkey) AS a FROM orders GROUP BY 1", ALL),
    "group_concat_ordered": ("SELECT n_regionkey, group_concat(n_name, '|' ORDER BY n_name) AS g FROM nation GROUP BY 1", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS g FROM nation GROUP BY 1"),
    "first_last": (
        "SELECT o_custkey, first(o_orderstatus ORDER BY o_orderkey) AS f, last(o_orderstatus ORDER BY o_orderkey) AS l FROM orders GROUP BY 1",
        "SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS f, arg_max(o_orderstatus, o_orderkey) AS l FROM orders GROUP BY 1",
    ),
    "win_rank": ("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate) AS k, dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate) AS d FROM orders", ALL),
    "win_lead_lag": ("SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a, lag(o_orderkey, 2, 0) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders", ALL),
    "win_first_last_nth": ("SELECT o_orderkey, first_value(o_orderkey) OVER w AS a, last_value(o_orderkey) OVER w AS b, nth_value(o_orderkey, 2) OVER w AS c FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)", ALL),
    "win_rows": ("SELECT o_orderkey, sum(o_custkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)::bigint AS s, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders", "SELECT o_orderkey, CAST(sum(o_custkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS s, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders"),
    "win_range_num": ("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 100 PRECEDING AND 50 FOLLOWING) AS n FROM orders", ALL),
    "win_range_time": ("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1 day' PRECEDING AND CURRENT ROW) AS n FROM events", ALL),
    "win_groups": ("SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate GROUPS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS n, max(o_orderkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS m FROM orders", ALL),
    "win_exclude_current": ("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING EXCLUDE CURRENT ROW) AS n, max(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING EXCLUDE CURRENT ROW) AS m FROM orders", ALL),
    "win_exclude_group": ("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderstatus GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE GROUP) AS n FROM orders", ALL),
    "win_exclude_ties": ("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderstatus GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE TIES) AS n FROM orders", ALL),
    "win_filter": ("SELECT o_orderkey, count(*) FILTER (WHERE o_totalprice > 100000) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders", ALL),
    "win_distinct": ("SELECT o_orderkey, count(DISTINCT o_orderstatus) OVER (PARTITION BY o_custkey) AS n FROM orders", ALL),
    "win_nested_agg": ("SELECT o_custkey, sum(count(*)) OVER (ORDER BY o_custkey)::bigint AS s FROM orders GROUP BY o_custkey", "SELECT o_custkey, CAST(sum(count(*)) OVER (ORDER BY o_custkey) AS BIGINT) AS s FROM orders GROUP BY o_custkey"),
    "win_named": ("SELECT o_orderkey, count(*) OVER (w ORDER BY o_orderkey) AS a, count(*) OVER w AS b FROM orders WINDOW w AS (PARTITION BY o_custkey)", ALL),
    "order_nulls": (
        "SELECT k, row_number() OVER (ORDER BY s, k) AS a, row_number() OVER (ORDER BY s DESC, k) AS d FROM (SELECT o_orderkey AS k, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END AS s FROM orders) AS x",
        "SELECT k, row_number() OVER (ORDER BY s ASC NULLS LAST, k) AS a, row_number() OVER (ORDER BY s DESC NULLS FIRST, k) AS d FROM (SELECT o_orderkey AS k, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END AS s FROM orders) AS x",
    ),
    "topk": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", ALL),
    "distinct_rows": ("SELECT DISTINCT o_orderstatus, year(o_orderdate) AS y FROM orders ORDER BY y", "SELECT DISTINCT o_orderstatus, year(o_orderdate) AS y FROM orders"),
    "union_all": ("SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region", ALL),
    "union_distinct": ("SELECT n_regionkey AS x FROM nation UNION SELECT r_regionkey FROM region", ALL),
    "except_all": ("SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer", ALL),
    "intersect_all": ("SELECT o_custkey AS k FROM orders INTERSECT ALL SELECT c_custkey FROM customer", ALL),
    "order_by_subquery": (
        "SELECT s_suppkey FROM supplier ORDER BY (SELECT count(*) FROM supplier AS x WHERE x.s_suppkey < supplier.s_suppkey) DESC LIMIT 5",
        "SELECT s_suppkey FROM supplier ORDER BY s_suppkey DESC LIMIT 5",
    ),
    "pivot_by": (
        "SELECT year(o_orderdate) AS y, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2 PIVOT BY y, o_orderstatus",
        "SELECT year(o_orderdate) AS \"y/o_orderstatus\", nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS \"F\", nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS \"O\", nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS \"P\" FROM orders GROUP BY 1",
    ),
    "wildcard_dates": (
        "SELECT t.* FROM (SELECT o_orderkey AS k, o_orderdate AS d FROM orders) AS t",
        "SELECT o_orderkey AS k, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS \"d.date\", year(o_orderdate) AS \"d.year\", month(o_orderdate) AS \"d.month\", day(o_orderdate) AS \"d.day\" FROM orders",
    ),
    "dml_script": (
        "CREATE TABLE g (id integer NOT NULL, name varchar DEFAULT 'Pop', price decimal(10,2), CHECK (id > 0)); INSERT INTO g (id, name, price) VALUES (1, 'Rock', 1.5), (2, 'Jazz', 2.25); INSERT INTO g (id) VALUES (3); UPDATE g SET name = 'Blues', price = price * 2 WHERE id = 2; DELETE FROM g WHERE id = 1; SELECT id, name, price FROM g",
        "SELECT CAST(id AS BIGINT) AS id, name, CAST(price AS DECIMAL(10,2)) AS price FROM (VALUES (2, 'Blues', 4.50), (3, 'Pop', NULL)) AS v(id, name, price)",
    ),
    "agg_order_desc": (
        "SELECT o_custkey, array_agg(o_orderkey ORDER BY o_orderkey DESC) AS a, group_concat(o_orderstatus, '' ORDER BY o_orderstatus DESC, o_orderkey) AS g, first(o_orderkey ORDER BY o_orderkey DESC) AS f, last(o_orderkey ORDER BY o_orderkey DESC) AS l, first(o_orderkey ORDER BY o_orderstatus DESC, o_orderkey) AS m FROM orders GROUP BY 1",
        "SELECT o_custkey, array_agg(o_orderkey ORDER BY o_orderkey DESC) AS a, string_agg(o_orderstatus, '' ORDER BY o_orderstatus DESC, o_orderkey) AS g, max(o_orderkey) AS f, min(o_orderkey) AS l, first(o_orderkey ORDER BY o_orderstatus DESC, o_orderkey) AS m FROM orders GROUP BY 1",
    ),
    "agg_order_nulls": (
        "SELECT k, array_agg(o ORDER BY v NULLS FIRST, o) AS a, array_agg(o ORDER BY v DESC NULLS LAST, o) AS b, first(o ORDER BY v NULLS FIRST, o) AS c, last(v ORDER BY v) AS d FROM (SELECT o_custkey AS k, o_orderkey AS o, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END AS v FROM orders) AS x GROUP BY k",
        "SELECT k, array_agg(o ORDER BY v NULLS FIRST, o) AS a, array_agg(o ORDER BY v DESC NULLS LAST, o) AS b, first(o ORDER BY v NULLS FIRST, o) AS c, CASE WHEN count(v) = count(*) THEN max(v) END AS d FROM (SELECT o_custkey AS k, o_orderkey AS o, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END AS v FROM orders) AS x GROUP BY k",
    ),
    "set_op_limits": ("(SELECT o_orderkey AS k FROM orders ORDER BY o_orderkey DESC LIMIT 3) UNION ALL (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 2) UNION ALL SELECT n_nationkey FROM nation", ALL),
    "set_op_order": ("(SELECT n_name AS x FROM nation ORDER BY n_name LIMIT 9) EXCEPT (SELECT n_name FROM nation ORDER BY n_name LIMIT 2) ORDER BY x DESC LIMIT 4", ALL),
    "win_distinct_avg_sum": (
        "SELECT o_orderkey, avg(DISTINCT o_orderkey % 5) OVER (PARTITION BY o_custkey) AS a, (sum(DISTINCT o_orderkey % 4) OVER (PARTITION BY o_custkey))::bigint AS s FROM orders",
        "SELECT o_orderkey, avg(DISTINCT o_orderkey % 5) OVER (PARTITION BY o_custkey) AS a, CAST(sum(DISTINCT o_orderkey % 4) OVER (PARTITION BY o_custkey) AS BIGINT) AS s FROM orders",
    ),
    "win_exclude_sum": (
        "SELECT o_orderkey, sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING EXCLUDE CURRENT ROW)::bigint AS s, round(avg(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING EXCLUDE CURRENT ROW), 6) AS a FROM orders",
        "SELECT o_orderkey, CAST(coalesce(sum(o_orderkey) OVER w, 0) AS BIGINT) AS s, coalesce(round(avg(o_orderkey) OVER w, 6), 0) AS a FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING EXCLUDE CURRENT ROW)",
    ),
    "win_last_filter": (
        "SELECT o_orderkey, last(o_orderkey) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS l FROM orders",
        "SELECT o_orderkey, last_value(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS l FROM orders",
    ),
    "win_groups_join": (
        "SELECT o_orderkey, c_nationkey, count(*) OVER (PARTITION BY c_nationkey ORDER BY o_orderdate GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW EXCLUDE CURRENT ROW) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000",
        ALL,
    ),
    "interval_text": (
        "SELECT event_id, (ts + interval('2 hours 30 minutes')) AS a, (ts - '1 day'::interval) AS b, date_bin(interval '7 minutes', ts, '2000-01-01 00:00:03'::timestamp) AS c FROM events",
        "SELECT event_id, CAST(ts + INTERVAL '150 minutes' AS TIMESTAMP) AS a, CAST(ts - INTERVAL '1 day' AS TIMESTAMP) AS b, CAST(time_bucket(INTERVAL '7 minutes', ts, TIMESTAMP '2000-01-01 00:00:03') AS TIMESTAMP) AS c FROM events",
    ),
    "regex_not": ("SELECT p_partkey, p_name !~ 'A' AS a, p_name ~* 'B' AS b, '^P' ?~* p_name AS c FROM part", "SELECT p_partkey, NOT regexp_matches(p_name, 'A', 'i') AS a, regexp_matches(p_name, 'B', 'i') AS b, regexp_matches(p_name, '^P', 'i') AS c FROM part"),
    "ctas_drop": (
        "CREATE TABLE big AS SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey; CREATE TABLE gone AS SELECT 1 AS x; DROP TABLE gone; DROP TABLE IF EXISTS gone; SELECT * FROM big WHERE n > 5",
        "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 5",
    ),
    "select_all_quoted": ("SELECT ALL o_orderkey AS \"the key\", boolean('true') AS b, boolean(0) AS c, repr(o_orderstatus) AS r FROM orders", "SELECT o_orderkey AS \"the key\", true AS b, false AS c, o_orderstatus AS r FROM orders"),
    "today_now": ("SELECT n_nationkey, today() <= now() AS a, now() > parse_date('2020-01-02') AS b, parse_date('03/02/2021', 'dd/MM/yyyy') AS c FROM nation", "SELECT n_nationkey, true AS a, true AS b, TIMESTAMP '2021-02-03' AS c FROM nation"),
    "to_char_number": ("SELECT o_orderkey, to_char(o_totalprice, '999999.99') AS a FROM orders", "SELECT o_orderkey, printf('%.2f', o_totalprice) AS a FROM orders"),
    "dual_constants": ("SELECT 1 + 2 AS a, 'x' AS b, NULL AS c, 7 / 2 AS d, INTERVAL '1 day' > INTERVAL '2 hours' AS e", "SELECT 3 AS a, 'x' AS b, NULL AS c, 3 AS d, true AS e"),
}


#: name -> (query, its parameters, SQL for DuckDB).
WITH_PARAMETERS: dict[str, tuple[str, list | dict, str]] = {
    "params_text_order": (
        "SELECT count(*) FILTER (WHERE o_orderstatus = ?) AS n, ? AS b, o_custkey % ? AS g FROM orders WHERE o_totalprice > ? GROUP BY 3 HAVING count(*) > ?",
        ["F", "text", 7, 50000, 3],
        "SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS n, 'text' AS b, o_custkey % 7 AS g FROM orders WHERE o_totalprice > 50000 GROUP BY 3 HAVING count(*) > 3",
    ),
    "params_named": ("SELECT o_orderkey, %(status)s AS s FROM orders WHERE o_orderstatus = %(status)s", {"status": "F"}, "SELECT o_orderkey, 'F' AS s FROM orders WHERE o_orderstatus = 'F'"),
}


def session(spark: SparkSession, sf_dir: str, tables: list[str] = TABLES) -> Session:
    """A session over the driver's tables, for queries in the dialect."""
    own = Session(spark, expand=True)
    for name in tables:
        own.register(name, read(spark, f"{sf_dir}/{name}.parquet"))
    return own


def _query(text: str, params: list | dict | None = None) -> Callable[[SparkSession, str], DataFrame]:
    used = [t for t in TABLES if t in text]
    return lambda spark, sf_dir: session(spark, sf_dir, used).execute(text, params)


def user_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's aggregate, grouped with FILTER, and overloads of a user's function."""
    own = session(spark, sf_dir, ["orders"])
    own.register_aggregate("spread", "number", sql=lambda x: f"cast(max({x}) OVER () - min({x}) OVER () as double)")
    own.register_function("twice", "int", sql=lambda x: f"({x} * 2L)", args=["int"])
    own.register_function("twice", "str", sql=lambda x: f"concat({x}, {x})", args=["str"])
    return own.execute("SELECT o_orderstatus, spread(o_totalprice) AS s, spread(o_totalprice) FILTER (WHERE o_custkey < 100) AS f, spread(max(o_totalprice)) OVER () AS w, twice(count(*)) AS n, twice(o_orderstatus) AS t FROM orders GROUP BY o_orderstatus")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _query(text) for name, (text, _) in TEXTS.items()}
QUERIES |= {name: _query(text, params) for name, (text, params, _) in WITH_PARAMETERS.items()} | {"user_aggregate": user_aggregate}
ORACLE_SQL: dict[str, str] = {name: text if oracle is ALL else oracle for name, (text, oracle) in TEXTS.items() if oracle}
ORACLE_SQL |= {name: oracle for name, (*_, oracle) in WITH_PARAMETERS.items()} | {
    "user_aggregate": "SELECT o_orderstatus, CAST(max(o_totalprice) - min(o_totalprice) AS DOUBLE) AS s, CAST(max(o_totalprice) FILTER (WHERE o_custkey < 100) - min(o_totalprice) FILTER (WHERE o_custkey < 100) AS DOUBLE) AS f, CAST(max(max(o_totalprice)) OVER () - min(max(o_totalprice)) OVER () AS DOUBLE) AS w, count(*) * 2 AS n, o_orderstatus || o_orderstatus AS t FROM orders GROUP BY o_orderstatus",
}
