"""Decision-support queries as SQL text that Spark SQL and DuckDB both run.

Tables stand in braces and are bound to DataFrames when Spark runs a text, so nothing is registered in the
session's catalogue. Sums of doubles are rounded, so that the order of addition doesn't show.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronofold.session import table

_NAME = re.compile(r"\{(\w+)\}")


def spark_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A registered query for a text."""
    names = sorted(set(_NAME.findall(text)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})

    return run


def oracle(text: str) -> str:
    return _NAME.sub(r"\1", text)


_REV = "l_extendedprice * (1 - l_discount)"

TPCH = {
    "tpch_q01": f"""
        SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum({_REV}), 2) AS sum_disc_price,
               round(sum({_REV} * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
        FROM {{lineitem}} WHERE l_shipdate <= DATE '2001-11-01' - INTERVAL '90' DAY GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
    "tpch_q02": """
        SELECT s_acctbal, s_name, n_name, p_partkey, p_brand, cost FROM (
            SELECT l_partkey, l_suppkey, min(l_extendedprice / l_quantity) AS cost FROM {lineitem} GROUP BY l_partkey, l_suppkey) ps
        JOIN {part} ON p_partkey = l_partkey JOIN {supplier} ON s_suppkey = l_suppkey JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
        WHERE p_size BETWEEN 10 AND 30 AND p_type LIKE '%O%' AND r_regionkey = 1
          AND cost = (SELECT min(l2.l_extendedprice / l2.l_quantity) FROM {lineitem} l2 WHERE l2.l_partkey = p_partkey)
        ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
    "tpch_q03": f"""
        SELECT l_orderkey, round(sum({_REV}), 2) AS revenue, o_orderdate FROM {{customer}}, {{orders}}, {{lineitem}}
        WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1998-03-15 00:00:00'
        GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
    "tpch_q04": """
        SELECT o_orderpriority, count(*) AS order_count FROM {orders}
        WHERE o_orderdate >= DATE '1997-07-01' AND o_orderdate < DATE '1997-07-01' + INTERVAL '3' MONTH
          AND EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY o_orderpriority ORDER BY o_orderpriority""",
    "tpch_q05": f"""
        SELECT n_name, round(sum({_REV}), 2) AS revenue FROM {{customer}}, {{orders}}, {{lineitem}}, {{supplier}}, {{nation}}, {{region}}
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey
          AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1996-01-01' + INTERVAL '2' YEAR GROUP BY n_name ORDER BY revenue DESC, n_name""",
    "tpch_q06": """
        SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM {lineitem}
        WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
    "tpch_q07": f"""
        SELECT supp_nation, cust_nation, l_year, round(sum(volume), 2) AS revenue FROM (
            SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(extract(YEAR FROM l_shipdate) AS BIGINT) AS l_year, {_REV} AS volume
            FROM {{supplier}}, {{lineitem}}, {{orders}}, {{customer}}, {{nation}} n1, {{nation}} n2
            WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
              AND ((n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1'))) t
        GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""",
    "tpch_q08": f"""
        SELECT o_year, round(sum(CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM (
            SELECT CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS o_year, {_REV} AS volume, n2.n_name AS nation
            FROM {{part}}, {{supplier}}, {{lineitem}}, {{orders}}, {{customer}}, {{nation}} n1, {{nation}} n2, {{region}}
            WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey
              AND r_regionkey = 1 AND s_nationkey = n2.n_nationkey AND p_size < 25) t
        GROUP BY o_year ORDER BY o_year""",
    "tpch_q09": f"""
        SELECT n_name AS nation, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS o_year, round(sum({_REV}), 2) AS sum_profit
        FROM {{part}}, {{supplier}}, {{lineitem}}, {{orders}}, {{nation}}
        WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_brand LIKE '%1%' GROUP BY 1, 2 ORDER BY nation, o_year DESC""",
    "tpch_q10": f"""
        SELECT c_custkey, c_name, round(sum({_REV}), 2) AS revenue, c_acctbal, n_name FROM {{customer}}, {{orders}}, {{lineitem}}, {{nation}}
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '1997-10-01' AND o_orderdate < DATE '1997-10-01' + INTERVAL '3' MONTH AND l_returnflag = 'R' AND c_nationkey = n_nationkey
        GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "tpch_q11": f"""
        SELECT l_partkey, round(sum({_REV}), 0) AS value FROM {{lineitem}}, {{supplier}} WHERE l_suppkey = s_suppkey AND s_nationkey < 5 GROUP BY l_partkey
        HAVING sum({_REV}) > (SELECT sum({_REV}) * 0.0005 FROM {{lineitem}}, {{supplier}} WHERE l_suppkey = s_suppkey AND s_nationkey < 5) ORDER BY value DESC, l_partkey""",
    "tpch_q12": """
        SELECT l_returnflag, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count, CAST(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
        FROM {orders}, {lineitem} WHERE o_orderkey = l_orderkey AND l_returnflag IN ('R', 'A') AND o_orderdate < l_shipdate AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' GROUP BY l_returnflag ORDER BY l_returnflag""",
    "tpch_q13": """
        SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM {customer} LEFT OUTER JOIN {orders} ON c_custkey = o_custkey AND o_orderstatus NOT LIKE '%F%' GROUP BY c_custkey) t
        GROUP BY c_count ORDER BY custdist DESC, c_count DESC""",
    "tpch_q14": f"""
        SELECT round(100.00 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {_REV} ELSE 0 END) / sum({_REV}), 6) AS promo_revenue
        FROM {{lineitem}}, {{part}} WHERE l_partkey = p_partkey AND l_shipdate >= DATE '1997-09-01' AND l_shipdate < DATE '1997-09-01' + INTERVAL '1' MONTH""",
    "tpch_q15": f"""
        WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum({_REV}), 2) AS total_revenue FROM {{lineitem}} WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-01-01' + INTERVAL '3' MONTH GROUP BY l_suppkey)
        SELECT s_suppkey, s_name, total_revenue FROM {{supplier}}, revenue WHERE s_suppkey = supplier_no AND total_revenue = (SELECT max(total_revenue) FROM revenue) ORDER BY s_suppkey""",
    "tpch_q16": """
        SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM {lineitem}, {part}
        WHERE p_partkey = l_partkey AND p_brand <> 'Brand#45' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9)
          AND l_suppkey NOT IN (SELECT s_suppkey FROM {supplier} WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""",
    "tpch_q17": """
        SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM {lineitem}, {part}
        WHERE p_partkey = l_partkey AND p_brand = 'Brand#12' AND l_quantity < (SELECT 0.5 * avg(l2.l_quantity) FROM {lineitem} l2 WHERE l2.l_partkey = p_partkey)""",
    "tpch_q18": """
        SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, round(sum(l_quantity), 2) AS sum_qty FROM {customer}, {orders}, {lineitem}
        WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem} GROUP BY l_orderkey HAVING sum(l_quantity) > 200) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
        GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""",
    "tpch_q19": f"""
        SELECT round(sum({_REV}), 2) AS revenue FROM {{lineitem}}, {{part}}
        WHERE (p_partkey = l_partkey AND p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 5) OR (p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 10)
           OR (p_partkey = l_partkey AND p_brand = 'Brand#34' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 15)""",
    "tpch_q20": """
        SELECT s_name, s_suppkey FROM {supplier}, {nation} WHERE s_nationkey = n_nationkey AND n_regionkey = 2 AND s_suppkey IN (
            SELECT l_suppkey FROM {lineitem} WHERE l_partkey IN (SELECT p_partkey FROM {part} WHERE p_brand LIKE '%2%')
              AND l_quantity > (SELECT 0.5 * avg(l2.l_quantity) FROM {lineitem} l2 WHERE l2.l_partkey = {lineitem}.l_partkey)) ORDER BY s_name""".replace("FROM {lineitem} WHERE l_partkey IN", "FROM {lineitem} o WHERE l_partkey IN").replace("{lineitem}.l_partkey", "o.l_partkey"),
    "tpch_q21": """
        SELECT s_name, count(*) AS numwait FROM {supplier}, {lineitem} l1, {orders}, {nation}
        WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND s_nationkey = n_nationkey AND n_regionkey = 1
          AND EXISTS (SELECT 1 FROM {lineitem} l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
          AND NOT EXISTS (SELECT 1 FROM {lineitem} l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R') GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
    "tpch_q22": """
        SELECT cntrycode, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM (
            SELECT substring(c_name, length(c_name), 1) AS cntrycode, c_acctbal FROM {customer}
            WHERE substring(c_name, length(c_name), 1) IN ('1', '3', '5', '7') AND c_acctbal > (SELECT avg(c_acctbal) FROM {customer} WHERE c_acctbal > 0.00)
              AND NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'P')) t GROUP BY cntrycode ORDER BY cntrycode""",
}

_E = "{events}"
CLICKS = {
    "clicks_q00": f"SELECT count(*) AS n FROM {_E}",
    "clicks_q01": f"SELECT count(*) AS n FROM {_E} WHERE event_type <> 'view'",
    "clicks_q02": f"SELECT CAST(sum(user_id) AS BIGINT) AS s, count(*) AS n, round(avg(value), 6) AS a FROM {_E}",
    "clicks_q03": f"SELECT round(avg(user_id), 6) AS a FROM {_E}",
    "clicks_q04": f"SELECT count(DISTINCT user_id) AS n FROM {_E}",
    "clicks_q05": f"SELECT count(DISTINCT props) AS n FROM {_E}",
    "clicks_q06": f"SELECT CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM {_E}",
    "clicks_q07": f"SELECT event_type, count(*) AS n FROM {_E} WHERE event_type <> 'view' GROUP BY event_type ORDER BY n DESC, event_type",
    "clicks_q08": f"SELECT event_type, count(DISTINCT user_id) AS u FROM {_E} GROUP BY event_type ORDER BY u DESC, event_type LIMIT 10",
    "clicks_q09": f"SELECT event_type, round(sum(value), 2) AS s, count(*) AS c, round(avg(value), 6) AS a, count(DISTINCT user_id) AS u FROM {_E} GROUP BY event_type ORDER BY c DESC, event_type LIMIT 10",
    "clicks_q10": f"SELECT props, count(DISTINCT user_id) AS u FROM {_E} WHERE props <> '' GROUP BY props ORDER BY u DESC, props LIMIT 10",
    "clicks_q11": f"SELECT event_type, props, count(DISTINCT user_id) AS u FROM {_E} WHERE props <> '' GROUP BY event_type, props ORDER BY u DESC, event_type, props LIMIT 10",
    "clicks_q12": f"SELECT props, count(*) AS c FROM {_E} WHERE props <> '' GROUP BY props ORDER BY c DESC, props LIMIT 10",
    "clicks_q13": f"SELECT props, count(DISTINCT user_id) AS u FROM {_E} WHERE event_type <> 'view' GROUP BY props ORDER BY u DESC, props LIMIT 10",
    "clicks_q14": f"SELECT event_type, props, count(*) AS c FROM {_E} WHERE props <> '' GROUP BY event_type, props ORDER BY c DESC, event_type, props LIMIT 10",
    "clicks_q15": f"SELECT user_id, count(*) AS c FROM {_E} GROUP BY user_id ORDER BY c DESC, user_id LIMIT 10",
    "clicks_q16": f"SELECT user_id, event_type, count(*) AS c FROM {_E} GROUP BY user_id, event_type ORDER BY c DESC, user_id, event_type LIMIT 10",
    "clicks_q17": f"SELECT user_id, event_type, count(*) AS c FROM {_E} GROUP BY user_id, event_type ORDER BY user_id, event_type LIMIT 10",
    "clicks_q18": f"SELECT user_id, CAST(extract(MINUTE FROM ts) AS BIGINT) AS m, event_type, count(*) AS c FROM {_E} GROUP BY user_id, CAST(extract(MINUTE FROM ts) AS BIGINT), event_type ORDER BY c DESC, user_id, m, event_type LIMIT 10",
    "clicks_q19": f"SELECT user_id FROM {_E} WHERE user_id = 42",
    "clicks_q20": "SELECT count(*) AS n FROM {pages} WHERE url LIKE '%ref%'",
    "clicks_q21": "SELECT substring(url, 1, 12) AS k, min(url) AS u, count(*) AS c FROM {pages} WHERE url LIKE '%en%' AND url <> '' GROUP BY 1 ORDER BY c DESC, k LIMIT 10",
    "clicks_q22": "SELECT substring(url, 1, 12) AS k, min(url) AS u, count(*) AS c, count(DISTINCT page_id) AS d FROM {pages} WHERE url LIKE '%en%' AND url NOT LIKE '%ref%' GROUP BY 1 ORDER BY c DESC, k LIMIT 10",
    "clicks_q23": "SELECT page_id, url, CAST(length(html) AS BIGINT) AS n FROM {pages} WHERE url LIKE '%m.%' ORDER BY page_id LIMIT 10",
    "clicks_q24": f"SELECT event_type, event_id FROM {_E} WHERE event_type <> 'view' ORDER BY ts, event_id LIMIT 10",
    "clicks_q25": f"SELECT props FROM {_E} WHERE props <> '' ORDER BY props LIMIT 10",
    "clicks_q26": f"SELECT event_type, ts FROM {_E} WHERE event_type <> '' ORDER BY ts, event_type LIMIT 10",
    "clicks_q27": "SELECT source, round(avg(length(text)), 6) AS l, count(*) AS c FROM {documents} WHERE text <> '' GROUP BY source HAVING count(*) > 5 ORDER BY l DESC, source LIMIT 25",
    "clicks_q29": f"SELECT {', '.join(f'CAST(sum(user_id + {k}) AS BIGINT) AS s{k:02d}' for k in range(90))} FROM {_E}",
    "clicks_q30": f"SELECT event_type, user_id, count(*) AS c, round(sum(value), 2) AS s, round(avg(value), 6) AS a FROM {_E} WHERE props <> '' GROUP BY event_type, user_id ORDER BY c DESC, event_type, user_id LIMIT 10",
    "clicks_q31": f"SELECT event_id, user_id, count(*) AS c, round(sum(value), 2) AS s, round(avg(value), 6) AS a FROM {_E} WHERE props <> '' GROUP BY event_id, user_id ORDER BY c DESC, event_id, user_id LIMIT 10",
    "clicks_q32": f"SELECT event_id, user_id, count(*) AS c, round(sum(value), 2) AS s FROM {_E} GROUP BY event_id, user_id ORDER BY c DESC, event_id, user_id LIMIT 10",
    "clicks_q33": "SELECT url, count(*) AS c FROM {pages} GROUP BY url ORDER BY c DESC, url LIMIT 10",
    "clicks_q34": "SELECT 1 AS one, url, count(*) AS c FROM {pages} GROUP BY 1, url ORDER BY c DESC, url LIMIT 10",
    "clicks_q35": f"SELECT user_id, user_id - 1 AS a, user_id - 2 AS b, user_id - 3 AS d, count(*) AS c FROM {_E} GROUP BY user_id, user_id - 1, user_id - 2, user_id - 3 ORDER BY c DESC, user_id LIMIT 10",
    "clicks_q36": "SELECT o_orderpriority AS k, count(*) AS c FROM {orders} WHERE o_orderstatus = 'F' AND o_orderdate >= DATE '1996-07-01' AND o_orderdate <= DATE '1997-07-31' GROUP BY o_orderpriority ORDER BY c DESC, k LIMIT 10",
    "clicks_q37": "SELECT o_orderstatus AS k, count(*) AS c FROM {orders} WHERE o_orderdate >= DATE '1996-07-01' AND o_orderdate <= DATE '1997-07-31' AND o_orderstatus <> '' GROUP BY o_orderstatus ORDER BY c DESC, k LIMIT 10",
    "clicks_q38": f"SELECT user_id, count(*) AS c FROM {_E} WHERE event_type = 'click' GROUP BY user_id ORDER BY c DESC, user_id LIMIT 10 OFFSET 20",
    "clicks_q39": f"SELECT CASE WHEN event_type IN ('view', 'click') THEN 'read' ELSE event_type END AS src, user_id, count(*) AS c FROM {_E} GROUP BY 1, user_id ORDER BY c DESC, src, user_id LIMIT 10 OFFSET 10",
    "clicks_q40": f"SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS c FROM {_E} WHERE event_type IN ('click', 'error') GROUP BY user_id, CAST(ts AS DATE) ORDER BY c DESC, user_id, d LIMIT 10 OFFSET 10",
    "clicks_q41": f"SELECT event_type, user_id, count(*) AS c FROM {_E} WHERE value > 1 GROUP BY event_type, user_id ORDER BY c DESC, event_type, user_id LIMIT 10 OFFSET 100",
    "clicks_q42": f"SELECT date_trunc('MINUTE', ts) AS m, count(*) AS c FROM {_E} WHERE event_type <> 'error' GROUP BY date_trunc('MINUTE', ts) ORDER BY m LIMIT 10 OFFSET 100",
}

#: Queries whose text differs between the two engines: (Spark, DuckDB).
TWO_TEXTS = {
    "clicks_q28": (
        r"SELECT regexp_replace(url, '^https?://(?:m\\.)?([^/?#]+).*$', '$1') AS k, round(avg(length(url)), 6) AS l, count(*) AS c, min(url) AS u FROM {pages} WHERE url <> '' GROUP BY 1 HAVING count(*) >= 1 ORDER BY l DESC, k LIMIT 25",
        r"SELECT regexp_replace(url, '^https?://(?:m\.)?([^/?#]+).*$', '\1') AS k, round(avg(length(url)), 6) AS l, count(*) AS c, min(url) AS u FROM pages WHERE url <> '' GROUP BY 1 HAVING count(*) >= 1 ORDER BY l DESC, k LIMIT 25",
    ),
    "user_example_star": (
        """SELECT date_trunc('MONTH', o_orderdate) AS month, n_name, min_by(o_orderpriority, struct(o_orderdate, o_orderkey, l_linenumber, o_orderpriority)) AS first_priority, max_by(o_orderpriority, struct(o_orderdate, o_orderkey, l_linenumber, o_orderpriority)) AS last_priority,
           round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice), 2) AS price, round(sum(l_discount), 4) AS disc, round(sum(l_tax), 4) AS tax, count(*) AS n
           FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
           WHERE o_orderdate >= DATE '1997-01-01' GROUP BY date_trunc('MONTH', o_orderdate), n_name ORDER BY month, n_name LIMIT 200""",
        """SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, n_name, arg_min(o_orderpriority, (o_orderdate, o_orderkey, l_linenumber, o_orderpriority)) AS first_priority, arg_max(o_orderpriority, (o_orderdate, o_orderkey, l_linenumber, o_orderpriority)) AS last_priority,
           round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice), 2) AS price, round(sum(l_discount), 4) AS disc, round(sum(l_tax), 4) AS tax, count(*) AS n
           FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
           WHERE o_orderdate >= DATE '1997-01-01' GROUP BY 1, n_name ORDER BY month, n_name LIMIT 200""",
    ),
}

#: Shapes of the relational inventory that the corpora above don't already show.
SHAPES = {
    "P10_null_safe_equal": "SELECT count(*) AS n FROM {customer} c LEFT JOIN {orders} o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P' WHERE o.o_custkey IS NOT DISTINCT FROM NULL",
    "P11_tuple_in": "SELECT l_orderkey, l_linenumber, l_partkey FROM {lineitem} WHERE (l_orderkey, CAST(l_linenumber AS BIGINT)) IN ((CAST(1 AS BIGINT), CAST(1 AS BIGINT)), (CAST(2 AS BIGINT), CAST(1 AS BIGINT)), (CAST(7 AS BIGINT), CAST(2 AS BIGINT))) ORDER BY l_orderkey, l_linenumber, l_partkey",
    "P14_scalar_subquery_select": "SELECT (SELECT count(*) FROM {orders} WHERE o_orderstatus = 'F') AS f, (SELECT count(*) FROM {orders}) AS n",
    "J11_cross_join_series": "SELECT r_regionkey, k FROM {region} CROSS JOIN (VALUES (1), (2), (3)) AS t(k) ORDER BY r_regionkey, k",
    "J16_theta_join": "SELECT a.n_nationkey AS a, count(*) AS n FROM {nation} a JOIN {nation} b ON a.n_nationkey < b.n_nationkey GROUP BY a.n_nationkey ORDER BY a",
    "J18_right_full_join": "SELECT coalesce(a.k, b.k) AS k, a.n AS left_n, b.n AS right_n FROM (SELECT c_nationkey AS k, count(*) AS n FROM {customer} WHERE c_acctbal > 5000 GROUP BY c_nationkey) a FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM {supplier} WHERE s_acctbal > 5000 GROUP BY s_nationkey) b ON a.k = b.k ORDER BY k",
    "A13_bool_and": "SELECT o_orderpriority, bool_and(o_totalprice > 0) AS ok FROM {orders} GROUP BY o_orderpriority ORDER BY o_orderpriority",
    "A27_grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ()) ORDER BY n, q",
    "A27_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus) ORDER BY n",
    "A27_rollup": "SELECT n_regionkey, n_name, count(*) AS n FROM {nation} GROUP BY ROLLUP (n_regionkey, n_name) ORDER BY n, n_name",
    "A22_directory_counts": "SELECT event_type, count(*) AS n FROM {events} GROUP BY event_type ORDER BY event_type",
    "W13_window_functions": "SELECT o_orderkey, CAST(rank() OVER w AS BIGINT) AS r, CAST(dense_rank() OVER w AS BIGINT) AS dr, CAST(ntile(4) OVER w AS BIGINT) AS q, lag(o_totalprice) OVER w AS prev, lead(o_totalprice) OVER w AS next FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "L03_limit_offset": "SELECT o_orderkey FROM {orders} ORDER BY o_orderkey LIMIT 10 OFFSET 25",
    "L10_oldest_top10": "SELECT o_orderkey, o_orderdate FROM {orders} ORDER BY o_orderdate, o_orderkey LIMIT 10",
    "X07_set_operations": "SELECT k FROM ((SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey AS k FROM {supplier}) INTERSECT SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT n_nationkey AS k FROM {nation} WHERE n_regionkey = 0) t ORDER BY k",
    "F29_large_objects": "SELECT page_id, CAST(length(html) AS BIGINT) AS size FROM {pages} WHERE length(html) >= 10000 ORDER BY page_id",
    "S20_seq_scan_count": "SELECT count(*) AS n FROM {lineitem}",
    "J17_delete_using": "SELECT o.o_orderkey, CASE WHEN o.o_orderstatus = 'O' THEN 'X' ELSE o.o_orderstatus END AS status FROM {orders} o WHERE NOT EXISTS (SELECT 1 FROM {customer} c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal < 0)",
    "K_activity_not_in": "SELECT coalesce(round(sum(value), 2), 0) AS v, count(*) AS n, max(ts) AS last FROM {events} WHERE event_type NOT IN ('error', 'signup')",
    "M_connection_counts": "SELECT user_id, event_type, count(*) AS n FROM {events} WHERE event_type <> '' GROUP BY user_id, event_type",
    "M_stats_top10_in": "SELECT user_id, count(*) AS n, round(sum(value), 2) AS v FROM {events} WHERE user_id IN (SELECT user_id FROM {events} GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 10) GROUP BY user_id ORDER BY user_id",
    "M_replication_delay": "SELECT CASE WHEN max(event_id) = max(CASE WHEN event_type = 'click' THEN event_id END) THEN 0 ELSE greatest(0, max(event_id) - max(CASE WHEN event_type = 'click' THEN event_id END)) END AS delay FROM {events}",
    "M_logical_files": "SELECT (SELECT count(*) FROM {pages} WHERE url LIKE '%.html') AS html_files, CAST(coalesce(sum(length(url)), 0) AS BIGINT) AS bytes FROM {pages} WHERE url LIKE 'https%'",
}
