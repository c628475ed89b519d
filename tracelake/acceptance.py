"""General SQL over registered tables: (Spark text, DuckDB text) of each acceptance query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .trace import Trace

_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def query(text: str):
    """A query that runs ``text`` over the tables it names."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if t in text}
        return Trace(used).sql(text)

    return run


_SAME = {
    "sql_join_inner": "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "sql_join_left": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey",
    "sql_join_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)",
    "sql_join_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "sql_join_range": "SELECT o.o_orderkey, count(*) AS n FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_shipdate >= o.o_orderdate GROUP BY o.o_orderkey",
    "sql_group_distinct": "SELECT event_type, count(DISTINCT user_id) AS n_users, count(*) AS n FROM events GROUP BY event_type",
    "sql_grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "sql_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "sql_window_rank": "SELECT o_orderkey, r FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2",
    "sql_window_frame": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS n FROM events",
    "sql_lag_lead": "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts) AS before, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts) AS after FROM events",
    "sql_top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "sql_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "sql_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "sql_except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier",
    "sql_subquery": "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders i WHERE i.o_orderpriority = o.o_orderpriority)",
    "sql_string": "SELECT p_partkey, upper(substring(p_name, 1, 4)) AS head, length(p_name) AS len, replace(p_type, ' ', '_') AS type, concat(p_brand, '/', p_name) AS label FROM part",
    "sql_math": "SELECT p_partkey, p_partkey % 7 AS m, abs(p_size - 25) AS d, CAST(floor(sqrt(p_partkey)) AS BIGINT) AS r, greatest(p_size, 10) AS g FROM part",
}

SQL = {name: (text, text.replace("sqrt(p_partkey)", "sqrt(CAST(p_partkey AS DOUBLE))")) for name, text in _SAME.items()} | {
    "sql_date": (
        "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, datediff(o_orderdate, DATE'1990-01-01') AS days, date_format(o_orderdate, 'yyyy-MM') AS ym FROM orders",
        "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS INT) AS days, strftime(o_orderdate, '%Y-%m') AS ym FROM orders",
    ),
    "sql_array": (
        "SELECT o_custkey, array_join(transform(array_sort(collect_list(o_orderkey)), x -> x * 2), ',') AS keys, size(collect_set(o_orderpriority)) AS n FROM orders GROUP BY o_custkey",
        "SELECT o_custkey, array_to_string(list_transform(list_sort(list(o_orderkey)), lambda x: x * 2), ',') AS keys, CAST(count(DISTINCT o_orderpriority) AS INT) AS n FROM orders GROUP BY o_custkey",
    ),
    "sql_map": (
        "SELECT user_id, m['click'] AS clicks, size(m) AS n FROM (SELECT user_id, map_from_entries(collect_list(struct(event_type, n))) AS m FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) GROUP BY user_id)",
        "SELECT user_id, max(CASE WHEN event_type = 'click' THEN n END) AS clicks, CAST(count(*) AS INT) AS n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type) GROUP BY user_id",
    ),
    "sql_json": (
        "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k, from_json(props, 'k INT').k + 1 AS k1 FROM events",
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(json_extract_string(props, '$.k') AS INT) + 1 AS k1 FROM events",
    ),
}
