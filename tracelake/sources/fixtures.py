"""Trace tables from the driver's tables, for queries and tests; each with its DuckDB form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times

_DAY = "cast(datediff(o_orderdate, DATE'1990-01-01') as bigint) * 1000000000"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    return _read(spark, sf_dir, "events").select(
        F.lit("t0").alias("trace_id"), "event_id", times.from_timestamp(F.col("ts")).alias("ts_ns"), F.expr("user_id div 10").alias("pid"), user.alias("tid"),
        (user % 4).cast("int").alias("cpu"), F.col("event_type").alias("kind"), "value", F.get_json_object("props", "$.k").cast("int").alias("arg_k"),
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.expr(f"{_DAY} + (o_orderkey % 1000) * 1000000")
    return _read(spark, sf_dir, "orders").select(
        F.lit("t0").alias("trace_id"), F.col("o_orderkey").alias("span_id"), start.alias("start_ns"), (start + (F.col("o_orderkey") % 90 + 1) * times.SECOND).alias("end_ns"),
        F.expr("o_custkey div 10").alias("pid"), F.col("o_custkey").alias("tid"), F.col("o_orderpriority").alias("kind"),
    )


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function for each part, four of seven addresses wide."""
    return _read(spark, sf_dir, "part").selectExpr("'app' as module", "p_partkey * 7 as lo", "p_partkey * 7 + 4 as hi", "p_name as fn")


def module_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions in both modules, with the module's name before those of the library."""
    app = symbols(spark, sf_dir)
    return app.union(app.selectExpr("'lib'", "lo", "hi", "'lib.' || fn"))


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two modules for each process: low addresses all the time, high ones from a time on."""
    pids = _read(spark, sf_dir, "customer").selectExpr("c_custkey div 10 as pid").distinct()
    rows = "explode(array(named_struct('module', 'app', 'base', 0L, 'limit_addr', 1000L, 'load_ns', 0L), named_struct('module', 'lib', 'base', 1000L, 'limit_addr', 1000000000L, 'load_ns', 1000000000000L)))"
    return pids.selectExpr("'t0' as trace_id", "pid", f"{rows} as m").selectExpr("trace_id", "pid", "m.module", "m.base", "m.limit_addr", "m.load_ns", "9000000000000 as unload_ns")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    stacks = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["l_partkey"] * 7 + x["l_partkey"] % 7).alias("frames"))
    joined = _read(spark, sf_dir, "orders").join(stacks, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.selectExpr("'t0' as trace_id", "o_orderkey as sample_id", f"{_DAY} as ts_ns", "o_custkey div 10 as pid", "o_custkey as tid", "frames", "1L as weight")


def stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stack and weight: region, nation and market segment of each order."""
    read = lambda name: _read(spark, sf_dir, name)
    orders = read("orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    joined = orders.join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    joined = joined.join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy(F.array("r_name", "n_name", "c_mktsegment").alias("stack")).agg(F.sum("n").alias("weight"))


def switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).selectExpr("trace_id", "event_id as switch_id", "ts_ns", "cpu", "pid", "tid")


_DUCK_DAY = "date_diff('day', TIMESTAMP '1990-01-01', o_orderdate) * 1000000000"

DUCKDB = {
    "fx_events": "SELECT 't0' AS trace_id, event_id, epoch_us(ts) * 1000 AS ts_ns, user_id // 10 AS pid, user_id AS tid, CAST(user_id % 4 AS INT) AS cpu, event_type AS kind, value, CAST(json_extract_string(props, '$.k') AS INT) AS arg_k FROM events",
    "fx_spans": f"SELECT 't0' AS trace_id, o_orderkey AS span_id, s AS start_ns, s + (o_orderkey % 90 + 1) * 1000000000 AS end_ns, o_custkey // 10 AS pid, o_custkey AS tid, o_orderpriority AS kind FROM (SELECT *, {_DUCK_DAY} + (o_orderkey % 1000) * 1000000 AS s FROM orders)",
    "fx_symbols": "SELECT 'app' AS module, p_partkey * 7 AS lo, p_partkey * 7 + 4 AS hi, p_name AS fn FROM part",
    "fx_module_symbols": "SELECT m AS module, p_partkey * 7 AS lo, p_partkey * 7 + 4 AS hi, CASE WHEN m = 'lib' THEN 'lib.' ELSE '' END || p_name AS fn FROM part, (VALUES ('app'), ('lib')) AS t(m)",
    "fx_modules": "SELECT 't0' AS trace_id, pid, module, base, limit_addr, load_ns, 9000000000000 AS unload_ns FROM (SELECT DISTINCT c_custkey // 10 AS pid FROM customer), (VALUES ('app', 0, 1000, 0), ('lib', 1000, 1000000000, 1000000000000)) AS m(module, base, limit_addr, load_ns)",
    "fx_samples": f"SELECT 't0' AS trace_id, o_orderkey AS sample_id, {_DUCK_DAY} AS ts_ns, o_custkey // 10 AS pid, o_custkey AS tid, frames, CAST(1 AS BIGINT) AS weight FROM orders JOIN (SELECT l_orderkey, list(l_partkey * 7 + l_partkey % 7 ORDER BY l_linenumber, l_partkey, l_suppkey) AS frames FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey",
    "fx_stacks": "SELECT [r_name, n_name, c_mktsegment] AS stack, count(*) AS weight FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name, c_mktsegment",
    "fx_switches": "SELECT 't0' AS trace_id, event_id AS switch_id, epoch_us(ts) * 1000 AS ts_ns, CAST(user_id % 4 AS INT) AS cpu, user_id // 10 AS pid, user_id AS tid FROM events",
}
