"""Stored traces: one Parquet dataset for each table, partitioned by trace and time bin."""

from __future__ import annotations

import json
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import schema
from .normalize import normalize


def told(spark: SparkSession, path: str, name: str = "_told") -> dict | None:
    """What the file ``name`` says of a store, or nothing if there is none."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return None
    return json.loads("\n".join(r.value for r in spark.read.text(f"{path}/{name}").collect()))


def tell(spark: SparkSession, path: str, said: dict, name: str = "_told") -> None:
    """Say that of a store."""
    spark.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")


def _meta(spark: SparkSession, path: str) -> dict | None:
    return told(spark, path, "_trace")


def register(spark: SparkSession, path: str, tables: list[str], time_bin_ns: int, longest_span_ns: int = 0) -> None:
    """Add tables to what ``_trace`` says of the store; its time bins must be as wide."""
    known = _meta(spark, path) or {"time_bin_ns": time_bin_ns, "tables": [], "longest_span_ns": 0}
    if known["time_bin_ns"] != time_bin_ns:
        raise ValueError(f"the store has time bins of {known['time_bin_ns']} ns, not {time_bin_ns}")
    said = {"time_bin_ns": time_bin_ns, "tables": sorted({*known["tables"], *tables}), "longest_span_ns": max(known["longest_span_ns"], longest_span_ns)}
    if said != known or not known["tables"]:
        tell(spark, path, said, "_trace")


def write_trace(tables: dict[str, DataFrame], path: str, time_bin_ns: int) -> None:
    """Write each table under ``path``, rows of a time bin together and sorted by process, thread and time.

    Only the partitions that have rows are replaced, so a store takes several
    traces: a time bin of a trace, the modules of a trace, the symbols of a
    module.  Rows are dealt by trace, bin and a hash of thread and time within
    the bin, so that a busy bin, or a busy thread, is written by several tasks.
    """
    spark, longest = next(iter(tables.values())).sparkSession, 0
    known = _meta(spark, path)
    if known and known["time_bin_ns"] != time_bin_ns:
        raise ValueError(f"the store has time bins of {known['time_bin_ns']} ns, not {time_bin_ns}")
    for name, df in tables.items():
        time, target = schema.TIME.get(name), f"{path}/{name}"
        if time is None:
            keys = ["trace_id"] if "trace_id" in df.columns else ["module"]
            df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(target)
            continue
        seen = Observation()
        binned = df.withColumn("time_bin", F.expr(f"({time} - pmod({time}, {time_bin_ns})) div {time_bin_ns}"))  # floor, of negative times too
        dealt = binned.repartition("trace_id", "time_bin", F.pmod(F.xxhash64("tid", F.expr(f"{time} div {max(1, time_bin_ns // 16)}")), F.lit(8)))
        if name == "spans":
            dealt = dealt.observe(seen, F.max(F.col("end_ns") - F.col("start_ns")).alias("longest"))
        dealt.sortWithinPartitions("trace_id", "time_bin", "pid", "tid", time).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trace_id", "time_bin").parquet(target)
        if name == "spans":
            longest = max(longest, seen.get["longest"] or 0)
    register(spark, path, list(tables), time_bin_ns, longest)


def read_trace(spark: SparkSession, path: str, trace_id: str | None = None, t0: int | None = None, t1: int | None = None) -> dict[str, DataFrame]:
    """The stored tables; with a trace and a time range only the partitions and row groups that hold them.

    Instants are kept by ``t0 <= ts < t1``.  Spans are kept if they overlap the
    range; a span is stored in the bin of its start, so bins are read from the
    longest span of the store before the range on.
    """
    meta = _meta(spark, path)
    if meta is None:
        raise FileNotFoundError(f"no trace is stored in {path}")
    width, out = meta["time_bin_ns"], {}
    for name in meta["tables"]:
        columns = [c.split()[0] for c in schema.TABLES[name].split(", ")]
        time = schema.TIME.get(name)
        df = spark.read.schema(schema.TABLES[name] + (", time_bin bigint" if time else "")).parquet(f"{path}/{name}")
        if trace_id is not None and "trace_id" in columns:
            df = df.where(F.col("trace_id") == trace_id)
        if time and t1 is not None:
            df = df.where((F.col("time_bin") <= (t1 - 1) // width) & (F.col(time) < t1))
        if time and t0 is not None:
            first = t0 - meta["longest_span_ns"] if name == "spans" else t0
            df = df.where((F.col("time_bin") >= first // width) & (F.col(time) >= first))
            if name == "spans":
                df = df.where(F.col("end_ns") > t0)
        out[name] = df.select(*columns)
    return out


def import_export(spark: SparkSession, path: str, source: str, fmt: str, **options) -> tuple[DataFrame, DataFrame]:
    """(events, bad rows) from a tool's decoded export as JSON, CSV or Parquet.

    A row that does not parse is a bad row, whose text is in ``_corrupt_record``; Parquet has none.
    """
    wanted = schema.RAW[source]
    if fmt == "parquet":
        raw = spark.read.schema(wanted).parquet(path)
        bad = spark.createDataFrame([], "_corrupt_record string")
    else:
        reader = spark.read.schema(wanted + ", _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
        raw = getattr(reader, fmt)(path, **({"header": True, "escape": '"'} if fmt == "csv" else {}))
        bad = raw.where("_corrupt_record is not null")  # with its other columns: Spark does not read the corrupt one alone
        raw = raw.where("_corrupt_record is null").drop("_corrupt_record")
    return normalize(raw, source, **options), bad


def union_traces(*tables: DataFrame) -> DataFrame:
    """Rows of several traces by column name; a column that one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def to_arrow(df: DataFrame, max_rows: int) -> pa.Table:
    """The result as Arrow, or an error if it has more than ``max_rows`` rows."""
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows:
        raise ValueError(f"the result has more than {max_rows} rows")
    return table


def dedupe_events(events: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One event for each value of the keys: the first by ``order`` (by default all columns that sort, the id first).

    An aggregation, so copies meet on the map side and a key with very many of
    them is no burden; nulls are a key like any other.
    """
    rest = [c for c in events.columns if c not in keys]
    sortable = [c for c, kind in events.dtypes if c in rest and not kind.startswith("map")]
    order = order or [*[c for c in ("event_id",) if c in sortable], *[c for c in sortable if c != "event_id"]]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("__first")
    return events.groupBy(*keys).agg(first).select(*keys, "__first.*").select(*events.columns)
