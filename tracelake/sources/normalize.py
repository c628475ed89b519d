"""Decoded rows of a recording system to the common event format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times

#: Native event names to kinds of the common format; any other name is its own kind.
KINDS = {
    "linux": {"sched:sched_switch": "switch", "block:block_rq_issue": "io_start", "block:block_rq_complete": "io_end"},
    "macos": {"sched:::on-cpu": "switch", "io:::start": "io_start", "io:::done": "io_end"},
    "windows": {"Thread/CSwitch": "switch", "DiskIo/ReadInit": "io_start", "DiskIo/Read": "io_end"},
}


def _kind(native: Column, source: str) -> Column:
    names = [F.lit(x) for pair in KINDS[source].items() for x in pair]
    return F.coalesce(F.create_map(*names)[native], native)


def _args(payload: Column) -> Column:
    return F.from_json(payload, "map<string,string>")


def _linux(df: DataFrame) -> list[Column]:
    name = F.col("event")
    return [times.from_seconds(F.col("time_s")), F.col("pid"), F.col("tid"), F.col("cpu"), name, _args(F.col("args_json"))]


def _macos(df: DataFrame) -> list[Column]:
    cpu = F.get_json_object("payload_json", "$.cpu").cast("int")
    return [F.col("time_ns"), F.col("process_id"), F.col("thread_id"), cpu, F.col("probe"), _args(F.col("payload_json"))]


def _windows(df: DataFrame) -> list[Column]:
    name = F.concat_ws("/", "Provider", "Task")
    ns = times.from_ticks("ticks", "start_ticks", "start_ns", "tick_hz")
    return [ns, F.col("ProcessId"), F.col("ThreadId"), F.col("Cpu"), name, _args(F.col("Payload"))]


_SOURCES = {"linux": _linux, "macos": _macos, "windows": _windows}


def normalize(df: DataFrame, source: str, *, trace_id: str = "t0", id_col: str | None = None, value_key: str = "value") -> DataFrame:
    """Events from raw rows of ``source``: times to ns, native names to kinds, the payload to a map.

    ``value`` is the payload's number under ``value_key``, null without one.  An
    event id is the column given, else a number that is unique in the result; of
    a stream, which has no such numbers, a hash of the raw row.
    """
    ns, pid, tid, cpu, name, args = _SOURCES[source](df)
    if id_col:
        event_id = F.col(id_col).cast("bigint")
    else:
        event_id = F.xxhash64(*df.columns) if df.isStreaming else F.monotonically_increasing_id()
    rows = df.select(
        F.lit(trace_id).alias("trace_id"), event_id.alias("event_id"), ns.cast("bigint").alias("ts_ns"), pid.cast("bigint").alias("pid"), tid.cast("bigint").alias("tid"),
        cpu.cast("int").alias("cpu"), _kind(name, source).alias("kind"), name.alias("name"), args.alias("args"),
    )
    value = F.expr(f"try_cast(args['{value_key}'] as double)")
    return rows.select("trace_id", "event_id", "ts_ns", "pid", "tid", "cpu", "kind", "name", value.alias("value"), "args")
