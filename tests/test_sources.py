from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracelake import schema
from tracelake.functions import addresses
from tracelake.sources import fixtures, storage
from tracelake.streaming import live
from tracelake.trace import Trace

HERE = Path(__file__).parent / "fixtures"
SF = "/root/testdata/sf0.001"


def test_import_of_each_system(spark):
    events, bad = storage.import_export(spark, f"file://{HERE}/linux.json", "linux", "json")
    rows = {r.tid: r for r in events.collect()}
    assert [c for c, _ in events.dtypes] == [c.split()[0] for c in schema.EVENTS.split(", ")]
    assert (rows[5].ts_ns, rows[5].kind, rows[5].name, rows[5].value) == (12_000_000_001, "switch", "sched:sched_switch", 2.5)
    assert rows[6].kind == "io_start" and rows[6].value is None and rows[6].args == {"sector": "9"}
    assert rows[7].ts_ns is None and rows[7].kind == "custom" and rows[7].args is None
    assert [r._corrupt_record for r in bad.collect()] == ["not json at all"]
    rows = storage.import_export(spark, f"file://{HERE}/macos.csv", "macos", "csv")[0].orderBy("ts_ns").collect()
    assert [(r.ts_ns, r.pid, r.tid, r.cpu, r.kind, r.value) for r in rows] == [(5_000_000_001, 11, 12, 3, "io_start", 7.0), (5_000_000_009, 11, 12, None, "io_end", None)]
    rows = storage.import_export(spark, f"file://{HERE}/windows.json", "windows", "json")[0].orderBy("ts_ns").collect()
    assert [(r.ts_ns, r.kind, r.value) for r in rows] == [(1500, "switch", None), (2_500_001_000, "io_end", 4096.0)]


def test_stored_trace_prunes_partitions(spark, tmp_path):
    path, day = f"file://{tmp_path}/t", 86_400 * 10**9
    events = fixtures.events(spark, SF).selectExpr("trace_id", "event_id", "ts_ns", "pid", "tid", "cpu", "kind", "kind as name", "value", "map('k', cast(arg_k as string)) as args")
    storage.write_trace({"events": events, "symbols": fixtures.symbols(spark, SF), "spans": fixtures.spans(spark, SF)}, path, day)
    back = Trace.read(spark, path)
    assert back.table("events").count() == events.count() and back.table("symbols").count() == fixtures.symbols(spark, SF).count()
    t0 = events.agg(F.min("ts_ns")).first()[0] + 3 * day
    part = storage.read_trace(spark, path, "t0", t0, t0 + day)
    assert part["events"].count() == events.where((F.col("ts_ns") >= t0) & (F.col("ts_ns") < t0 + day)).count()
    plan = part["events"]._jdf.queryExecution().executedPlan().toString()
    assert "time_bin" in plan.split("PartitionFilters")[1].split("]")[0] and "ts_ns" in plan.split("PushedFilters")[1].split("]")[0]
    spans = fixtures.spans(spark, SF)
    s = storage.read_trace(spark, path, "t0", 2 * 10**12, 2 * 10**12 + 10**10)["spans"]
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    s = storage.read_trace(spark, path, "t0", 2 * 10**12, 2 * 10**12 + 10**10)["spans"]
    plan = s._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("]")[0]
    assert "time_bin" in plan and ">=" in plan and "<=" in plan
    with pytest.raises(ValueError):
        storage.write_trace({"events": events}, path, 2 * day)
    assert s.count() == spans.where((F.col("start_ns") < 2 * 10**12 + 10**10) & (F.col("end_ns") > 2 * 10**12)).count()
    assert back.sql("SELECT count(*) AS n FROM events WHERE pid = :pid", pid=3).first().n == back.filter("events", "pid = 3").count()


def test_arrow_is_bounded(spark):
    assert storage.to_arrow(spark.range(10), 10).num_rows == 10
    with pytest.raises(ValueError):
        storage.to_arrow(spark.range(11), 10)


def test_dedupe_keeps_the_first_and_unions_fill_nulls(spark):
    e = spark.createDataFrame([(2, 1, "b"), (1, 1, "a"), (3, None, "c"), (4, None, "d")], "event_id long, k long, v string")
    assert sorted(r.event_id for r in storage.dedupe_events(e, ["k"]).collect()) == [1, 3]
    assert storage.union_traces(e, e.select("k")).where("v is null").count() == 4


def test_unsigned_addresses(spark):
    values = [0, 5, 2**63 - 1, 2**63, 2**64 - 1]
    df = spark.createDataFrame([(str(v),) for v in values], "s string").select(addresses.from_unsigned(F.col("s").cast("decimal(20,0)")).alias("a"))
    got = [r.a for r in df.orderBy(addresses.ordered(F.col("a"))).collect()]
    assert [x % 2**64 for x in got] == values
    assert [r.h for r in df.select(addresses.hexadecimal(F.col("a")).alias("h")).collect()][-1] == "0xffffffffffffffff"


def test_late_rows_are_dropped_and_files_are_read_once(spark, tmp_path):
    minute = 60 * 10**9
    for k, times in enumerate(([0, 5, 10], [11, 1], [30])):
        spark.createDataFrame([(t * minute, "x") for t in times], "ts_ns long, kind string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema("ts_ns long, kind string").parquet(f"{tmp_path}/in/*")
        q = live.live_timeline(stream, "5 minutes", "2 minutes", ["kind"]).writeStream.format("parquet").option("path", f"{tmp_path}/out")
        q.option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {r.start.minute: r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {0: 1, 5: 1, 10: 2}  # minute 1 came after the watermark had passed its window


