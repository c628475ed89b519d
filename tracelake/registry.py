"""Registered queries of the trace operators, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import acceptance
from .functions.times import SECOND
from .operators import clocks, flame, sched, selection, symbols, tables, timeline
from .operators.selection import Selection
from .plans import lanes
from .plans.scratch import folder as scratch_folder
from .sources import fixtures as fx
from .sources import rollups, storage
from .sources.normalize import normalize
from .streaming import live
from .trace import Trace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

T0, DAY = 1_704_067_200 * SECOND, 86_400 * SECOND  # 2024-01-01
S0, S1 = 1000 * SECOND, 2000 * SECOND  # of the spans, where a day of an order is a second


def duck(sql: str, *used: str) -> str:
    """SQL over the named fixture tables."""
    return "WITH " + ", ".join(f"{n} AS ({fx.DUCKDB[n]})" for n in used) + f" {sql}" if used else sql


def query(sql: str | None = None, *used: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = duck(sql, *used)
        return f

    return add


def joined(path: str = "path"):
    return F.array_join(path, ";").alias("path")


# ------------------------------------------------------------ sources and sinks

_EVENT = "trace_id, event_id, ts_ns, pid, tid, cpu, kind, value"


def _stored(spark: SparkSession, sf_dir: str) -> str:
    events = fx.events(spark, sf_dir).withColumns({"name": F.col("kind"), "args": F.create_map(F.lit("k"), F.col("arg_k").cast("string"))})
    path = scratch_folder(spark, "trace")
    storage.write_trace({"events": events.drop("arg_k"), "spans": fx.spans(spark, sf_dir)}, path, DAY)
    return path


@query(f"SELECT {_EVENT} FROM fx_events WHERE ts_ns >= {T0 + 3 * DAY} AND ts_ns < {T0 + 5 * DAY + 7}", "fx_events")
def read_trace(spark, sf_dir):
    return storage.read_trace(spark, _stored(spark, sf_dir), "t0", T0 + 3 * DAY, T0 + 5 * DAY + 7)["events"].select(*_EVENT.split(", "))


@query(f"SELECT span_id, start_ns, end_ns FROM fx_spans WHERE start_ns < {S1} AND end_ns > {S0}", "fx_spans")
def read_spans_range(spark, sf_dir):
    path = scratch_folder(spark, "trace")
    storage.write_trace({"spans": fx.spans(spark, sf_dir)}, path, 100 * SECOND)
    return storage.read_trace(spark, path, "t0", S0, S1)["spans"].select("span_id", "start_ns", "end_ns")


@query("SELECT trace_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM (SELECT trace_id, event_id FROM fx_events UNION ALL SELECT 't1', event_id FROM fx_events WHERE kind = 'click') GROUP BY 1", "fx_events")
def two_traces(spark, sf_dir):
    """A store that takes two traces, one after the other, and the second one twice."""
    path = scratch_folder(spark, "trace")
    events = fx.events(spark, sf_dir).withColumns({"name": F.col("kind"), "args": F.create_map(F.lit("k"), F.col("arg_k").cast("string"))}).drop("arg_k")
    second = events.where("kind = 'click'").withColumn("trace_id", F.lit("t1"))
    for part in (events, second, second):
        storage.write_trace({"events": part}, path, DAY)
    return Trace.read(spark, path).table("events").groupBy("trace_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(f"SELECT {_EVENT}, CAST(arg_k AS VARCHAR) AS k FROM fx_events", "fx_events")
def write_read_roundtrip(spark, sf_dir):
    return Trace.read(spark, _stored(spark, sf_dir)).table("events").select(*_EVENT.split(", "), F.col("args")["k"].alias("k"))


def _raw(spark, sf_dir, source):
    """The events as each system would have recorded them."""
    e = fx.events(spark, sf_dir)
    payload = F.to_json(F.struct(F.col("value").cast("string").alias("value"), F.col("cpu").alias("cpu")))
    if source == "linux":
        return e.select("event_id", (F.col("ts_ns").cast("decimal(20,0)") / F.lit(SECOND).cast("decimal(20,0)")).cast("decimal(20,9)").alias("time_s"), "pid", "tid", "cpu", F.col("kind").alias("event"), payload.alias("args_json"))
    if source == "macos":
        return e.select("event_id", F.col("ts_ns").alias("time_ns"), F.col("pid").alias("process_id"), F.col("tid").alias("thread_id"), F.col("kind").alias("probe"), payload.alias("payload_json"))
    ticks = F.expr(f"(ts_ns - {T0}) div 100 + 133000000000000000")
    return e.select("event_id", ticks.alias("ticks"), F.lit(133_000_000_000_000_000).alias("start_ticks"), F.lit(T0).alias("start_ns"), F.lit(10_000_000).alias("tick_hz"), F.col("pid").alias("ProcessId"), F.col("tid").alias("ThreadId"), F.col("cpu").alias("Cpu"), F.col("kind").alias("Provider"), F.lit("x").alias("Task"), payload.alias("Payload"))


_NORMAL = "SELECT trace_id, event_id, ts_ns, pid, tid, cpu, {kind} AS kind, {kind} AS name, value FROM fx_events"


def _normalized(spark, sf_dir, source):
    return normalize(_raw(spark, sf_dir, source), source, id_col="event_id").drop("args")


@query(_NORMAL.format(kind="kind"), "fx_events")
def normalize_linux(spark, sf_dir):
    return _normalized(spark, sf_dir, "linux")


@query(_NORMAL.format(kind="kind"), "fx_events")
def normalize_macos(spark, sf_dir):
    return _normalized(spark, sf_dir, "macos")


@query(_NORMAL.format(kind="kind || '/x'"), "fx_events")
def normalize_windows(spark, sf_dir):
    return _normalized(spark, sf_dir, "windows")


@query("SELECT ts_ns, pid, tid, cpu, kind, value FROM fx_events", "fx_events")
def import_export(spark, sf_dir):
    path = scratch_folder(spark, "export")
    _raw(spark, sf_dir, "linux").drop("event_id").write.json(path)
    return storage.import_export(spark, path, "linux", "json")[0].select("ts_ns", "pid", "tid", "cpu", "kind", "value")


@query("SELECT trace_id, event_id, ts_ns, arg_k FROM fx_events WHERE kind = 'click' UNION ALL SELECT 't1', event_id, ts_ns, NULL FROM fx_events WHERE kind <> 'click'", "fx_events")
def union_traces(spark, sf_dir):
    e = fx.events(spark, sf_dir)
    a = e.where("kind = 'click'").select("trace_id", "event_id", "ts_ns", "arg_k")
    return storage.union_traces(a, e.where("kind <> 'click'").select("ts_ns", "event_id", F.lit("t1").alias("trace_id")))


@query("SELECT kind, count(*) AS n FROM fx_events GROUP BY kind", "fx_events")
def to_arrow(spark, sf_dir):
    return spark.createDataFrame(storage.to_arrow(fx.events(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n")), 1000))


@query("SELECT kind, arg_k, min(event_id) AS event_id FROM fx_events GROUP BY kind, arg_k", "fx_events")
def dedupe_events(spark, sf_dir):
    e = fx.events(spark, sf_dir)
    return storage.dedupe_events(e.unionByName(e), ["kind", "arg_k"]).select("kind", "arg_k", "event_id")


#: trace, origin, offset and drift of two machines' clocks.
_CLOCKS = [("t1", T0, 1_500_000_000, 25_000), ("t2", T0 + 7, -86_400_000_000_123, -3_000)]


@query(f"""SELECT trace_id, event_id, CASE WHEN o IS NULL THEN ts_ns ELSE ts_ns - o - ((ts_ns - o - z) // 1000000000 * d + ((ts_ns - o - z) % 1000000000 * d) // 1000000000) END AS ts_ns
FROM (SELECT CASE pid % 3 WHEN 0 THEN 't0' WHEN 1 THEN 't1' ELSE 't2' END AS trace_id, event_id, ts_ns FROM fx_events) LEFT JOIN (VALUES {', '.join(map(str, _CLOCKS))}) AS c(t, z, o, d) ON t = trace_id""", "fx_events")
def align_clocks(spark, sf_dir):
    events = fx.events(spark, sf_dir).withColumn("trace_id", F.expr("concat('t', pid % 3)"))
    known = spark.createDataFrame(_CLOCKS, "trace_id string, origin_ns long, offset_ns long, drift_ppb long")
    return clocks.align(events, known, ["ts_ns"]).select("trace_id", "event_id", "ts_ns")


@query(f"""SELECT 't1' AS trace_id, bin, there_ns + (back_ns - there_ns) // 2 AS at_ns, x // 2 AS offset_ns FROM (
SELECT bin, min(there) - min(back) AS x, arg_min(t, there) AS there_ns, arg_min(t, back) AS back_ns FROM (
SELECT t // {DAY} AS bin, * FROM (
SELECT ts_ns AS t, 5000 + event_id * 7919 % 1000003 + 250000000 AS there, NULL AS back FROM fx_events WHERE kind = 'click' UNION ALL
SELECT ts_ns AS t, NULL, 5000 + event_id * 7919 % 1000003 - 250000000 FROM fx_events WHERE kind = 'view')) GROUP BY bin HAVING min(there) IS NOT NULL AND min(back) IS NOT NULL)""", "fx_events")
def clock_offsets(spark, sf_dir):
    """Clicks as messages to another machine, whose clock is a quarter of a second ahead, and views as messages from it."""
    e = fx.events(spark, sf_dir).where("kind in ('click', 'view')").withColumn("way", F.expr("5000 + event_id * 7919 % 1000003"))
    here = e.select(F.lit("t0").alias("trace_id"), F.col("event_id").alias("message"), F.when(F.col("kind") == "click", "sent").otherwise("received").alias("kind"), "ts_ns")
    there = e.select(F.lit("t1"), "event_id", F.when(F.col("kind") == "click", "received").otherwise("sent"), F.col("ts_ns") + 250_000_000 + F.when(F.col("kind") == "click", F.col("way")).otherwise(-F.col("way")))
    return clocks.clock_offsets(clocks.match_messages(here.union(there), "sent", "received", ["message"]), "t0", DAY)


# ------------------------------------------------------------------- relational


def _trace(spark, sf_dir):
    return Trace({"events": fx.events(spark, sf_dir), "spans": fx.spans(spark, sf_dir), "samples": fx.samples(spark, sf_dir)})


@query("SELECT event_id, ts_ns, value FROM fx_events WHERE kind = 'click' AND arg_k >= 50", "fx_events")
def filter_events(spark, sf_dir):
    return _trace(spark, sf_dir).filter("events", "kind = 'click' AND arg_k >= 50").select("event_id", "ts_ns", "value")


@query("SELECT pid, kind, count(*) AS n, CAST(sum(arg_k) AS BIGINT) AS total, max(ts_ns) AS last_ns FROM fx_events GROUP BY pid, kind", "fx_events")
def aggregate_events(spark, sf_dir):
    return _trace(spark, sf_dir).aggregate("events", ["pid", "kind"], [F.count("*").alias("n"), F.sum("arg_k").alias("total"), F.max("ts_ns").alias("last_ns")])


@query(f"SELECT event_id, (ts_ns - {T0}) // 1000000 AS ms, upper(kind) AS kind FROM fx_events", "fx_events")
def project_events(spark, sf_dir):
    return _trace(spark, sf_dir).project("events", ["event_id", F.expr(f"(ts_ns - {T0}) div 1000000").alias("ms"), F.upper("kind").alias("kind")])


_ORDER = [("arg_k", "desc"), ("event_id", "asc")]


@query("SELECT event_id, arg_k FROM fx_events ORDER BY arg_k DESC, event_id LIMIT 50", "fx_events")
def top_k(spark, sf_dir):
    return tables.top_k(fx.events(spark, sf_dir).where("arg_k is not null"), _ORDER, 50).select("event_id", "arg_k")


@query("SELECT event_id, arg_k FROM fx_events WHERE arg_k < 50 OR arg_k = 50 AND event_id > 100 ORDER BY arg_k DESC, event_id LIMIT 40", "fx_events")
def page_after(spark, sf_dir):
    return tables.page(fx.events(spark, sf_dir).where("arg_k is not null"), _ORDER, (50, 100), 40).select("event_id", "arg_k")


@query("SELECT pid, tid, kind, CAST(3 - grouping(pid) - grouping(tid) - grouping(kind) AS INT) AS level, count(*) AS n, CAST(sum(arg_k) AS BIGINT) AS total FROM fx_events GROUP BY ROLLUP (pid, tid, kind)", "fx_events")
def grid_rollup(spark, sf_dir):
    return tables.grid(fx.events(spark, sf_dir), ["pid", "tid", "kind"], {"n": "count(*)", "total": "sum(arg_k)"})


@query("SELECT kind, count(arg_k) AS n, CAST(sum(arg_k) AS BIGINT) AS total, min(arg_k) AS least, max(arg_k) AS most, quantile_cont(arg_k, 0.5) AS p50, quantile_cont(arg_k, 0.95) AS p95, quantile_cont(arg_k, 0.99) AS p99, count(DISTINCT arg_k) AS n_distinct FROM fx_events GROUP BY kind", "fx_events")
def summary_exact(spark, sf_dir):
    return tables.summarize(fx.events(spark, sf_dir), ["kind"], "arg_k")


@query("SELECT kind, count(v) AS n, CAST(sum(v) AS BIGINT) AS total, min(v) AS least, max(v) AS most, CAST(round(100 * quantile_cont(v, 0.5)) AS BIGINT) AS p50, CAST(round(100 * quantile_cont(v, 0.95)) AS BIGINT) AS p95, CAST(round(100 * quantile_cont(v, 0.99)) AS BIGINT) AS p99, count(DISTINCT v) AS n_distinct FROM (SELECT kind, CAST(round(value * 100) AS BIGINT) * 3 AS v FROM fx_events) GROUP BY kind", "fx_events")
def summary_ranked(spark, sf_dir):
    """Percentiles by rank, of multiples of three, whose hundredths lie on no half."""
    events = fx.events(spark, sf_dir).withColumn("v", F.round(F.col("value") * 100).cast("bigint") * 3)
    out = tables.summarize_ranked(events, ["kind"], "v")
    return out.withColumns({c: F.round(100 * F.col(c)).cast("bigint") for c in ("p50", "p95", "p99")})


# -------------------------------------------------------------------- selection

_WEEK = Selection().time(T0 + 2 * DAY, T0 + 9 * DAY)


@query(f"SELECT event_id FROM fx_events WHERE ts_ns >= {T0 + 2 * DAY} AND ts_ns < {T0 + 9 * DAY}", "fx_events")
def select_time(spark, sf_dir):
    return _WEEK.apply({"e": fx.events(spark, sf_dir)})["e"].select("event_id")


@query(f"SELECT span_id FROM fx_spans WHERE start_ns < {S1} AND end_ns > {S0}", "fx_spans")
def select_time_spans(spark, sf_dir):
    return Selection().time(S0, S1).apply({"s": fx.spans(spark, sf_dir)})["s"].select("span_id")


@query("SELECT event_id FROM fx_events WHERE pid IN (1, 3)", "fx_events")
def select_process(spark, sf_dir):
    return Selection().process(1, 3).apply({"e": fx.events(spark, sf_dir)})["e"].select("event_id")


@query("SELECT event_id FROM fx_events WHERE tid IN (5, 17, 31)", "fx_events")
def select_thread(spark, sf_dir):
    return Selection().thread(5, 17, 31).apply({"e": fx.events(spark, sf_dir)})["e"].select("event_id")


@query("SELECT sample_id FROM fx_samples WHERE list_contains(frames, 49)", "fx_samples")
def select_frame(spark, sf_dir):
    return Selection().frame(49).apply({"s": fx.samples(spark, sf_dir)})["s"].select("sample_id")


_COUNTS = f"SELECT kind, (ts_ns - {{a}}) // {{bw}} AS px, count(*) AS n FROM fx_events WHERE ts_ns >= {{a}} AND ts_ns < {{b}} {{more}} GROUP BY 1, 2"


def _counts_sql(a, b, w, more=""):
    return _COUNTS.format(a=a, b=b, bw=timeline.pixel_width(a, b, w), more=more)


@query(_counts_sql(T0 + 2 * DAY, T0 + 9 * DAY, 100, "AND pid = 1"), "fx_events")
def linked_timeline(spark, sf_dir):
    panes = _WEEK.process(1).apply({"events": fx.events(spark, sf_dir)})
    return timeline.timeline_counts(panes["events"], _WEEK.t0, _WEEK.t1, 100, ["kind"])


_TREE = """folded AS (SELECT {stack} AS stack, CAST(sum(weight) AS BIGINT) AS weight FROM {source} GROUP BY 1),
prefixes AS (SELECT stack[1:d] AS path, d AS depth, weight, CASE WHEN d = len(stack) THEN weight ELSE 0 END AS own FROM (SELECT stack, weight, unnest(range(1, len(stack) + 1)) AS d FROM folded)),
tree AS (SELECT path, depth, path[depth] AS name, CAST(sum(weight) AS BIGINT) AS total, CAST(sum(own) AS BIGINT) AS self FROM prefixes GROUP BY 1, 2)"""
_LAYOUT = """placed AS (SELECT *, coalesce(sum(total) OVER (PARTITION BY path[1:depth - 1] ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM tree),
laid AS (SELECT t.path, t.depth, t.name, t.total, t.self, CAST(sum(p.off) AS BIGINT) AS x FROM tree t JOIN placed p ON p.depth <= t.depth AND t.path[1:p.depth] = p.path GROUP BY ALL)"""
_NAMED = "named AS (SELECT trace_id, sample_id, pid, tid, ts_ns, weight, list_transform(frames, lambda a: CAST(a AS VARCHAR)) AS stack FROM fx_samples)"


def _as_names(samples):
    return samples.withColumn("stack", F.col("frames").cast("array<string>")).drop("frames")


def _tree_sql(select: str, source: str, stack: str, *used: str, layout: bool = False, before: str = "") -> str:
    head = duck("", *used).removesuffix(" ")
    return ", ".join(x for x in (head, before, _TREE.format(source=source, stack=stack), _LAYOUT if layout else "") if x) + " " + select


@query()
def linked_flame(spark, sf_dir):
    sel = Selection().time(S0, S1).process(*range(20))
    return flame.flame(_as_names(fx.samples(spark, sf_dir)), sel).select(joined(), "depth", "total", "self", "x")


ORACLE_SQL["linked_flame"] = _tree_sql(
    "SELECT array_to_string(path, ';') AS path, CAST(depth AS INT) AS depth, total, self, x FROM laid", f"(SELECT * FROM named WHERE ts_ns >= {S0} AND ts_ns < {S1} AND pid < 20)", "stack", "fx_samples", layout=True, before=_NAMED
)


@query("SELECT event_id FROM fx_events WHERE (trace_id, pid, tid) IN (SELECT (trace_id, pid, tid) FROM fx_samples WHERE list_contains(frames, 49))", "fx_events", "fx_samples")
def linked_semi(spark, sf_dir):
    panes = Selection().frame(49).apply({"samples": fx.samples(spark, sf_dir), "events": fx.events(spark, sf_dir)}, carry="thread")
    return panes["events"].select("event_id")


@query(f"SELECT kind, n_a, n_b, n_b - n_a AS diff FROM (SELECT kind, count(*) FILTER (WHERE ts_ns < {T0 + 5 * DAY}) AS n_a, count(*) FILTER (WHERE pid IN (1, 2)) AS n_b FROM fx_events WHERE ts_ns >= {T0} AND ts_ns < {T0 + 5 * DAY} OR pid IN (1, 2) GROUP BY kind)", "fx_events")
def compare_selections(spark, sf_dir):
    return selection.compare(fx.events(spark, sf_dir), Selection().time(T0, T0 + 5 * DAY), Selection().process(1, 2), ["kind"])


# -------------------------------------------------------------------- timelines


@query(_counts_sql(T0, T0 + 30 * DAY, 640), "fx_events")
def timeline_counts(spark, sf_dir):
    return timeline.timeline_counts(fx.events(spark, sf_dir), T0, T0 + 30 * DAY, 640, ["kind"])


@query(f"SELECT (ts_ns - {T0}) // {timeline.pixel_width(T0, T0 + 30 * DAY, 200)} AS px, arg_min(arg_k, ts_ns * 1000000 + event_id) AS first, arg_max(arg_k, ts_ns * 1000000 + event_id) AS last, min(arg_k) AS low, max(arg_k) AS high FROM (SELECT * REPLACE (CAST(ts_ns AS HUGEINT) AS ts_ns) FROM fx_events) WHERE ts_ns >= {T0} AND ts_ns < {T0 + 30 * DAY} GROUP BY 1", "fx_events")
def timeline_m4(spark, sf_dir):
    return timeline.timeline_m4(fx.events(spark, sf_dir), "arg_k", T0, T0 + 30 * DAY, 200)


_BUSY_BW = timeline.pixel_width(S0, S1, 97)


@query(f"SELECT kind, px, CAST(sum(least(e, (px + 1) * {_BUSY_BW}) - greatest(s, px * {_BUSY_BW})) AS BIGINT) AS busy_ns FROM (SELECT kind, s, e, unnest(range(s // {_BUSY_BW}, (e - 1) // {_BUSY_BW} + 1)) AS px FROM (SELECT kind, greatest(start_ns, {S0}) - {S0} AS s, least(end_ns, {S1}) - {S0} AS e FROM fx_spans WHERE start_ns < {S1} AND end_ns > {S0})) GROUP BY 1, 2", "fx_spans")
def timeline_busy(spark, sf_dir):
    return timeline.timeline_busy(fx.spans(spark, sf_dir), S0, S1, 97, ["kind"])


_MERGED = """merged AS (SELECT trace_id, tid, min(start_ns) AS start_ns, max(end_ns) AS end_ns, count(*) AS n FROM (
SELECT *, sum(new) OVER (PARTITION BY trace_id, tid ORDER BY start_ns, end_ns, span_id) AS island FROM (
SELECT *, CASE WHEN start_ns - max(end_ns) OVER (PARTITION BY trace_id, tid ORDER BY start_ns, end_ns, span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) {test} THEN 0 ELSE 1 END AS new FROM fx_spans)) GROUP BY trace_id, tid, island)"""


def _merged_sql(select, test):
    return duck("", "fx_spans") + ", " + _MERGED.format(test=test) + " " + select


@query()
def merge_spans(spark, sf_dir):
    return timeline.merge_spans(fx.spans(spark, sf_dir), ["trace_id", "tid"], 30 * SECOND)


ORACLE_SQL["merge_spans"] = _merged_sql("SELECT * FROM merged", f"< {30 * SECOND}")


@query()
def span_gaps(spark, sf_dir):
    return timeline.span_gaps(fx.spans(spark, sf_dir), ["trace_id", "tid"])


ORACLE_SQL["span_gaps"] = _merged_sql(
    "SELECT trace_id, tid, end_ns AS start_ns, after AS end_ns, after - end_ns AS gap_ns FROM (SELECT *, lead(start_ns) OVER (PARTITION BY trace_id, tid ORDER BY start_ns) AS after FROM merged) WHERE after IS NOT NULL", "<= 0"
)


@query("SELECT trace_id, kind, ts_ns, CAST(sum(d) OVER (PARTITION BY trace_id, kind ORDER BY ts_ns) AS BIGINT) AS n_open FROM (SELECT trace_id, kind, ts_ns, sum(d) AS d FROM (SELECT trace_id, kind, start_ns AS ts_ns, 1 AS d FROM fx_spans UNION ALL SELECT trace_id, kind, end_ns, -1 FROM fx_spans) GROUP BY 1, 2, 3 HAVING sum(d) <> 0)", "fx_spans")
def concurrency(spark, sf_dir):
    return timeline.concurrency(fx.spans(spark, sf_dir), ["trace_id", "kind"])


@query(f"SELECT trace_id, kind, ts_ns // ({60 * SECOND} << l) AS bucket, CAST(l AS INT) AS level, count(*) AS n FROM fx_events, range(0, 12) AS r(l) GROUP BY ALL", "fx_events")
def pyramid(spark, sf_dir):
    return timeline.build_pyramid(fx.events(spark, sf_dir), 60 * SECOND, 12, ["trace_id", "kind"])


def _stored_pyramid(spark, sf_dir):
    """A pyramid to which half of the events came later."""
    path, events = scratch_folder(spark, "pyramid"), fx.events(spark, sf_dir)
    for append, part in enumerate(("cpu < 2", "cpu >= 2")):
        rollups.write_pyramid(events.where(part), path, 60 * SECOND, 12, ["kind"], append=bool(append))
    return path


@query(_counts_sql(T0 + 2 * DAY, T0 + 30 * DAY, 672), "fx_events")
def timeline_from_pyramid(spark, sf_dir):
    """Pixels of an hour: buckets of 32 minutes, and finer ones at their edges."""
    return rollups.timeline_from_pyramid(spark, _stored_pyramid(spark, sf_dir), T0 + 2 * DAY, T0 + 30 * DAY, 672)


_P0, _PW = T0 // (7680 * SECOND) * 7680 * SECOND, 3840 * SECOND


@query(_counts_sql(_P0, _P0 + 600 * _PW, 600), "fx_events")
def timeline_from_level(spark, sf_dir):
    """Pixels that are buckets of one level."""
    return rollups.timeline_from_pyramid(spark, _stored_pyramid(spark, sf_dir), _P0, _P0 + 600 * _PW, 600)


@query(f"SELECT kind, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total, min(cents) AS least, max(cents) AS most, true AS ranks_hold, true AS distinct_holds FROM (SELECT kind, CAST(round(value * 100) AS BIGINT) AS cents FROM fx_events WHERE ts_ns >= {T0 + 2 * DAY} AND ts_ns < {T0 + 20 * DAY}) GROUP BY kind", "fx_events")
def summary_from_sketches(spark, sf_dir):
    """Stored sketches of each hour and process, merged over 18 days; their percentiles are held against the ranks of all events."""
    path = scratch_folder(spark, "sketches")
    events = fx.events(spark, sf_dir).withColumn("cents", F.round(F.col("value") * 100).cast("bigint"))
    for append, part in enumerate(("cpu < 2", "cpu >= 2")):
        rollups.write_sketches(events.where(part), path, "cents", 3600 * SECOND, ["kind", "cpu"], append=bool(append))
    found = rollups.summary_from_sketches(spark, path, T0 + 2 * DAY, T0 + 20 * DAY, ["kind"])
    held = events.where((F.col("ts_ns") >= T0 + 2 * DAY) & (F.col("ts_ns") < T0 + 20 * DAY)).select("kind", "cents").join(found, "kind")
    share = lambda c: F.sum(F.when(c, 1).otherwise(0)) / F.count("*")
    near = [(share(F.col("cents") < F.col(p)) <= at + 0.01) & (share(F.col("cents") <= F.col(p)) >= at - 0.01) for p, at in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))]
    exact = ["n", "total", "least", "most"]
    apart = F.abs(F.count_distinct("cents") - F.first("n_distinct")) <= 0.03 * F.count_distinct("cents")
    return held.groupBy("kind").agg(*[F.first(c).alias(c) for c in exact], (near[0] & near[1] & near[2]).alias("ranks_hold"), apart.alias("distinct_holds"))


# ----------------------------------------------------------- symbols and stacks


def _indexed(spark, sf_dir):
    """Stored samples and the index of their frames, one half of which came later."""
    store, index, samples = scratch_folder(spark, "trace"), scratch_folder(spark, "index"), fx.samples(spark, sf_dir)
    storage.write_trace({"samples": samples}, store, 100 * SECOND)
    for append, part in enumerate(("sample_id % 2 = 0", "sample_id % 2 = 1")):
        rollups.write_frame_index(samples.where(part), index, 100 * SECOND, append=bool(append))
    return store, index


@query(f"SELECT sample_id FROM fx_samples WHERE list_contains(frames, 49) AND ts_ns >= {S0} AND ts_ns < {S1}", "fx_samples")
def select_frame_indexed(spark, sf_dir):
    return rollups.samples_with_frame(spark, *_indexed(spark, sf_dir), 49, "t0", S0, S1).select("sample_id")


@query("SELECT event_id FROM fx_events WHERE (trace_id, pid, tid) IN (SELECT (trace_id, pid, tid) FROM fx_samples WHERE list_contains(frames, 49))", "fx_events", "fx_samples")
def linked_semi_indexed(spark, sf_dir):
    return rollups.of_threads_with_frame(fx.events(spark, sf_dir), _indexed(spark, sf_dir)[1], 49).select("event_id")


def _frames(spark, sf_dir):
    return fx.samples(spark, sf_dir).select("trace_id", "sample_id", "pid", "ts_ns", F.posexplode("frames").alias("place", "addr"))


_FRAMES = "(SELECT trace_id, sample_id, pid, ts_ns, unnest(frames) AS addr, unnest(range(len(frames))) AS place FROM fx_samples)"


@query(f"SELECT f.sample_id, CAST(f.place AS INT) AS place, f.addr, m.module FROM {_FRAMES} f LEFT JOIN fx_modules m ON f.trace_id = m.trace_id AND f.pid = m.pid AND f.addr >= m.base AND f.addr < m.limit_addr AND f.ts_ns >= m.load_ns AND f.ts_ns < m.unload_ns", "fx_samples", "fx_modules")
def attach_module(spark, sf_dir):
    return symbols.attach_module(_frames(spark, sf_dir), fx.modules(spark, sf_dir)).select("sample_id", "place", "addr", "module")


@query()
def attach_module_overlaps(spark, sf_dir):
    """A third module lies over the end of the first and the begin of the second one for some time, and is loaded twice."""
    known = fx.modules(spark, sf_dir)
    third = known.where("module = 'app'").selectExpr("trace_id", "pid", "explode(array(struct('plug' as m, 500L as b, 5000L as l, 900000000000L as s, 2000000000000L as u), struct('plug' as m, 700L as b, 9000L as l, 1500000000000L as s, 3000000000000L as u))) as x")
    third = third.selectExpr("trace_id", "pid", "x.m as module", "x.b as base", "x.l as limit_addr", "x.s as load_ns", "x.u as unload_ns")
    return symbols.attach_module(_frames(spark, sf_dir), known.unionByName(third)).select("sample_id", "place", "addr", "module")


ORACLE_SQL["attach_module_overlaps"] = duck("", "fx_samples", "fx_modules") + f""", m AS (SELECT * FROM fx_modules UNION ALL SELECT trace_id, pid, 'plug', b, l, s, u FROM fx_modules, (VALUES (500, 5000, 900000000000, 2000000000000), (700, 9000, 1500000000000, 3000000000000)) AS v(b, l, s, u) WHERE module = 'app'),
f AS (SELECT * FROM {_FRAMES})
SELECT f.sample_id, CAST(f.place AS INT) AS place, f.addr, m.module FROM f LEFT JOIN m ON f.trace_id = m.trace_id AND f.pid = m.pid AND f.addr >= m.base AND f.addr < m.limit_addr AND f.ts_ns >= m.load_ns AND f.ts_ns < m.unload_ns
QUALIFY row_number() OVER (PARTITION BY f.sample_id, f.place ORDER BY m.load_ns DESC, m.base DESC, m.module DESC) = 1"""


_FN = "coalesce(s.fn, '0x' || lower(hex(f.addr)))"


@query(f"SELECT f.sample_id, CAST(f.place AS INT) AS place, f.addr, {_FN} AS fn, s.fn IS NOT NULL AS resolved FROM {_FRAMES} f LEFT JOIN fx_symbols s ON f.addr >= s.lo AND f.addr < s.hi", "fx_samples", "fx_symbols")
def symbolize(spark, sf_dir):
    frames = _frames(spark, sf_dir).withColumn("module", F.lit("app"))
    return symbols.symbolize(frames, fx.symbols(spark, sf_dir)).select("sample_id", "place", "addr", "fn", "resolved")


@query(f"SELECT f.sample_id, string_agg({_FN}, ';' ORDER BY f.place) AS stack FROM {_FRAMES} f LEFT JOIN fx_symbols s ON f.addr >= s.lo AND f.addr < s.hi GROUP BY 1", "fx_samples", "fx_symbols")
def symbolize_stacks(spark, sf_dir):
    out = symbols.symbolize_stacks(fx.samples(spark, sf_dir), fx.symbols(spark, sf_dir))
    return out.select("sample_id", F.array_join("stack", ";").alias("stack"))


@query()
def linked_flame_symbolized(spark, sf_dir):
    """The flame graph of the stacks that hold a function, over all modules that were loaded."""
    stacks = symbols.symbolize_stacks(fx.samples(spark, sf_dir), fx.module_symbols(spark, sf_dir), modules=fx.modules(spark, sf_dir))
    return flame.flame(stacks, Selection().time(S0, S1).frame("red widget")).select(joined(), "depth", "total", "self", "x")


_RESOLVED = f"""resolved AS (SELECT f.sample_id, f.ts_ns, 1 AS weight, list({_FN} ORDER BY f.place) AS stack FROM {_FRAMES} f
LEFT JOIN fx_modules m ON f.trace_id = m.trace_id AND f.pid = m.pid AND f.addr >= m.base AND f.addr < m.limit_addr AND f.ts_ns >= m.load_ns AND f.ts_ns < m.unload_ns
LEFT JOIN fx_module_symbols s ON s.module = m.module AND f.addr >= s.lo AND f.addr < s.hi GROUP BY 1, 2)"""
ORACLE_SQL["linked_flame_symbolized"] = _tree_sql(
    "SELECT array_to_string(path, ';') AS path, CAST(depth AS INT) AS depth, total, self, x FROM laid",
    f"(SELECT * FROM resolved WHERE ts_ns >= {S0} AND ts_ns < {S1} AND list_contains(stack, 'red widget'))", "stack", "fx_samples", "fx_modules", "fx_module_symbols", layout=True, before=_RESOLVED,
)


@query("SELECT array_to_string(stack, ';') AS stack, CAST(sum(weight) AS BIGINT) AS weight FROM fx_stacks GROUP BY 1", "fx_stacks")
def fold_stacks(spark, sf_dir):
    s = fx.stacks(spark, sf_dir)
    return flame.fold_stacks(s).select(F.array_join("stack", ";").alias("stack"), "weight")


@query()
def flame_tree(spark, sf_dir):
    return flame.flame_tree(fx.stacks(spark, sf_dir)).select(joined(), "depth", "name", "total", "self")


ORACLE_SQL["flame_tree"] = _tree_sql("SELECT array_to_string(path, ';') AS path, CAST(depth AS INT) AS depth, name, total, self FROM tree", "fx_stacks", "stack", "fx_stacks")


_CONTEXTS = """folded AS (SELECT stack, CAST(sum(weight) AS BIGINT) AS weight FROM {source} GROUP BY 1),
frames AS (SELECT stack, weight, unnest(range(1, len(stack) + 1)) AS d FROM folded),
ids AS (SELECT *, list_reduce(list_prepend('', stack[1:d]), lambda acc, x: md5(acc || x)) AS id, list_reduce(list_prepend('', stack[1:d - 1]), lambda acc, x: md5(acc || x)) AS parent FROM frames),
nodes AS (SELECT id, parent, d AS depth, stack[d] AS name, CAST(sum(weight) AS BIGINT) AS total, CAST(sum(CASE WHEN d = len(stack) THEN weight ELSE 0 END) AS BIGINT) AS self FROM ids GROUP BY 1, 2, 3, 4)"""
#: The begin of a node: for each level down to it, what stands before by name among the siblings.
_BEGINS = """offsets AS (SELECT id, coalesce(sum(total) OVER (PARTITION BY parent ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM nodes),
begins AS (SELECT n.id, CAST(sum(o.off) AS BIGINT) AS x FROM (SELECT DISTINCT i.id, list_reduce(list_prepend('', i.stack[1:k]), lambda acc, x: md5(acc || x)) AS above FROM ids i, range(1, 64) AS r(k) WHERE k <= i.d) n JOIN offsets o ON o.id = n.above GROUP BY 1)"""


def _as_text(spark, sf_dir):
    return flame.fold_stacks(_as_names(fx.samples(spark, sf_dir)))


@query()
def context_tree(spark, sf_dir):
    return flame.context_tree(_as_text(spark, sf_dir))


ORACLE_SQL["context_tree"] = duck("", "fx_samples") + f", {_NAMED}, {_CONTEXTS.format(source='named')} SELECT id, parent, CAST(depth AS INT) AS depth, name, total, self FROM nodes"


@query()
def context_layout(spark, sf_dir):
    return flame.context_layout(_as_text(spark, sf_dir))


ORACLE_SQL["context_layout"] = duck("", "fx_samples") + f", {_NAMED}, {_CONTEXTS.format(source='named')}, {_BEGINS} SELECT id, parent, CAST(depth AS INT) AS depth, name, total, self, x FROM nodes JOIN begins USING (id)"


@query()
def linked_contexts(spark, sf_dir):
    """``linked_flame`` with ids of contexts for paths."""
    sel = Selection().time(S0, S1).process(*range(20))
    return flame.flame_contexts(_as_names(fx.samples(spark, sf_dir)), sel)


ORACLE_SQL["linked_contexts"] = duck("", "fx_samples") + f", {_NAMED}, {_CONTEXTS.format(source=f'(SELECT * FROM named WHERE ts_ns >= {S0} AND ts_ns < {S1} AND pid < 20)')}, {_BEGINS} SELECT id, parent, CAST(depth AS INT) AS depth, name, total, self, x FROM nodes JOIN begins USING (id)"


@query()
def context_diff(spark, sf_dir):
    s = fx.stacks(spark, sf_dir)
    return flame.context_diff(s.where("stack[2] <> 'BUILDING'"), s.where("stack[0] <> 'ASIA'"))


ORACLE_SQL["context_diff"] = duck("", "fx_stacks") + """, frames AS (SELECT stack, weight, unnest(range(1, len(stack) + 1)) AS d FROM fx_stacks),
ids AS (SELECT *, list_reduce(list_prepend('', stack[1:d]), lambda acc, x: md5(acc || x)) AS id, list_reduce(list_prepend('', stack[1:d - 1]), lambda acc, x: md5(acc || x)) AS parent FROM frames),
sums AS (SELECT id, parent, CAST(d AS INT) AS depth, stack[d] AS name, coalesce(CAST(sum(weight) FILTER (stack[3] <> 'BUILDING') AS BIGINT), 0) AS total_a, coalesce(CAST(sum(weight) FILTER (stack[1] <> 'ASIA') AS BIGINT), 0) AS total_b
FROM ids WHERE stack[3] <> 'BUILDING' OR stack[1] <> 'ASIA' GROUP BY ALL)
SELECT *, total_b - total_a AS diff FROM sums"""


@query()
def flame_layout(spark, sf_dir):
    return flame.flame_layout(flame.flame_tree(fx.stacks(spark, sf_dir))).select(joined(), "depth", "total", "x")


ORACLE_SQL["flame_layout"] = _tree_sql("SELECT array_to_string(path, ';') AS path, CAST(depth AS INT) AS depth, total, x FROM laid", "fx_stacks", "stack", "fx_stacks", layout=True)


@query("SELECT fn, CAST(sum(weight) AS BIGINT) AS inclusive, CAST(sum(CASE WHEN fn = top THEN weight ELSE 0 END) AS BIGINT) AS self FROM (SELECT weight, frames[len(frames)] AS top, unnest(list_distinct(frames)) AS fn FROM fx_samples) GROUP BY fn", "fx_samples")
def function_summary(spark, sf_dir):
    return flame.function_summary(fx.samples(spark, sf_dir), "frames")


@query(f"SELECT 'app' AS module, count(*) AS n_frames, CAST(sum(CASE WHEN s.fn IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unresolved, sum(CASE WHEN s.fn IS NULL THEN 1 ELSE 0 END) / count(*) AS share FROM {_FRAMES} f LEFT JOIN fx_symbols s ON f.addr >= s.lo AND f.addr < s.hi", "fx_samples", "fx_symbols")
def symbol_coverage(spark, sf_dir):
    frames = _frames(spark, sf_dir).withColumn("module", F.lit("app"))
    return symbols.symbol_coverage(symbols.symbolize(frames, fx.symbols(spark, sf_dir)))


@query()
def flame_diff(spark, sf_dir):
    s = fx.stacks(spark, sf_dir)
    a, b = s.where("stack[2] <> 'BUILDING'"), s.where("stack[0] <> 'ASIA'")
    return flame.flame_diff(a, b).select(joined(), "total_a", "total_b", "diff")


def _diff_sql() -> str:
    side = "(SELECT array_to_string(stack[1:d], ';') AS path, CAST(sum(weight) AS BIGINT) AS t FROM (SELECT *, unnest(range(1, len(stack) + 1)) AS d FROM fx_stacks WHERE {}) GROUP BY 1)"
    a, b = side.format("stack[3] <> 'BUILDING'"), side.format("stack[1] <> 'ASIA'")
    return duck(f"SELECT path, coalesce(a.t, 0) AS total_a, coalesce(b.t, 0) AS total_b, coalesce(b.t, 0) - coalesce(a.t, 0) AS diff FROM {a} a FULL JOIN {b} b USING (path)", "fx_stacks")


ORACLE_SQL["flame_diff"] = _diff_sql()


# ----------------------------------------------------------- scheduling and I/O

_RUNS = "runs AS (SELECT * FROM (SELECT trace_id, switch_id, cpu, pid, tid, ts_ns AS start_ns, lead(ts_ns) OVER (PARTITION BY trace_id, cpu ORDER BY ts_ns, switch_id) AS end_ns FROM fx_switches) WHERE end_ns IS NOT NULL)"


def _runs_sql(select):
    return duck("", "fx_switches") + ", " + _RUNS + " " + select


@query()
def run_spans(spark, sf_dir):
    return sched.run_spans(fx.switches(spark, sf_dir))


ORACLE_SQL["run_spans"] = _runs_sql("SELECT * FROM runs")


@query()
def cpu_time(spark, sf_dir):
    return sched.cpu_time(sched.run_spans(fx.switches(spark, sf_dir)), ["pid", "tid"])


ORACLE_SQL["cpu_time"] = _runs_sql("SELECT pid, tid, CAST(sum(end_ns - start_ns) AS BIGINT) AS cpu_ns, count(*) AS n_runs FROM runs GROUP BY 1, 2")


@query()
def off_cpu(spark, sf_dir):
    switches = fx.switches(spark, sf_dir)
    return sched.off_cpu(sched.run_spans(switches), lanes.bin_width(switches, ["trace_id", "pid", "tid"], "ts_ns"))


ORACLE_SQL["off_cpu"] = _runs_sql("SELECT trace_id, pid, tid, b AS start_ns, a AS end_ns, a - b AS off_ns FROM (SELECT trace_id, pid, tid, start_ns AS a, lag(end_ns) OVER (PARTITION BY trace_id, pid, tid ORDER BY start_ns, switch_id) AS b FROM runs) WHERE a > b")

#: Starts and ends as brackets: rows of one level of nesting, each with its neighbours there.
_IO = """steps AS (SELECT *, sum(CASE WHEN kind = 'click' THEN 1 ELSE -1 END) OVER (PARTITION BY trace_id, pid, tid ORDER BY ts_ns, event_id) AS balance FROM fx_events WHERE kind IN ('click', 'view')),
levels AS (SELECT *, balance + CASE WHEN kind = 'view' THEN 1 ELSE 0 END AS level FROM steps),
near AS (SELECT *, lead(kind) OVER w AS next_kind, lag(kind) OVER w AS last_kind, lead(ts_ns) OVER w AS next_ns, lead(value) OVER w AS next_value FROM levels WINDOW w AS (PARTITION BY trace_id, pid, tid, level ORDER BY ts_ns, event_id)),
io AS (SELECT trace_id, pid, tid, event_id AS span_id, ts_ns AS start_ns, next_ns AS end_ns, next_value AS size FROM near WHERE kind = 'click' AND next_kind = 'view')"""

_REQUEST = ["trace_id", "pid", "tid"]


@query()
def pair_io(spark, sf_dir):
    return sched.pair_io(fx.events(spark, sf_dir), "click", "view", _REQUEST)


ORACLE_SQL["pair_io"] = duck("", "fx_events") + f", {_IO} SELECT * FROM io"


@query()
def unpaired_io(spark, sf_dir):
    return sched.unpaired_io(fx.events(spark, sf_dir), "click", "view", _REQUEST)


ORACLE_SQL["unpaired_io"] = duck("", "fx_events") + f", {_IO} SELECT trace_id, pid, tid, count(*) FILTER (kind = 'click' AND next_kind = 'view') AS n_pairs, count(*) FILTER (kind = 'click' AND next_kind IS DISTINCT FROM 'view') AS n_starts, count(*) FILTER (kind = 'view' AND last_kind IS DISTINCT FROM 'click') AS n_ends FROM near GROUP BY trace_id, pid, tid"


@query()
def io_summary(spark, sf_dir):
    out = sched.io_summary(sched.pair_io(fx.events(spark, sf_dir), "click", "view", _REQUEST), _REQUEST)
    out = out.withColumn("volume", F.round(F.col("volume") * 100).cast("bigint"))
    # whole microseconds; percentiles of them lie on multiples of 10 ns, so half a step is added before rounding down, and no engine's last bit decides
    return out.withColumns({c: F.floor((F.col(c) + 5) / 1000).cast("bigint") for c in ("p50", "p95", "p99")})


ORACLE_SQL["io_summary"] = duck("", "fx_events") + f", {_IO}, l AS (SELECT trace_id, pid, tid, size, end_ns - start_ns AS x FROM io) SELECT trace_id, pid, tid, CAST(round(sum(size) * 100) AS BIGINT) AS volume, count(x) AS n, CAST(sum(x) AS BIGINT) AS total, min(x) AS least, max(x) AS most, CAST(floor((quantile_cont(x, 0.5) + 5) / 1000) AS BIGINT) AS p50, CAST(floor((quantile_cont(x, 0.95) + 5) / 1000) AS BIGINT) AS p95, CAST(floor((quantile_cont(x, 0.99) + 5) / 1000) AS BIGINT) AS p99, count(DISTINCT x) AS n_distinct FROM l GROUP BY trace_id, pid, tid"


@query("SELECT s.sample_id, p.span_id FROM fx_samples s JOIN fx_spans p ON s.trace_id = p.trace_id AND s.pid = p.pid AND s.tid = p.tid AND s.ts_ns >= p.start_ns AND s.ts_ns < p.end_ns", "fx_samples", "fx_spans")
def samples_in_spans(spark, sf_dir):
    return sched.samples_in_spans(fx.samples(spark, sf_dir).drop("frames"), fx.spans(spark, sf_dir)).select("sample_id", "span_id")


_INNERMOST = "SELECT s.sample_id, s.weight, p.span_id, p.kind FROM fx_samples s LEFT JOIN fx_spans p ON s.trace_id = p.trace_id AND s.pid = p.pid AND s.tid = p.tid AND s.ts_ns >= p.start_ns AND s.ts_ns < p.end_ns QUALIFY row_number() OVER (PARTITION BY s.sample_id ORDER BY p.start_ns DESC, p.end_ns, p.span_id DESC) = 1"


@query(f"SELECT sample_id, span_id FROM ({_INNERMOST})", "fx_samples", "fx_spans")
def innermost_span(spark, sf_dir):
    return sched.innermost_span(fx.samples(spark, sf_dir).drop("frames"), fx.spans(spark, sf_dir)).select("sample_id", "span_id")


@query(f"SELECT trace_id, span_id, CAST(sum(weight) AS BIGINT) AS weight FROM (SELECT 't0' AS trace_id, span_id, weight FROM ({_INNERMOST})) WHERE span_id IS NOT NULL GROUP BY 1, 2", "fx_samples", "fx_spans")
def span_samples(spark, sf_dir):
    return sched.span_samples(fx.samples(spark, sf_dir), fx.spans(spark, sf_dir), ["trace_id"])


# -------------------------------------------------------------------- streaming


@query("SELECT ts_ns, pid, tid, cpu, kind, value FROM fx_events", "fx_events")
def ingest_stream(spark, sf_dir):
    """Two landings, two runs: the second one adds only what is new."""
    base = scratch_folder(spark, "stream")
    raw = _raw(spark, sf_dir, "linux").drop("event_id")
    for part in ("cpu < 2", "cpu >= 2"):
        raw.where(part).write.mode("append").json(f"{base}/in")
        live.ingest_stream(spark, f"{base}/in", "linux", f"{base}/out", time_bin_ns=DAY).awaitTermination()
    return spark.read.parquet(f"{base}/out/events").select("ts_ns", "pid", "tid", "cpu", "kind", "value")


@query("SELECT ts_ns, pid, tid, cpu, kind, value FROM fx_events", "fx_events")
def ingest_overlapping(spark, sf_dir):
    """Two landings that share half of the events, in two runs: each event is ingested once."""
    base = scratch_folder(spark, "stream")
    raw = _raw(spark, sf_dir, "linux").drop("event_id")
    for part in ("cpu < 3", "cpu >= 1"):
        raw.where(part).write.mode("append").json(f"{base}/in")
        live.ingest_stream(spark, f"{base}/in", "linux", f"{base}/out", time_bin_ns=DAY, dedupe=["ts_ns", "pid", "tid", "kind"], delay="40 days").awaitTermination()
    return spark.read.parquet(f"{base}/out/events").select("ts_ns", "pid", "tid", "cpu", "kind", "value")


@query(f"SELECT trace_id, ts_ns, pid, tid, cpu, kind, value FROM fx_events WHERE ts_ns >= {T0 + 2 * DAY} AND ts_ns < {T0 + 9 * DAY}", "fx_events")
def read_ingested(spark, sf_dir):
    """What a stream has ingested, read as a trace."""
    base = scratch_folder(spark, "stream")
    _raw(spark, sf_dir, "linux").drop("event_id").write.json(f"{base}/in")
    live.ingest_stream(spark, f"{base}/in", "linux", f"{base}/out", time_bin_ns=DAY).awaitTermination()
    return Trace.read(spark, f"{base}/out", "t0", T0 + 2 * DAY, T0 + 9 * DAY).table("events").select("trace_id", "ts_ns", "pid", "tid", "cpu", "kind", "value")


@query(f"SELECT kind, start, count(*) AS n FROM (SELECT kind, make_timestamp((ts_ns // {DAY}) * {DAY // 1000}) AS start FROM fx_events) WHERE start < (SELECT make_timestamp((max(ts_ns) // {DAY}) * {DAY // 1000}) FROM fx_events) GROUP BY 1, 2", "fx_events")
def live_timeline(spark, sf_dir):
    """Closed days of the stream, in append mode; the last open day stays in state."""
    base = scratch_folder(spark, "live")
    fx.events(spark, sf_dir).select("ts_ns", "kind").write.parquet(f"{base}/in")
    stream = spark.readStream.schema("ts_ns bigint, kind string").parquet(f"{base}/in")
    counts = live.live_timeline(stream, "1 day", "0 seconds", ["kind"])
    counts.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select("kind", F.col("start").cast("timestamp_ntz").alias("start"), "n")


for _name, (_spark_sql, _duck_sql) in acceptance.SQL.items():
    QUERIES[_name] = acceptance.query(_spark_sql)
    ORACLE_SQL[_name] = _duck_sql
