"""Rules and invariants of the trace operators on small rows."""

import random

import pytest
from pyspark.sql import functions as F

from tracelake.operators import flame, sched, selection, symbols, tables, timeline
from tracelake.operators.selection import Selection
from tracelake.plans import lanes
from tracelake.plans.ranges import point_in_range, running_sum
from tracelake.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def spans_of(spark, rows):
    return spark.createDataFrame([("t", k, a, b, 1, lane, "x") for k, (a, b, lane) in enumerate(rows)], "trace_id string, span_id long, start_ns long, end_ns long, pid long, tid long, kind string")


def test_selection_is_immutable_and_empty_selects_all(spark):
    s = selection.Selection()
    assert s.time(0, 5) is not s and s.t0 is None
    e = fx.events(spark, SF)
    assert s.apply({"e": e})["e"].count() == e.count()
    assert "PushedFilters" in plan(e.where(s.process(3).predicate(e)))


def test_frame_selection_carries_to_threads(spark):
    samples = spark.createDataFrame([("t", 1, 1, ["a", "b"]), ("t", 1, 2, ["c"])], "trace_id string, pid long, tid long, stack array<string>")
    events = spark.createDataFrame([("t", 1, 1, 10), ("t", 1, 2, 11), ("u", 1, 1, 12)], "trace_id string, pid long, tid long, event_id long")
    out = selection.Selection().frame("b").apply({"s": samples, "e": events}, carry="thread")
    assert [r.event_id for r in out["e"].collect()] == [10] and out["s"].count() == 1
    assert selection.Selection().frame("b").apply({"s": samples, "e": events})["e"].count() == 3


def test_pages_follow_each_other(spark):
    df = spark.createDataFrame([(k % 5, k) for k in range(37)], "a long, id long")
    order, got, after = [("a", "desc"), ("id", "asc")], [], None
    while rows := tables.page(df, order, after, 10).collect():
        got += rows
        after = (rows[-1].a, rows[-1].id)
    assert got == df.orderBy(F.desc("a"), "id").collect()
    assert "TakeOrderedAndProject" in plan(tables.top_k(df, order, 3))


def test_approximate_summary_is_near(spark):
    df = spark.range(20000).selectExpr("id % 2 as g", "id as x")
    for a, b in zip(tables.summarize(df, ["g"], "x").orderBy("g").collect(), tables.summarize(df, ["g"], "x", approx=True).orderBy("g").collect()):
        assert abs(a.p95 - b.p95) <= 20 and abs(a.n_distinct - b.n_distinct) <= 0.1 * a.n_distinct and a.total == b.total


@pytest.mark.parametrize("width", [None, 3, 1000])
def test_ranked_summary_is_the_exact_one(spark, width):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randint(-50, 50), rng.randint(-5000, 5000)])) for _ in range(400)] + [("one", 7), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v long")
    got = {r.g: tuple(r)[1:] for r in tables.summarize_ranked(df, ["g"], "v", width).collect()}
    expected = {r.g: tuple(r)[1:] for r in tables.summarize(df, ["g"], "v").where("n > 0").collect()}
    assert got.keys() == expected.keys()
    for g, values in expected.items():
        assert got[g] == pytest.approx(values)
    assert tables.summarize_ranked(df.where("g = 'none'"), ["g"], "v", 1).count() == 0


def test_timeline_totals(spark):
    e, t0, day = fx.events(spark, SF), 1_704_067_200 * 10**9, 86_400 * 10**9
    counts = timeline.timeline_counts(e, t0, t0 + 10 * day, 333, ["kind"])
    assert counts.agg(F.sum("n")).first()[0] == e.where((F.col("ts_ns") >= t0) & (F.col("ts_ns") < t0 + 10 * day)).count()
    assert counts.agg(F.max("px")).first()[0] < 333
    levels = timeline.build_pyramid(e, 10**9, 6, ["kind"]).groupBy("level").agg(F.sum("n").alias("n")).collect()
    assert {r.n for r in levels} == {e.count()} and len(levels) == 6


def test_busy_time_of_spans_over_many_pixels(spark):
    rng = random.Random(2)
    rows = [(a, a + rng.randint(0, 900), rng.randint(0, 2)) for a in (rng.randint(-200, 1100) for _ in range(200))] + [(-50, 5000, 0), (3, 3, 1)]
    for w in (7, 100, 1000):
        got = {(r.tid, r.px): r.busy_ns for r in timeline.timeline_busy(spans_of(spark, rows), 0, 1000, w, ["tid"]).collect()}
        bw, expected = timeline.pixel_width(0, 1000, w), {}
        for a, b, lane in rows:
            for px in range(max(a, 0) // bw, -(-min(b, 1000) // bw) if b > 0 else 0):
                n = min(b, 1000, (px + 1) * bw) - max(a, 0, px * bw)
                if n > 0:
                    expected[lane, px] = expected.get((lane, px), 0) + n
        assert got == expected


def test_merged_spans_and_gaps_tile_the_lane(spark):
    rng = random.Random(3)
    rows = [(a, a + rng.randint(1, 9), a % 2) for a in (rng.randint(0, 300) for _ in range(80))]
    spans = spans_of(spark, rows)
    merged, gaps = timeline.merge_spans(spans, ["tid"]).collect(), timeline.span_gaps(spans, ["tid"]).collect()
    for lane in (0, 1):
        own = sorted((r.start_ns, r.end_ns) for r in merged if r.tid == lane)
        parts = sorted([*own, *((r.start_ns, r.end_ns) for r in gaps if r.tid == lane)])
        assert all(a[1] == b[0] for a, b in zip(parts, parts[1:])) and all(a[1] < b[0] for a, b in zip(own, own[1:]))
    assert sum(r.n for r in merged) == len(rows)
    open_ = timeline.concurrency(spans, ["tid"], bucket_ns=50).collect()
    for r in open_:
        assert r.n_open == sum(a <= r.ts_ns < b for a, b, lane in rows if lane == r.tid)


def io_of(spark, *traces):
    """A request key for each trace of starts and ends."""
    rows = [("t", 1000 * n + k, 10 * k, n, kind, float(k)) for n, kinds in enumerate(traces) for k, kind in enumerate(kinds)]
    return spark.createDataFrame(rows, "trace_id string, event_id long, ts_ns long, key long, kind string, value double")


IO = [
    ("eseseseses", [(1, 2), (3, 4), (5, 6), (7, 8)], (1, 1)),  # the trace begins amid a request and ends amid one
    ("sssesese", [(2, 3), (4, 5), (6, 7)], (2, 0)),  # two lost ends
    ("seesesee", [(0, 1), (3, 4), (5, 6)], (0, 2)),  # two lost starts
    ("sseess", [(0, 3), (1, 2)], (2, 0)),  # nested
    ("eeee", [], (0, 4)),
    ("ssss", [], (4, 0)),
]


@pytest.mark.parametrize("bin_ns", [None, 0, 1, 20])
def test_io_pairs_survive_lost_rows(spark, bin_ns):
    events = io_of(spark, *(x[0] for x in IO))
    found = sched.pair_io(events, "s", "e", ["key"], bin_ns).collect()
    left = {r.key: (r.n_pairs, r.n_starts, r.n_ends) for r in sched.unpaired_io(events, "s", "e", ["key"], bin_ns).collect()}
    for n, (_, pairs, alone) in enumerate(IO):
        assert sorted((r.start_ns // 10, r.end_ns // 10) for r in found if r.key == n) == pairs
        assert left[n] == (len(pairs), *alone)
    assert all(r.span_id == 1000 * r.key + r.start_ns // 10 and r.size == r.end_ns / 10 for r in found)


def test_one_lost_row_spoils_one_pair(spark):
    rng = random.Random(11)
    kinds = "".join(rng.choice(["se", "sese", "ssee"]) for _ in range(30))
    assert sched.pair_io(io_of(spark, kinds), "s", "e", ["key"]).count() == len(kinds) // 2
    sequential = io_of(spark, "se" * 30)
    for lost in (0, 7, 30, 59):
        found = {(r.start_ns, r.end_ns) for r in sched.pair_io(sequential.where(f"event_id <> {lost}"), "s", "e", ["key"]).collect()}
        assert found == {(20 * k, 20 * k + 10) for k in range(30) if k != lost // 2}


def lanes_by_hand(rows, gap):
    out = []
    for lane in {r[2] for r in rows}:
        own = None
        for a, b, _ in sorted(r for r in rows if r[2] == lane):
            if own and (a - own[1] <= 0 if gap == 0 else a - own[1] < gap):
                own = [own[0], max(own[1], b), own[2] + 1]
                out[-1] = (lane, *own)
            else:
                own = [a, b, 1]
                out.append((lane, *own))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bin_ns", [1, 7, 50, 100_000, 0, None])
@pytest.mark.parametrize("gap", [0, 5])
def test_merged_spans_over_bins(spark, bin_ns, gap):
    """Spans over several bins, empty bins, a null lane, times below zero, one lane that is always busy."""
    rng = random.Random(7)
    rows = [(a, a + rng.choice([0, 1, 3, 40]), rng.choice([0, None])) for a in (rng.randint(-300, 300) for _ in range(60))]
    rows += [(2000, 2001, 0), (-5000, -4000, 0)] + [(k, k + 2, 2) for k in range(0, 200, 2)]
    df = spark.createDataFrame([("t0", k, *r) for k, r in enumerate(rows)], "trace_id string, span_id long, start_ns long, end_ns long, tid long")
    expected = lanes_by_hand(rows, gap)
    assert sorted(map(tuple, timeline.merge_spans(df, ["tid"], gap, bin_ns).select("tid", "start_ns", "end_ns", "n").collect()), key=repr) == expected
    if gap == 0:
        by_time = sorted(expected, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        gaps = sorted([(a[0], a[2], b[1], b[1] - a[2]) for a, b in zip(by_time, by_time[1:]) if a[0] == b[0]], key=repr)
        assert sorted(map(tuple, timeline.span_gaps(df, ["tid"], bin_ns).select("tid", "start_ns", "end_ns", "gap_ns").collect()), key=repr) == gaps


def test_one_lane_runs_in_many_tasks(spark):
    rows = [(k * k % 9973, k) for k in range(5000)]
    df = spark.createDataFrame(rows, "t long, id long").withColumn("lane", F.lit(1))
    ordered = sorted(rows)
    for width in (200, 0):
        shifted = lanes.led(lanes.lagged(df, ["lane"], ["t", "id"], "id", "before", width), ["lane"], ["t", "id"], "id", "after", width)
        got = {r.id: (r.before, r.after) for r in shifted.collect()}
        assert got == {r[1]: (ordered[k - 1][1] if k else None, ordered[k + 1][1] if k + 1 < len(ordered) else None) for k, r in enumerate(ordered)}
    summed = lanes.summed(df, ["lane"], ["t", "id"], "id", "s", 200)
    total, expected = 0, {}
    for _, k in ordered:
        total += k
        expected[k] = total
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or so few rows meet in one task
    tasks = summed.withColumn("task", F.spark_partition_id()).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.id: r.s for r in tasks} == expected
    assert len({r.task for r in tasks}) > 1
    assert lanes.bin_width(df, ["lane"], "t", 100) == -(-9973 * 100 // 5000) and lanes.bin_width(df, ["lane"], "t", 5000) == 0


def test_concurrency_of_null_keys(spark):
    df = spark.createDataFrame([(0, 10, None), (5, 7, None), (3, 4, 1)], "start_ns long, end_ns long, kind long")
    got = sorted((r.kind is None, r.ts_ns, r.n_open) for r in timeline.concurrency(df, ["kind"], 2).collect())
    assert got == [(False, 3, 1), (False, 4, 0), (True, 0, 1), (True, 5, 2), (True, 7, 1), (True, 10, 0)]


def test_running_sum_over_buckets(spark):
    df = spark.createDataFrame([(k % 2, k * 7 - 500, k) for k in range(300)], "g long, t long, v long")
    got = running_sum(df, ["g"], "t", "v", 100, "s").collect()
    assert all(r.s == sum(k for k in range(300) if k % 2 == r.g and k * 7 - 500 <= r.t) for r in got)


def test_range_join_has_no_nested_loop_and_keeps_unsigned_order(spark):
    functions = spark.createDataFrame([("m", 10, 20, "f"), ("m", 2**63 - 4, -(2**63) + 4, "edge"), ("m", -100, -1, "kernel"), ("m", 5000, 5000 + 2**40, "wide"), ("n", 10, 20, "other")], "module string, lo long, hi long, fn string")
    rows = [("m", a) for a in (9, 10, 19, 20, 2**63 - 5, 2**63 - 4, 2**63 - 1, -(2**63), -(2**63) + 3, -(2**63) + 4, -100, -2, -1, 4999, 5000, 2**40)] + [("n", 10), ("x", 10), ("m", None), ("m", 10)]
    df = symbols.symbolize(spark.createDataFrame(rows, "module string, addr long"), functions)
    got = [(r.module, r.addr, r.fn) for r in df.collect()]
    assert len(got) == len(rows) and "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)
    names = {(m, a): f for m, a, f in got}
    assert [names["m", a] for a in (9, 10, 19, 20)] == ["0x9", "f", "f", "0x14"]
    assert [names["m", a] for a in (2**63 - 5, 2**63 - 4, 2**63 - 1, -(2**63), -(2**63) + 3, -(2**63) + 4)] == ["0x7ffffffffffffffb", *["edge"] * 4, "0x8000000000000004"]
    assert [names["m", a] for a in (-100, -2, -1)] == ["kernel", "kernel", "0xffffffffffffffff"] and [names["m", a] for a in (4999, 5000, 2**40)] == ["0x1387", "wide", "wide"]
    assert names["n", 10] == "other" and names["x", 10] == "0xa" and names["m", None] is None


def test_interval_join_gives_every_pair(spark):
    rng = random.Random(4)
    spans = [(a, a + rng.choice((1, 5, 4000)), 0) for a in (rng.randint(0, 3000) for _ in range(60))]
    points = spark.createDataFrame([("t", k, 1, 0, rng.randint(0, 5000)) for k in range(100)], "trace_id string, sample_id long, pid long, tid long, ts_ns long")
    got = sorted((r.sample_id, r.span_id) for r in sched.samples_in_spans(points, spans_of(spark, spans), shift=4).collect())
    assert got == sorted((p.sample_id, k) for p in points.collect() for k, (a, b, _) in enumerate(spans) if a <= p.ts_ns < b)
    assert point_in_range(points.limit(0), spans_of(spark, spans), keys=["trace_id", "pid", "tid"], point=F.col("ts_ns"), lo=F.col("start_ns"), hi=F.col("end_ns"), shift=4).count() == 0


def test_stacks_keep_their_order_and_empty_ones(spark):
    samples = spark.createDataFrame([("t", 1, 1, 1, 0, [30, 12, 30, 99], 2), ("t", 2, 1, 1, 0, [], 1)], "trace_id string, sample_id long, pid long, tid long, ts_ns long, frames array<long>, weight long")
    names = spark.createDataFrame([("app", 10, 20, "f"), ("app", 30, 31, "main")], "module string, lo long, hi long, fn string")
    got = {r.sample_id: r.stack for r in symbols.symbolize_stacks(samples, names).collect()}
    assert got == {1: ["main", "f", "main", "0x63"], 2: []}


def test_stacks_over_several_modules(spark):
    samples = spark.createDataFrame([("t", 1, 1, 1, 5, [30, None, 130, 99], 2), ("t", 1, 1, 1, 50, [130], 1), ("t", 3, 2, 1, 5, None, 1)], "trace_id string, sample_id long, pid long, tid long, ts_ns long, frames array<long>, weight long")
    names = spark.createDataFrame([("app", 30, 31, "main"), ("lib", 125, 140, "g"), ("new", 125, 140, "h")], "module string, lo long, hi long, fn string")
    modules = [("t", 1, "app", 0, 90, 0, 100), ("t", 1, "lib", 100, 200, 0, 100), ("t", 1, "new", 120, 160, 40, 100), ("t", 1, "app", 0, 95, 0, 100)]
    modules = spark.createDataFrame(modules, "trace_id string, pid long, module string, base long, limit_addr long, load_ns long, unload_ns long")
    got = symbols.symbolize_stacks(samples, names, modules=modules)
    assert sorted((r.sample_id, r.ts_ns, r.stack) for r in got.collect()) == [(1, 5, ["main", "?", "g", "0x63"]), (1, 50, ["h"]), (3, 5, [])]
    assert got.where(Selection().frame("g").predicate(got)).count() == 1 == got.where(Selection().frame(99).predicate(got)).count()
    with pytest.raises(ValueError, match="symbolize"):
        samples.where(Selection().frame("g").predicate(samples))


def test_flame_graph_nests(spark):
    rows = [(["a", "b", "a"], 3), (["a", "b"], 2), (["a", "c"], 4), (["d"], 1), ([], 7)]
    folded = spark.createDataFrame(rows, "stack array<string>, weight long")
    nodes = {tuple(r.path): r for r in flame.flame_layout(flame.flame_tree(folded)).collect()}
    assert nodes["a",].total == 9 and nodes["a", "b"].self == 2 and nodes["a", "b"].x == 0 and nodes["a", "c"].x == 5 and nodes["d",].x == 9
    for path, r in nodes.items():
        children = [c for p, c in nodes.items() if p[:-1] == path]
        assert r.total == r.self + sum(c.total for c in children)
        assert all(r.x <= c.x and c.x + c.total <= r.x + r.total for c in children)
    summary = {r.fn: (r.inclusive, r.self) for r in flame.function_summary(folded).collect()}
    assert summary == {"a": (9, 3), "b": (5, 2), "c": (4, 4), "d": (1, 1)}
    diff = {tuple(r.path): r["diff"] for r in flame.flame_diff(folded, folded.where("weight > 2")).collect()}
    assert diff["a", "b"] == -2 and diff["d",] == -1


def test_scheduling(spark):
    rows = [("t", 1, 0, 0, 1, 1), ("t", 2, 10, 0, 1, 2), ("t", 3, 10, 0, 1, 1), ("t", 4, 30, 0, 1, 2), ("t", 5, 3, 1, 1, 9)]
    runs = sched.run_spans(spark.createDataFrame(rows, "trace_id string, switch_id long, ts_ns long, cpu int, pid long, tid long"))
    assert sorted((r.tid, r.start_ns, r.end_ns) for r in runs.collect()) == [(1, 0, 10), (1, 10, 30), (2, 10, 10)]
    assert {r.tid: r.cpu_ns for r in sched.cpu_time(runs, ["tid"]).collect()} == {1: 30, 2: 0}
    assert sched.off_cpu(runs).count() == 0
    io = [("t", k, ts, 1, kind, v) for k, (ts, kind, v) in enumerate([(1, "s", 0.0), (5, "e", 8.0), (6, "s", 0.0), (7, "s", 0.0), (9, "e", 4.0)])]
    pairs = sched.pair_io(spark.createDataFrame(io, "trace_id string, event_id long, ts_ns long, key long, kind string, value double"), "s", "e", ["key"])
    assert sorted((r.start_ns, r.end_ns, r.size) for r in pairs.collect()) == [(1, 5, 8.0), (7, 9, 4.0)]


def test_pyramid_rounds_negative_times_down(spark):
    times = [-25, -20, -11, -10, -1, 0, 9, 10, 39]
    got = timeline.build_pyramid(spark.createDataFrame([(t,) for t in times], "ts_ns long"), 10, 3, []).collect()
    expected = {(level, t // (10 << level)) for level in range(3) for t in times}
    assert {(r.level, r.bucket) for r in got} == expected
    assert all(r.n == sum(t // (10 << r.level) == r.bucket for t in times) for r in got)
