"""Stored rollups, clocks, contexts of stacks, pieces of ranges and deduplicated streams, each against brute force."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tracelake.operators import clocks, flame, sched, symbols, timeline
from tracelake.plans import ranges
from tracelake.plans.ranges import disjoint, point_in_range
from tracelake.sources import rollups, storage
from tracelake.streaming import live


def events_of(spark, times, seed=1):
    rng = random.Random(seed)
    rows = [("t0", k, t, 1, 1, 0, rng.choice("ab"), rng.randrange(100_000)) for k, t in enumerate(times)]
    return spark.createDataFrame(rows, "trace_id string, event_id long, ts_ns long, pid long, tid long, cpu int, kind string, v long")


def partitions_read(df):
    """Folders that the scans of a collected frame have read."""
    plans, total = [df._jdf.queryExecution().executedPlan()], 0
    while plans:
        plan = plans.pop()
        if plan.nodeName().startswith("AdaptiveSparkPlan"):
            plans.append(plan.executedPlan())
        elif "QueryStage" in plan.nodeName():
            plans.append(plan.plan())
        elif plan.nodeName().startswith("Scan parquet") and plan.metrics().contains("numPartitions"):
            total += plan.metrics().apply("numPartitions").value()
        children = plan.children()
        plans += [children.apply(k) for k in range(children.size())]
    return total


# ------------------------------------------------------------------- the pyramid


@pytest.mark.parametrize("t0, t1, w", [(0, 640, 64), (0, 640, 10), (-320, 640, 6), (30, 630, 7), (10, 20, 1), (-1000, 2000, 3), (70, 550, 48)])
def test_pyramid_gives_the_counts_of_the_events(spark, tmp_path, t0, t1, w):
    rng = random.Random(4)
    events = events_of(spark, [rng.randint(-400, 700) for _ in range(400)])
    path = str(tmp_path / "p")
    rollups.write_pyramid(events.where("event_id < 250"), path, 10, 6, ["kind"])
    rollups.write_pyramid(events.where("event_id >= 250"), path, 10, 6, ["kind"], append=True)
    if timeline.pixel_width(t0, t1, w) % 10:
        with pytest.raises(ValueError):
            rollups.timeline_from_pyramid(spark, path, t0, t1, w)
        return
    got = rollups.timeline_from_pyramid(spark, path, t0, t1, w).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, timeline.timeline_counts(events, t0, t1, w, ["kind"]).collect()))


def test_aligned_pixels_read_one_level(spark, tmp_path, capsys):
    path = str(tmp_path / "p")
    rollups.write_pyramid(events_of(spark, range(0, 5000, 7)), path, 10, 6, ["kind"])
    said = storage.told(spark, path)
    assert rollups._level_of(said, 0, 3200, 10) == (5, [5], 320)
    assert rollups._level_of(said, 0, 3000, 10) == (4, [1, 2, 3, 4], 300)
    rollups.timeline_from_pyramid(spark, path, 0, 3200, 10).explain("formatted")
    plan = capsys.readouterr().out
    assert re.search(r"PartitionFilters: \[.*level#\d+ = 5\)", plan) and "numPartitions" not in plan
    got = rollups.timeline_from_pyramid(spark, path, 0, 3200, 10)
    got.collect()
    assert partitions_read(got) == 1
    with pytest.raises(ValueError):
        rollups.write_pyramid(events_of(spark, [1]), path, 20, 6, ["kind"], append=True)
    with pytest.raises(FileNotFoundError):
        rollups.timeline_from_pyramid(spark, str(tmp_path / "none"), 0, 10, 1)


# ------------------------------------------------------------------ the sketches


def test_sketches_are_near_and_merge(spark, tmp_path):
    events = events_of(spark, range(0, 30_000, 3))
    path = str(tmp_path / "s")
    rollups.write_sketches(events.where("event_id % 2 = 0"), path, "v", 1000, ["kind"])
    rollups.write_sketches(events.where("event_id % 2 = 1").union(events.limit(1).withColumn("v", F.lit(None).cast("long"))), path, "v", 1000, ["kind"], append=True)
    for t0, t1 in ((None, None), (5000, 20_000)):
        rows = [r for r in events.collect() if t0 is None or t0 <= r.ts_ns < t1]
        for by in (["kind"], []):
            for got in rollups.summary_from_sketches(spark, path, t0, t1, by).collect():
                values = sorted(r.v for r in rows if not by or r.kind == got.kind)
                assert (got.n, got.total, got.least, got.most) == (len(values), sum(values), values[0], values[-1])
                for p, x in ((0.5, got.p50), (0.95, got.p95), (0.99, got.p99)):
                    assert sum(v < x for v in values) <= (p + 0.01) * len(values) and sum(v <= x for v in values) >= (p - 0.01) * len(values)
                assert abs(got.n_distinct - len(set(values))) <= 0.03 * len(set(values))
    assert rollups.summary_from_sketches(spark, path, 90_000, 91_000, []).count() == 0
    with pytest.raises(ValueError):
        rollups.summary_from_sketches(spark, path, 5, 1000)


# ------------------------------------------------------------- the index of frames


def test_frame_index_prunes_partitions(spark, tmp_path):
    rng = random.Random(2)
    rows = [("t0" if k % 3 else "t1", k, k * 10, k % 4, k % 7, [rng.randrange(5), 7 if 300 <= k < 330 else 6], 1) for k in range(600)]
    samples = spark.createDataFrame(rows, "trace_id string, sample_id long, ts_ns long, pid long, tid long, frames array<long>, weight long")
    store, index = str(tmp_path / "t"), str(tmp_path / "i")
    storage.write_trace({"samples": samples}, store, 100)
    rollups.write_frame_index(samples, index, 100)
    found = rollups.samples_with_frame(spark, store, index, 7)
    assert sorted(r.sample_id for r in found.collect()) == list(range(300, 330))
    whole = spark.read.parquet(f"{store}/samples")
    assert whole.count() == 600 and partitions_read(found) < 20 < whole.select("trace_id", "time_bin").distinct().count()
    found = rollups.samples_with_frame(spark, store, index, 7, "t1", 3100, 3200)
    assert sorted(r.sample_id for r in found.collect()) == [r[1] for r in rows if 310 <= r[1] < 320 and r[0] == "t1"]
    others = spark.createDataFrame([("t0", 1, 1), ("t1", 9, 9), ("t0", 2, 4)], "trace_id string, pid long, tid long")
    threads = {(r[0], r[3], r[4]) for r in rows if 7 in r[5]}
    assert {tuple(r) for r in rollups.of_threads_with_frame(others, index, 7).collect()} == threads & {("t0", 1, 1), ("t1", 9, 9), ("t0", 2, 4)}
    assert rollups.samples_with_frame(spark, store, index, 99).count() == 0


# ------------------------------------------------------------- contexts of stacks


def test_contexts_are_the_paths_tree(spark):
    rng = random.Random(6)
    rows = [([rng.choice("abc") for _ in range(rng.randrange(0, 6))], rng.randrange(1, 5)) for _ in range(200)]
    folded = flame.fold_stacks(spark.createDataFrame(rows, "stack array<string>, weight long"))
    paths = {tuple(r.path): (r.depth, r.name, r.total, r.self, r.x) for r in flame.flame_layout(flame.flame_tree(folded)).collect()}
    nodes = flame.context_layout(folded)
    got = {tuple(r.path): (r.depth, r.name, r.total, r.self, r.x) for r in flame.context_paths(nodes, folded).collect()}
    assert got == paths
    by_id = {r.id: r for r in nodes.collect()}
    assert all(r.parent == "" or by_id[r.parent].depth == r.depth - 1 for r in by_id.values())
    assert {r.id: r.total for r in flame.context_tree(folded).collect()} == {i: r.total for i, r in by_id.items()}


def test_contexts_of_two_profiles(spark):
    rng = random.Random(16)
    a, b = (spark.createDataFrame([([rng.choice("abc") for _ in range(rng.randrange(0, 5))], rng.randrange(1, 5)) for _ in range(60)], "stack array<string>, weight long") for _ in range(2))
    known = sorted((len(r.path), r.path[-1], r.total_a, r.total_b, r.diff) for r in flame.flame_diff(flame.fold_stacks(a), flame.fold_stacks(b)).collect())
    assert sorted((r.depth, r.name, r.total_a, r.total_b, r.diff) for r in flame.context_diff(a, b).collect()) == known


def test_contexts_of_deep_stacks(spark):
    """500 frames deep: the intervals of a tree by hand, in rows of a fixed size."""
    deep = [f"f{k % 40}" for k in range(500)]
    rows = [(deep, 3), (deep[:499], 2), (deep[:250] + ["z"] * 250, 4), (["f0", "a", None], 1)]
    folded = spark.createDataFrame(rows, "stack array<string>, weight long")
    totals, own = defaultdict(int), defaultdict(int)
    for stack, weight in rows[:3]:
        own[tuple(stack)] += weight
        for d in range(1, len(stack) + 1):
            totals[tuple(stack[:d])] += weight
    begins = {(): 0}
    for path in sorted(totals, key=len):
        begins[path] = begins[path[:-1]] + sum(totals[x] for x in totals if len(x) == len(path) and x[:-1] == path[:-1] and x[-1] < path[-1])
    got = flame.context_layout(folded.where("weight > 1")).collect()
    assert sorted((r.depth, r.name, r.total, r.self, r.x) for r in got) == sorted((len(x), x[-1], n, own[x], begins[x]) for x, n in totals.items()) and len(got) == 750
    assert max(len(r.id) + len(r.parent) + len(r.name) for r in got) < 70
    names = {(r.depth, r.name): r.x for r in flame.context_layout(folded).collect()}
    assert names[2, "a"] == 0 and names[3, "?"] == 0 and names[2, "f1"] == 1


# ---------------------------------------------------------------- pieces of ranges


def test_disjoint_pieces(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), a, a + rng.choice([-1, 0, 3, 40, 5000]), k) for k in range(60) for a in [rng.randint(-300, 300)]] + [("c", -(2**63), 2**63 - 1, 900), ("c", 5, 5, 901)]
    for long_keys in (True, False):
        ranges = spark.createDataFrame(rows, "key string, lo long, hi long, id long")
        got = disjoint(ranges, keys=["key"], lo="lo", hi="hi", shift=4, best=F.col("id"), long_keys=long_keys).collect()
        pieces = defaultdict(list)
        for r in got:
            pieces[r.key].append((r.lo, r.hi, r.best))
        for key, own in pieces.items():
            own.sort()
            assert all(a[1] < b[0] for a, b in zip(own, own[1:]))
            for x in [*range(-320, 400), 2000, 5200]:
                best = max((i for k, a, b, i in rows if k == key and a <= x <= b), default=None)
                assert next((i for a, b, i in own if a <= x <= b), None) == best


def test_wide_ranges_do_not_multiply(spark):
    """Ranges of all widths, in both ways of joining."""
    rng = random.Random(9)
    ranges = [("m", a, a + (1 << rng.randrange(0, 61)), k) for k, a in enumerate(rng.sample(range(-(2**61), 2**61), 40))]
    points = [("m", rng.randint(-(2**62), 2**62), k) for k in range(300)] + [("m", ranges[k][1], 1000 + k) for k in range(40)]
    left, right = spark.createDataFrame(points, "key string, p long, n long"), spark.createDataFrame(ranges, "key string, lo long, hi long, id long")
    at = dict(keys=["key"], point=F.col("p"), lo=F.col("lo"), hi=F.col("hi"), shift=12)
    got = point_in_range(left, right, how="inner", **at).select("n", "id").collect()
    assert sorted(map(tuple, got)) == sorted((n, i) for _, p, n in points for _, a, b, i in ranges if a <= p <= b)
    flat = disjoint(right, keys=["key"], lo="lo", hi="hi", shift=12, best=F.col("id"))
    got = {r.n: r.best for r in point_in_range(left, flat, how="left", **at).collect()}
    assert got == {n: max((i for _, a, b, i in ranges if a <= p <= b), default=None) for _, p, n in points}


def test_modules_that_overlap_and_load_again(spark):
    rng = random.Random(10)
    modules = [("t", rng.randrange(2), f"m{k % 5}", base, base + rng.randrange(1, 400), load, load + rng.randrange(1, 300)) for k in range(30) for base, load in [(rng.randrange(-200, 800), rng.randrange(0, 500))]]
    frames = [("t", rng.randrange(3), rng.randrange(0, 800), rng.randrange(-300, 1300), k) for k in range(500)] + [("t", 0, 5, None, 1000)]
    m = spark.createDataFrame(modules, "trace_id string, pid long, module string, base long, limit_addr long, load_ns long, unload_ns long").where("not (base < 0 and limit_addr > 0)")
    modules = [tuple(r) for r in m.collect()]
    got = symbols.attach_module(spark.createDataFrame(frames, "trace_id string, pid long, ts_ns long, addr long, n long"), m, shift=4).collect()
    unsigned = lambda x: x % 2**64
    for r in got:
        live_ = [(load, base, name) for _, pid, name, base, limit, load, unload in modules if r.addr is not None and pid == r.pid and unsigned(base) <= unsigned(r.addr) <= unsigned(limit - 1) and load <= r.ts_ns < unload]
        assert r.module == (max(live_)[2] if live_ else None)
    assert len(got) == len(frames)


@pytest.mark.parametrize("most", [0, 10**6])
def test_a_wide_module_takes_few_rows_and_only_counted_rows_are_broadcast(spark, monkeypatch, most):
    """A module of 10**9 addresses had 954 rows for each process, which Spark broadcast whole."""
    monkeypatch.setattr(ranges, "BROADCAST_ROWS", most)
    rows = [("t", p, m, a, b, 0, 100) for p in range(20) for m, a, b in (("app", 0, 1000), ("lib", 1000, 10**9))]
    modules = spark.createDataFrame(rows, "trace_id string, pid long, module string, base long, limit_addr long, load_ns long, unload_ns long")
    pieces = symbols.module_pieces(modules)
    side, widths = ranges._in_bins(pieces, ["trace_id", "pid"], F.col("lo"), F.col("hi"), symbols.MODULE_BITS)
    assert pieces.count() == 40 and side.count() <= (ranges.MOST_BINS + 1) * 20 and len(widths) == 2
    frames = spark.createDataFrame([("t", p, 5, a) for p in range(21) for a in (-1, 0, 999, 1000, 10**9 - 1, 10**9)], "trace_id string, pid long, ts_ns long, addr long")
    found = symbols.attach_module(frames, modules)
    assert ("BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()) == (most > 0)
    names = {0: "app", 999: "app", 1000: "lib", 10**9 - 1: "lib"}
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((("t", p, 5, a, names.get(a) if p < 20 else None) for p in range(21) for a in (-1, 0, 999, 1000, 10**9 - 1, 10**9)), key=repr)


def test_innermost_of_nested_and_crossing_spans(spark):
    spans = [(1, 0, 100), (2, 10, 50), (3, 20, 30), (4, 20, 30), (5, 40, 70), (6, 60, 60), (7, 90, 200), (8, 300, 400)]
    df = spark.createDataFrame([("t", i, a, b, 1, 1, "k") for i, a, b in spans], "trace_id string, span_id long, start_ns long, end_ns long, pid long, tid long, kind string")
    samples = spark.createDataFrame([("t", t, t, 1, 1, 1) for t in range(0, 420, 5)] + [("t", 1000, 25, 1, 2, 1)], "trace_id string, sample_id long, ts_ns long, pid long, tid long, weight long")
    got = {r.sample_id: r.span_id for r in sched.innermost_span(samples, df).collect()}
    for t in range(0, 420, 5):
        assert got[t] == max(((a, -b, i) for i, a, b in spans if a <= t < b), default=(0, 0, None))[2]
    assert got[1000] is None and got[25] == 4 and len(got) == 85
    assert sum(r.weight for r in sched.span_samples(samples, df, ["trace_id"]).collect()) == sum(x is not None for x in got.values())


@pytest.mark.parametrize("shift, most", [(None, 0), (None, 10**6), (0, 0), (3, 10**6), (40, 0)])
def test_innermost_spans_are_taken_where_they_meet(spark, monkeypatch, shift, most):
    """Samples and spans are shuffled once: the plan had four exchanges, and pieces of spans were shuffled and written before."""
    monkeypatch.setattr(ranges, "BROADCAST_ROWS", most)
    rng = random.Random(11)
    spans = [(i, a, a + rng.choice([-2, 0, 1, 9, 80, 3000]), rng.choice([1, 2, None])) for i in range(150) for a in [rng.randrange(-500, 500)]]
    points = [(k, rng.randrange(-600, 4000) if k % 9 else None, rng.choice([1, 2, 3, None]), [k, None]) for k in range(300)]
    points += points[:30]  # repeated rows stay as many
    df = spark.createDataFrame([("t", i, a, b, 1, lane) for i, a, b, lane in spans], "trace_id string, span_id long, start_ns long, end_ns long, pid long, tid long")
    samples = spark.createDataFrame([("t", k, t, 1, lane, x) for k, t, lane, x in points], "trace_id string, sample_id long, ts_ns long, pid long, tid long, frames array<long>")
    found = sched.innermost_span(samples, df, shift)
    if most == 0 and shift == 40:
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    best = lambda t, lane: max(((a, -b, i) for i, a, b, own in spans if t is not None and own == lane is not None and a <= t < b), default=(0, 0, None))[2]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((("t", k, t, 1, lane, x, best(t, lane)) for k, t, lane, x in points), key=repr)
    assert sched.innermost_span(samples, df.limit(0), shift).where("span_id is null").count() == len(points)


# ------------------------------------------------------------------------- clocks


@pytest.mark.parametrize("offset, drift", [(1_500_000_000, 40_000), (-7_000_000_123, -25_000), (0, 0)])
def test_a_known_clock_is_found(spark, offset, drift):
    rng = random.Random(12)
    origin, second, rows = 1_704_067_200_000_000_000, 1_000_000_000, []
    ahead = lambda t: t + offset + (t - origin) * drift // 10**9
    for k in range(2000):
        t = origin + k * 300 * second // 10
        way = 20_000 + int(rng.expovariate(1 / 3_000_000))
        if 10 <= k // 100 < 12:
            way += 40 * second if k % 2 else 0  # two bins in which one direction is stuck
        a, b = ("t0", t, ahead(t + way), "t1") if k % 2 else ("t1", ahead(t), t + way, "t0"), None
        rows += [(a[0], k, "sent", a[1]), (a[3], k, "received", a[2])]
    rows += [("t0", 5000, "sent", origin), ("t1", 5001, "received", origin), ("t0", 5002, "sent", origin), ("t0", 5002, "sent", origin), ("t1", 5002, "received", origin)]
    events = spark.createDataFrame(rows, "trace_id string, message long, kind string, ts_ns long")
    messages = clocks.match_messages(events, "sent", "received", ["message"])
    assert messages.count() == 2000
    found = clocks.fit_clocks(clocks.clock_offsets(messages, "t0", 300 * 10 * second)).collect()
    (clock,) = found
    assert abs(clock.drift_ppb - drift) < 60
    aligned = clocks.align(events.where("message < 2000"), spark.createDataFrame(found), ["ts_ns"])
    by = defaultdict(dict)
    for r in aligned.collect():
        by[r.message][r.kind] = r.ts_ns
    late = [m["received"] - m["sent"] for m in by.values()]
    assert min(late) > -1_000_000 and aligned.columns == events.columns  # no message arrives a millisecond before it is sent
    same = {(r.message, r.ts_ns) for r in aligned.where("trace_id = 't0'").collect()}
    assert same == {(m, t) for i, m, _, t in rows if i == "t0" and m < 2000}


# ------------------------------------------------------------------------ streams


def test_overlapping_landings_are_ingested_once(spark, tmp_path):
    rows = [(f"{k}.5", k % 3, k % 5, 0, "k", "{}") for k in range(60)]
    raw = spark.createDataFrame(rows, "time_s string, pid long, tid long, cpu int, event string, args_json string").selectExpr("cast(time_s as decimal(20,9)) as time_s", "pid", "tid", "cpu", "event", "args_json")
    base, keys = str(tmp_path), ["ts_ns", "pid", "tid", "kind"]
    for part in ("time_s < 40", "time_s >= 20"):
        raw.where(part).write.mode("append").json(f"{base}/in")
        live.ingest_stream(spark, f"{base}/in", "linux", f"{base}/out", time_bin_ns=10**10, dedupe=keys, delay="1 hour").awaitTermination()
    got = storage.read_trace(spark, f"{base}/out")["events"]
    both = raw.where("time_s < 40").union(raw.where("time_s >= 20"))
    assert got.count() == 60 and both.count() == 80
    assert got.select(keys).distinct().count() == 60
    again = storage.dedupe_events(got, keys)
    assert sorted(map(tuple, again.select(keys).collect())) == sorted(map(tuple, got.select(keys).collect()))
