"""Scheduling and I/O."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lanes import bin_width, lagged, led, summed
from ..plans.ranges import greatest_in_range, point_in_range, usual_bits
from .tables import summarize


def run_spans(switches: DataFrame, bin_ns: int | None = None) -> DataFrame:
    """A thread runs on a CPU until that CPU's next switch; the last one of a CPU is open and dropped.

    A CPU's switches are dealt to bins of ``bin_ns``, by default of about as many rows each.
    """
    rows = switches.select("trace_id", "switch_id", "cpu", "pid", "tid", F.col("ts_ns").alias("start_ns"))
    return led(rows, ["trace_id", "cpu"], ["start_ns", "switch_id"], "start_ns", "end_ns", bin_ns).where("end_ns is not null")


def cpu_time(runs: DataFrame, by: list[str]) -> DataFrame:
    """Nanoseconds on a CPU and number of runs."""
    return runs.groupBy(*by).agg(F.sum(F.col("end_ns") - F.col("start_ns")).alias("cpu_ns"), F.count("*").alias("n_runs"))


def off_cpu(runs: DataFrame, bin_ns: int | None = None) -> DataFrame:
    """Time from the end of a thread's run to its next run; runs that follow at once have none.

    A thread's runs are dealt to bins of ``bin_ns``, by default of about as many rows each.
    """
    thread = ["trace_id", "pid", "tid"]
    ended = lagged(runs.select(*thread, "switch_id", "start_ns", "end_ns"), thread, ["start_ns", "switch_id"], "end_ns", "before", bin_ns)
    return ended.select(*thread, F.col("before").alias("start_ns"), F.col("start_ns").alias("end_ns")).where("end_ns > start_ns").withColumn("off_ns", F.col("end_ns") - F.col("start_ns"))


def _levelled(events: DataFrame, start: str, end: str, key: list[str], bin_ns: int | None) -> DataFrame:
    """Starts and ends with the level of nesting that they open or close, and the next row of their level."""
    rows = events.where(F.col("kind").isin(start, end)).select(*key, "ts_ns", "event_id", "value", (F.col("kind") == start).alias("starts"))
    rows = rows.withColumn("step", F.when(F.col("starts"), 1).otherwise(-1))
    bin_ns = bin_width(rows, key, "ts_ns") if bin_ns is None else bin_ns
    level = F.col("balance") + F.when(F.col("starts"), 0).otherwise(1)
    rows = summed(rows, key, ["ts_ns", "event_id"], "step", "balance", bin_ns).withColumn("level", level)
    rows = rows.withColumn("this", F.struct("starts", "ts_ns", "value"))
    return led(lagged(rows, [*key, "level"], ["ts_ns", "event_id"], "starts", "before", bin_ns), [*key, "level"], ["ts_ns", "event_id"], "this", "after", bin_ns)


def pair_io(events: DataFrame, start: str, end: str, key: list[str], bin_ns: int | None = None) -> DataFrame:
    """Spans from each start to the end that closes it, as brackets of a request key do, by time and id.

    A start raises the key's balance and an end lowers it; a start and the next
    row of the level it opens are a pair if that row is an end.  A lost end
    leaves its start open below all later pairs, a lost start makes the end go
    below what was open, and the pairs after it are one level lower: each spoils
    its own pair alone.  ``unpaired_io`` counts what is left over.
    """
    rows = _levelled(events, start, end, key, bin_ns)
    pairs = rows.where(F.col("starts") & ~F.col("after.starts"))
    return pairs.select(*key, F.col("event_id").alias("span_id"), F.col("ts_ns").alias("start_ns"), F.col("after.ts_ns").alias("end_ns"), F.col("after.value").alias("size"))


def unpaired_io(events: DataFrame, start: str, end: str, key: list[str], bin_ns: int | None = None) -> DataFrame:
    """For each request key its pairs, and the starts and ends that have no other."""
    rows = _levelled(events, start, end, key, bin_ns)
    paired = F.col("starts") & F.coalesce(~F.col("after.starts"), F.lit(False))
    closes = ~F.col("starts") & F.coalesce(F.col("before"), F.lit(False))
    some = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return rows.groupBy(*key).agg(some(paired).alias("n_pairs"), some(F.col("starts") & ~paired).alias("n_starts"), some(~F.col("starts") & ~closes).alias("n_ends"))


def io_summary(io_spans: DataFrame, by: list[str], approx: bool = False) -> DataFrame:
    """Number, volume (sum of sizes) and latency distribution of I/O spans, in one grouping."""
    latency = io_spans.withColumn("latency_ns", F.col("end_ns") - F.col("start_ns"))
    return summarize(latency, by, "latency_ns", approx, more=[F.sum("size").alias("volume")])


def samples_in_spans(samples: DataFrame, spans: DataFrame, shift: int | None = None) -> DataFrame:
    """Each sample with each span of its thread that is open at its time (bins of 2**shift ns, by default about the median span)."""
    ranges = spans.select("trace_id", "pid", "tid", "span_id", "start_ns", "end_ns").where("end_ns > start_ns")
    lo, hi = F.col("start_ns"), F.col("end_ns") - 1
    return point_in_range(samples, ranges, keys=["trace_id", "pid", "tid"], point=F.col("ts_ns"), lo=lo, hi=hi, shift=usual_bits(ranges, lo, hi) if shift is None else shift, how="inner")


def innermost_span(samples: DataFrame, spans: DataFrame, shift: int | None = None) -> DataFrame:
    """Each sample with ``span_id`` of the innermost span of its thread that is open at its time, null if none is.

    Innermost is the span that began last, of these the one that ends first,
    then the greatest id; so spans may cross.  Samples meet the spans of their
    bin (of 2**shift ns, by default about the median span), and the innermost one
    is taken where they meet: samples and spans are shuffled once, pairs are not.
    """
    thread = ["trace_id", "pid", "tid"]
    ranges, lo, hi = spans.select(*thread, "span_id", F.col("start_ns").alias("since"), (F.col("end_ns") - 1).alias("until")), F.col("since"), F.col("until")
    shift = usual_bits(ranges, lo, hi) if shift is None else shift
    found = greatest_in_range(samples, ranges, keys=thread, point=F.col("ts_ns"), lo=lo, hi=hi, shift=shift, best=lambda span: F.struct(span("lo").alias("a"), (-span("hi")).alias("b"), span("span_id").alias("c")))
    return found.select(*samples.columns, F.col("best.c").alias("span_id"))


def span_samples(samples: DataFrame, spans: DataFrame, by: list[str]) -> DataFrame:
    """Weight of the samples of each span, its own and that of what it encloses left out: each sample counts for its innermost span."""
    return innermost_span(samples, spans).where("span_id is not null").groupBy(*by, "span_id").agg(F.sum("weight").alias("weight"))
