"""Timelines: pixels, busy time, merged spans, gaps, concurrency and the zoom pyramid."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lanes import bin_width, islands, led
from ..plans.ranges import running_sum


def pixel_width(t0: int, t1: int, w: int) -> int:
    """Nanoseconds of one of ``w`` pixels over ``[t0, t1)``, rounded up so that the last pixel is below ``w``."""
    return (t1 - t0 + w - 1) // w


def _inside(df: DataFrame, t0: int, t1: int, w: int) -> DataFrame:
    return df.where((F.col("ts_ns") >= t0) & (F.col("ts_ns") < t1)).withColumn("px", F.expr(f"(ts_ns - {t0}) div {pixel_width(t0, t1, w)}"))


def timeline_counts(df: DataFrame, t0: int, t1: int, w: int, by: list[str]) -> DataFrame:
    """Events of each series in each pixel; empty pixels are absent."""
    return _inside(df, t0, t1, w).groupBy(*by, "px").agg(F.count("*").alias("n"))


def timeline_m4(df: DataFrame, value: str, t0: int, t1: int, w: int, by: list[str] | None = None, id_col: str = "event_id") -> DataFrame:
    """First, last, least and most value of each pixel (M4: Jugel et al., PVLDB 7(10), 2014); equal times go by the id."""
    at = F.struct("ts_ns", id_col)
    return _inside(df, t0, t1, w).groupBy(*(by or []), "px").agg(F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"), F.min(value).alias("low"), F.max(value).alias("high"))


def timeline_busy(spans: DataFrame, t0: int, t1: int, w: int, by: list[str]) -> DataFrame:
    """Nanoseconds that spans cover in each pixel; spans are clipped to the range, then to each pixel they touch.

    A span that fills many pixels is split into its two edges and a run of full
    pixels, and runs are added as a difference at their ends, so a span makes
    four rows at most however wide it is.
    """
    bw = pixel_width(t0, t1, w)
    clipped = spans.where((F.col("start_ns") < t1) & (F.col("end_ns") > t0) & (F.col("end_ns") > F.col("start_ns")))
    clipped = clipped.select(*by, (F.greatest("start_ns", F.lit(t0)) - t0).alias("s"), (F.least("end_ns", F.lit(t1)) - t0).alias("e"))
    clipped = clipped.withColumn("a", F.expr(f"s div {bw}")).withColumn("b", F.expr(f"(e - 1) div {bw}"))
    row = "named_struct('px', {}, 'edge', {}, 'full', {})"
    single, first, last = row.format("a", "e - s", "0L"), row.format("a", f"(a + 1) * {bw} - s", "0L"), row.format("b", f"e - b * {bw}", "0L")
    run = [row.format("a + 1", "0L", "1L"), row.format("b", "0L", "-1L")]
    parts = clipped.select(*by, F.explode(F.expr(f"if(a = b, array({single}), array({first}, {last}, {run[0]}, {run[1]}))")).alias("x")).select(*by, "x.*")
    sums = parts.groupBy(*by, "px").agg(F.sum("edge").alias("edge"), F.sum("full").alias("full"))
    # runs end where their last pixel is, so pixels between two rows of a series are filled from the row before
    order = Window.partitionBy(*by).orderBy("px") if by else Window.partitionBy(F.lit(0)).orderBy("px")  # w rows at most in a series
    open_ = F.sum("full").over(order.rowsBetween(Window.unboundedPreceding, 0))
    filled = sums.select(*by, "px", "edge", open_.alias("open"), F.lead("px", 1, w).over(order).alias("next"))
    every = filled.select(*by, "edge", "open", F.col("px").alias("own"), F.explode(F.when(F.col("open") > 0, F.sequence("px", F.col("next") - 1)).otherwise(F.array("px"))).alias("px"))
    busy = F.when(F.col("px") == F.col("own"), F.col("edge")).otherwise(0) + F.col("open") * bw
    return every.select(*by, "px", busy.alias("busy_ns")).where("busy_ns > 0")


def merge_spans(spans: DataFrame, keys: list[str], gap_ns: int = 0, bin_ns: int | None = None) -> DataFrame:
    """Spans of a lane joined where they overlap or are less than ``gap_ns`` apart (0: overlap or touch).

    Adds the number of spans merged.  A lane is dealt to bins of ``bin_ns``, by
    default of about as many rows each, so it takes as many tasks as it needs.
    """
    apart = F.col("start_ns") - F.col("__reach")
    return islands(spans, keys, "start_ns", "end_ns", apart <= 0 if gap_ns == 0 else apart < gap_ns, bin_ns)


def span_gaps(spans: DataFrame, keys: list[str], bin_ns: int | None = None) -> DataFrame:
    """Idle time between the merged spans of a lane."""
    bin_ns = bin_width(spans, keys, "start_ns") if bin_ns is None else bin_ns
    merged = led(merge_spans(spans, keys, 0, bin_ns), keys, ["start_ns"], "start_ns", "after", bin_ns)
    gaps = merged.select(*keys, F.col("end_ns").alias("start_ns"), F.col("after").alias("end_ns")).where("end_ns is not null")
    return gaps.withColumn("gap_ns", F.col("end_ns") - F.col("start_ns"))


def concurrency(spans: DataFrame, by: list[str], bucket_ns: int = 60_000_000_000) -> DataFrame:
    """How many spans are open from each change on; changes of one time are added first."""
    edges = spans.select(*by, F.explode(F.array(F.struct(F.col("start_ns").alias("ts_ns"), F.lit(1).alias("d")), F.struct(F.col("end_ns").alias("ts_ns"), F.lit(-1).alias("d")))).alias("x"))
    changes = edges.groupBy(*by, F.col("x.ts_ns").alias("ts_ns")).agg(F.sum("x.d").alias("d")).where("d <> 0")
    return running_sum(changes, by, "ts_ns", "d", bucket_ns, "n_open").select(*by, "ts_ns", "n_open")


def build_pyramid(df: DataFrame, base_ns: int, levels: int, by: list[str]) -> DataFrame:
    """Counts by buckets of ``base_ns * 2**level``, each level from the one below it; buckets of negative times are rounded down too.

    Write it partitioned by ``level``; a zoom reads the level of its width.
    """
    finest = df.groupBy(*by, F.expr(f"(ts_ns - pmod(ts_ns, {base_ns})) div {base_ns}").alias("bucket")).agg(F.count("*").alias("n"))
    out = [finest.withColumn("level", F.lit(0))]
    for level in range(1, levels):
        below = out[-1]
        out.append(below.groupBy(*by, F.shiftright("bucket", 1).alias("bucket")).agg(F.sum("n").alias("n")).withColumn("level", F.lit(level)))
    return reduce(DataFrame.unionByName, out)
