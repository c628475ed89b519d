"""Traces of several machines on one clock.

Two machines' clocks are apart by an offset that drifts.  Messages between them
tell it: what one sends and the other receives takes some time on the way, so
(received - sent) is the offset plus a delay in one direction and the delay less
the offset in the other.  Within a bin of time the fastest message of each
direction has hardly waited, and half the difference of the two is the offset
there.  A line through the bins gives offset and drift.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts of a second's drift: a clock that gains 1 ns a second drifts by 1.
_BILLION = 1_000_000_000


def match_messages(events: DataFrame, sent: str, received: str, key: list[str]) -> DataFrame:
    """key, sender, receiver, sent_ns and received_ns of each message, by the trace of its two events.

    A message has one event of each kind; one whose other event is lost, or that
    has several, tells nothing and is left out.
    """
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    some = lambda kind: F.sum(F.when(F.col("kind") == kind, 1).otherwise(0))
    pairs = events.where(F.col("kind").isin(sent, received)).groupBy(*key).agg(
        of(sent, "trace_id").alias("sender"), of(received, "trace_id").alias("receiver"), of(sent, "ts_ns").alias("sent_ns"), of(received, "ts_ns").alias("received_ns"), some(sent).alias("__sent"), some(received).alias("__received")
    )
    return pairs.where("__sent = 1 and __received = 1").drop("__sent", "__received")


def clock_offsets(messages: DataFrame, reference: str, bin_ns: int) -> DataFrame:
    """trace_id, bin, at_ns and offset_ns: how far a machine's clock is ahead of the reference's in each bin with messages both ways.

    Times of a bin are those of the reference's clock.
    """
    out = messages.where((F.col("sender") == reference) & (F.col("receiver") != reference)).select(F.col("receiver").alias("trace_id"), F.col("sent_ns").alias("at"), (F.col("received_ns") - F.col("sent_ns")).alias("there"), F.lit(None).cast("bigint").alias("back"))
    back = messages.where((F.col("receiver") == reference) & (F.col("sender") != reference)).select(F.col("sender").alias("trace_id"), F.col("received_ns").alias("at"), F.lit(None).cast("bigint").alias("there"), (F.col("received_ns") - F.col("sent_ns")).alias("back"))
    binned = out.unionByName(back).withColumn("bin", F.expr(f"(at - pmod(at, {bin_ns}L)) div {bin_ns}L"))
    # the fastest ones of both directions stand for the same offset: half way between their times
    fastest = binned.groupBy("trace_id", "bin").agg(F.min("there").alias("there"), F.min("back").alias("back"), F.min_by("at", "there").alias("at_there"), F.min_by("at", "back").alias("at_back"))
    fastest = fastest.where("there is not null and back is not null")
    return fastest.select("trace_id", "bin", F.expr("at_there + (at_back - at_there) div 2").alias("at_ns"), F.expr("(there - back) div 2").alias("offset_ns"))


def fit_clocks(offsets: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """trace_id, origin_ns, offset_ns (at the origin) and drift_ppb of each machine: a line through its bins that outliers do not bend.

    Bins whose distance from the line is more than ``tolerance`` times the
    median distance are left out and the line is fitted again, twice.  A machine
    with one bin has no drift.
    """
    origin = offsets.groupBy("trace_id").agg(F.min("at_ns").alias("origin_ns"), F.percentile("offset_ns", 0.5).cast("bigint").alias("middle"))
    rows = offsets.join(origin, "trace_id").select("trace_id", "origin_ns", "middle", (F.col("at_ns") - F.col("origin_ns")).cast("double").alias("x"), (F.col("offset_ns") - F.col("middle")).cast("double").alias("y"))

    def line(df: DataFrame) -> DataFrame:
        slope = F.coalesce(F.expr("regr_slope(y, x)"), F.lit(0.0))
        fitted = df.groupBy("trace_id").agg(slope.alias("slope"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
        return fitted.select("trace_id", "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("base"))

    def near(df: DataFrame, fitted: DataFrame) -> DataFrame:
        apart = df.join(fitted, "trace_id").withColumn("apart", F.abs(F.col("y") - F.col("base") - F.col("slope") * F.col("x"))).drop("slope", "base")
        usual = apart.groupBy("trace_id").agg(F.percentile("apart", 0.5).alias("usual"))
        return apart.join(usual, "trace_id").where(F.col("apart") <= tolerance * F.col("usual") + 1).drop("apart", "usual")

    kept = rows
    for _ in range(2):
        kept = near(kept, line(kept))
    told = kept.groupBy("trace_id").agg(F.first("origin_ns").alias("origin_ns"), F.first("middle").alias("middle"))
    last = line(kept).join(told, "trace_id")
    return last.select("trace_id", "origin_ns", (F.col("middle") + F.round("base")).cast("bigint").alias("offset_ns"), F.round(F.col("slope") * _BILLION).cast("bigint").alias("drift_ppb"))


def align(df: DataFrame, clocks: DataFrame, times: list[str]) -> DataFrame:
    """``df`` with its times on the reference's clock; traces without a clock are on it already.

    A time t becomes t - offset - (t - offset - origin) * drift, in whole
    nanoseconds: whole seconds are multiplied first, so nothing passes 64 bits.
    """
    told = clocks.select(F.col("trace_id").alias("__trace"), F.col("origin_ns").alias("__origin"), F.col("offset_ns").alias("__offset"), F.col("drift_ppb").alias("__drift"))
    joined = df.join(told, F.col("trace_id") == F.col("__trace"), "left")
    for c in times:
        d = f"({c} - __offset - __origin)"
        moved = f"{c} - __offset - (({d} div {_BILLION}) * __drift + (({d} % {_BILLION}) * __drift) div {_BILLION})"
        joined = joined.withColumn(c, F.coalesce(F.expr(moved), F.col(c)))
    return joined.select(*df.columns)
