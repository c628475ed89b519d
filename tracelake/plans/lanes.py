"""Order within lanes that are too long for one task: segmented scans over time bins.

A window over a lane (a CPU, a thread) sorts all of it in one task.  Here rows
are dealt to (lane, bin of time).  Each bin gives a small summary, summaries are
scanned over the lane, and what a bin needs of its neighbours comes to it as one
more row, a carrier, that sorts before or after its own.  So a lane's rows are
shuffled once, to as many tasks as it has bins, and only summaries are ordered
over the whole lane.  Null keys are keys like any other.

``width`` is that of a bin.  None measures it by one small count; 0 is one bin
for all time, which is what the count says where no lane is long.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the busiest lane that a bin has on average, where its width is not given.
ROWS = 100_000


def bin_width(df: DataFrame, keys: Sequence[str], time: str, rows: int | None = None) -> int:
    """A width at which the bins of the busiest lane hold ``rows`` rows on average; 0 if that lane has no more rows in all.

    0 stands for no bins: each lane is short enough to be sorted in one task.
    """
    rows = rows or ROWS
    lanes = df.groupBy(*keys).agg(F.count(time).alias("n"), F.min(time).alias("least"), F.max(time).alias("most"))
    busiest = lanes.agg(F.max(F.struct("n", "least", "most"))).first()[0]
    if not busiest or busiest["n"] <= rows:
        return 0
    return min(1 << 62, max(1, -(-(busiest["most"] - busiest["least"] + 1) * rows // busiest["n"])))


def binned(df: DataFrame, time: str, width: int) -> DataFrame:
    """``df`` with ``__bin``, whose order is that of time; times below zero are rounded down too."""
    return df.withColumn("__bin", F.expr(f"{time} div {width}L - if({time} % {width}L < 0, 1, 0)"))


def _shifted(df: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, value: str, name: str, width: int | None, forward: bool) -> DataFrame:
    """``df`` with ``name``: ``value`` of the row before (``forward``) or after in the lane."""
    width = bin_width(df, keys, time) if width is None else width
    if not width:
        return df.withColumn(name, (F.lag if forward else F.lead)(value).over(Window.partitionBy(*keys).orderBy(*order)))
    dealt = binned(df, time, width)
    at = F.struct(*order)
    edge = F.max_by(F.struct(value), at) if forward else F.min_by(F.struct(value), at)
    lane = Window.partitionBy(*keys).orderBy("__bin")
    near = (F.lag if forward else F.lead)("__edge").over(lane)
    carriers = dealt.groupBy(*keys, "__bin").agg(edge.alias("__edge")).select(*keys, "__bin", near.alias("__near")).where("__near is not null")
    carriers = carriers.select(*keys, "__bin", F.col(f"__near.{value}").alias(value), F.lit(True).alias("__carrier"))
    met = dealt.withColumn("__carrier", F.lit(False)).unionByName(carriers, allowMissingColumns=True)
    side = F.desc("__carrier") if forward else F.asc("__carrier")
    bin_ = Window.partitionBy(*keys, "__bin").orderBy(side, *order)
    return met.withColumn(name, (F.lag if forward else F.lead)(value).over(bin_)).where("not __carrier").drop("__carrier", "__bin")


def lagged(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, width: int | None = None) -> DataFrame:
    """``df`` with ``name``, the ``value`` of the row before in its lane; ``order`` begins with a time and is total."""
    return _shifted(df, keys, order, order[0], value, name, width, True)


def led(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, width: int | None = None) -> DataFrame:
    """``df`` with ``name``, the ``value`` of the row after in its lane; ``order`` begins with a time and is total."""
    return _shifted(df, keys, order, order[0], value, name, width, False)


def summed(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, width: int | None = None) -> DataFrame:
    """``df`` with ``name``, the sum of ``value`` over its lane up to the row; ``order`` begins with a time and is total."""
    width = bin_width(df, keys, order[0]) if width is None else width
    if not width:
        return df.withColumn(name, F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    dealt = binned(df, order[0], width)
    before = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    carriers = dealt.groupBy(*keys, "__bin").agg(F.sum(value).alias("__sum")).select(*keys, "__bin", F.sum("__sum").over(before).alias(value)).where(F.col(value).isNotNull())
    met = dealt.withColumn("__carrier", F.lit(False)).unionByName(carriers.withColumn("__carrier", F.lit(True)), allowMissingColumns=True)
    within = Window.partitionBy(*keys, "__bin").orderBy(F.desc("__carrier"), *order).rowsBetween(Window.unboundedPreceding, 0)
    return met.withColumn(name, F.sum(value).over(within)).where("not __carrier").drop("__carrier", "__bin")


def islands(df: DataFrame, keys: Sequence[str], start: str, end: str, joins: Column, width: int | None = None) -> DataFrame:
    """keys, start, end and n of the stretches that rows of a lane form.

    Rows go by start and end.  One joins the stretch before it where ``joins``
    holds, a condition on ``start`` and ``__reach``, the greatest end before it.
    A bin is carried the reach of all bins before it.  Its first stretch may go on
    from the bin before and its last one into the next, so these two are put
    together over the lane; the others are complete.
    """
    rows, unbounded = df.select(*keys, start, end), Window.unboundedPreceding
    width = bin_width(rows, keys, start) if width is None else width
    if not width:
        lane = Window.partitionBy(*keys).orderBy(start, end)
        reached = rows.withColumn("__reach", F.max(end).over(lane.rowsBetween(unbounded, -1))).withColumn("__new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
        whole = reached.withColumn("__island", F.sum("__new").over(lane.rowsBetween(unbounded, 0))).groupBy(*keys, "__island")
        return whole.agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("__island")
    dealt = binned(rows, start, width)
    before = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    carriers = dealt.groupBy(*keys, "__bin").agg(F.max(end).alias("__reach")).select(*keys, "__bin", F.max("__reach").over(before).alias(end)).where(F.col(end).isNotNull())
    met = dealt.withColumn("__carrier", F.lit(False)).unionByName(carriers.withColumn("__carrier", F.lit(True)), allowMissingColumns=True)
    order = Window.partitionBy(*keys, "__bin").orderBy(F.desc("__carrier"), start, end)
    reached = met.withColumn("__reach", F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))).where("not __carrier")
    flagged = reached.withColumn("__new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1))
    within = Window.partitionBy(*keys, "__bin").orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)
    parts = flagged.withColumn("__part", F.sum("__new").over(within)).groupBy(*keys, "__bin", "__part").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"))
    parts = parts.withColumn("__last", F.max("__part").over(Window.partitionBy(*keys, "__bin")))
    inner = parts.where("__part > 0 and __part < __last").select(*keys, start, end, "n")
    lane = Window.partitionBy(*keys).orderBy("__bin", "__part").rowsBetween(Window.unboundedPreceding, 0)  # two rows a bin at most
    outer = parts.where("__part = 0 or __part = __last").withColumn("__island", F.sum(F.when(F.col("__part") > 0, 1).otherwise(0)).over(lane))
    outer = outer.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.sum("n").alias("n")).select(*keys, start, end, "n")
    return inner.unionByName(outer)
