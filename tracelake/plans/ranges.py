"""Joins of points or intervals with ranges, and running sums over long orders."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lanes import ROWS, bin_width, led


#: A range that touches more bins than this goes to bins ``COARSER`` bits wider, and so on.  As 2**COARSER is MOST_BINS,
#: a range is then nearly as long as its bins at least, so few that do not overlap share one.
MOST_BINS, COARSER = 16, 4
#: Rows of ranges in bins that are broadcast; more are shuffled, whatever Spark takes their size for.
BROADCAST_ROWS = 200_000


def _shifts(shift: int) -> list[int]:
    """Widths of bins, as powers of two, of which the last one holds any range in ``MOST_BINS`` bins."""
    out = [shift]
    while 64 - out[-1] > COARSER:
        out.append(min(63, out[-1] + COARSER))
    return out


def usual_bits(ranges: DataFrame, lo: Column, hi: Column) -> int:
    """Bits of the width of a bin that holds the median range, by one small count."""
    median = ranges.agg(F.percentile_approx(F.greatest(hi - lo, F.lit(0)), 0.5)).first()[0]
    return min(62, (median or 0).bit_length())


def _in_bins(ranges: DataFrame, keys: list[str], lo: Column, hi: Column, shift: int) -> tuple[DataFrame, list[int]]:
    """Ranges with a row for each bin, and the widths that occur, in bits; ``__bits`` is that of a row.

    Columns are ``__of_`` a key, ``__lo``, ``__hi`` and ``__with_`` any other.  One
    small count tells the widths and whether the rows are few enough to broadcast.
    """
    numbered = ranges.select(*[F.col(k).alias(f"__of_{k}") for k in keys], lo.alias("__lo"), hi.alias("__hi"), *[F.col(c).alias(f"__with_{c}") for c in ranges.columns if c not in keys]).where("__lo <= __hi")
    shifts = _shifts(shift)
    bits = F.lit(shifts[-1])
    for n in reversed(shifts[:-1]):
        bits = F.when(F.shiftright("__hi", n) - F.shiftright("__lo", n) < MOST_BINS, n).otherwise(bits)
    numbered = numbered.withColumn("__bits", bits)
    first, last = F.expr("shiftright(__lo, __bits)"), F.expr("shiftright(__hi, __bits)")
    found = {r["__bits"]: r["n"] for r in numbered.groupBy("__bits").agg(F.sum(last - first + 1).alias("n")).collect()}
    side = numbered.withColumn("__bin", F.explode(F.sequence(first, last)))
    return F.broadcast(side) if sum(found.values()) <= BROADCAST_ROWS else side.hint("merge"), sorted(found)


def _meets(keys: list[str], also: Callable[[Callable[[str], Column]], Column] | None) -> Column:
    condition = (F.col("__point") >= F.col("__lo")) & (F.col("__point") <= F.col("__hi"))
    for k in keys:
        condition = condition & (F.col(k) == F.col(f"__of_{k}"))
    return condition if also is None else condition & also(lambda c: F.col(f"__with_{c}"))


def point_in_range(points: DataFrame, ranges: DataFrame, *, keys: list[str], point: Column, lo: Column, hi: Column, shift: int, how: str = "left", also: Callable[[Callable[[str], Column]], Column] | None = None) -> DataFrame:
    """Join each point with the ranges ``lo <= point <= hi`` of its keys.

    A bare range condition makes Spark compare every point with every range.
    Here both sides get the number of the ``2**shift`` wide bin that they are
    in, a range one row for each bin that it touches, and the bin is a join key.
    Choose ``2**shift`` near the usual length of a range; one over more than
    ``MOST_BINS`` bins has coarser ones, so neither its rows nor the pairs to
    compare multiply.  Points look into the widths that occur.

    "left" keeps points without a range and takes ranges of a key not to
    overlap; "inner" gives every pair.  ``also`` is a further condition of a
    pair, given the range's columns by name; with it ranges may overlap where
    it holds for one of them at most.
    """
    extra = [c for c in ranges.columns if c not in keys]
    side, widths = _in_bins(ranges, keys, lo, hi, shift)
    condition = _meets(keys, also)
    left = points.withColumn("__point", point)
    if how == "inner":  # a point has a row for each width, so that one join serves them all
        numbers = F.array(*[F.struct(F.lit(n).alias("width"), F.shiftright("__point", n).alias("at")) for n in widths or [shift]])
        left = left.select("*", F.explode(numbers).alias("__near")).select(*points.columns, "__point", F.col("__near.width").alias("__width"), F.col("__near.at").alias("__at"))
        joined = left.join(side, condition & (F.col("__width") == F.col("__bits")) & (F.col("__at") == F.col("__bin")))
        return joined.select(*points.columns, *[F.col(f"__with_{c}").alias(c) for c in extra])
    for k, n in enumerate(widths or [shift]):
        joined = left.join(side.where(F.col("__bits") == n), condition & (F.shiftright("__point", n) == F.col("__bin")), "left")
        here = F.when(F.col("__lo").isNotNull(), F.struct(*[F.col(f"__with_{c}").alias(c) for c in extra]))
        left = joined.select(*points.columns, "__point", (F.coalesce("__found", here) if k else here).alias("__found"))
    return left.select(*points.columns, *[F.col(f"__found.{c}").alias(c) for c in extra])


def greatest_in_range(points: DataFrame, ranges: DataFrame, *, keys: list[str], point: Column, lo: Column, hi: Column, shift: int, best: Callable[[Callable[[str], Column]], Column]) -> DataFrame:
    """Each point with ``best``, the greatest value of ``best`` among the ranges ``lo <= point <= hi`` of its keys, null if there is none.

    Ranges may overlap.  ``best`` is given the range's columns by name, ``lo`` and
    ``hi`` among them.  A point's pairs are put together where the join by bins
    has made them, so they are not shuffled.
    """
    side, widths = _in_bins(ranges, keys, lo, hi, shift)
    of = lambda c: F.col(f"__{c}" if c in ("lo", "hi") else f"__with_{c}")
    others = [c for c in points.columns if c not in keys]
    left = points.withColumn("__point", point)
    for k, n in enumerate(widths or [shift]):
        dealt = left.withColumn("__at", F.shiftright("__point", n)).withColumn("__row", F.monotonically_increasing_id())
        joined = dealt.join(side.where(F.col("__bits") == n), _meets(keys, None) & (F.col("__at") == F.col("__bin")), "left")
        here = F.max(F.when(F.col("__lo").isNotNull(), best(of)))
        rest = [*others, "__point"] + ["best"] * (k > 0)
        grouped = joined.groupBy(*keys, "__at", "__row").agg(*[F.first(c).alias(c) for c in rest], here.alias("__here"))
        left = grouped.select(*points.columns, "__point", (F.greatest("best", "__here") if k else F.col("__here")).alias("best"))
    return left.select(*points.columns, "best")


def cut(ranges: DataFrame, *, keys: list[str], lo: str, hi: str, long_keys: bool = True) -> DataFrame:
    """keys, lo and hi of the pieces between all ends of a key's ranges, which include both their ends.

    ``long_keys`` puts the ends of a key in order over many tasks; without it, as
    for the modules of a process, each key is sorted in one.
    """
    told = ranges.where(F.col(lo) <= F.col(hi)).select(*keys, F.col(lo).alias("__from"), F.col(hi).alias("__to"))
    after = F.when(F.col("__to") < F.lit((1 << 63) - 1), F.col("__to") + 1)
    ends = told.select(*keys, F.explode(F.array("__from", after)).alias("__at")).where("__at is not null").distinct()
    if long_keys:
        pieces = led(ends, keys, ["__at"], "__at", "__next", bin_width(told, keys, "__from", ROWS // 2))
    else:
        pieces = ends.withColumn("__next", F.lead("__at").over(Window.partitionBy(*keys).orderBy("__at")))
    return pieces.select(*keys, F.col("__at").alias(lo), F.coalesce(F.col("__next") - 1, F.lit((1 << 63) - 1)).alias(hi))


def covering(ranges: DataFrame, *, keys: list[str], lo: str, hi: str, shift: int, carry: list[str], long_keys: bool = True) -> DataFrame:
    """Each piece of ``cut`` with what ``carry`` names of each range that covers it."""
    told = ranges.where(F.col(lo) <= F.col(hi)).select(*keys, F.col(lo).alias("__from"), F.col(hi).alias("__to"), *carry)
    covered = point_in_range(cut(ranges, keys=keys, lo=lo, hi=hi, long_keys=long_keys), told, keys=keys, point=F.col(lo), lo=F.col("__from"), hi=F.col("__to"), shift=shift, how="inner")
    return covered.select(*keys, lo, hi, *carry)


def disjoint(ranges: DataFrame, *, keys: list[str], lo: str, hi: str, shift: int, best: Column, long_keys: bool = True) -> DataFrame:
    """keys, lo, hi and ``best`` of ranges cut at each other's ends, where the greatest ``best`` of those that cover a piece holds it.

    Ends belong to the ranges (``lo <= x <= hi``); pieces that none covers are
    absent, and a range with ``hi`` below ``lo`` covers nothing.
    """
    pieces = covering(ranges.withColumn("best", best), keys=keys, lo=lo, hi=hi, shift=shift, carry=["best"], long_keys=long_keys)
    return pieces.groupBy(*keys, lo, hi).agg(F.max("best").alias("best"))


def running_sum(df: DataFrame, keys: list[str], order: str, value: str, width: int, name: str) -> DataFrame:
    """Sum of ``value`` over all rows of the keys up to this one in ``order``, which is unique within them.

    A plain window would sort all rows of a key in one task.  Rows are summed by
    buckets of ``width`` in ``order`` first, the buckets get their running sum,
    and each bucket is then sorted on its own.  A null key is a key like any other.
    """
    bucket = F.expr(f"{order} div {width}").alias("__bucket")
    dealt = df.withColumn("__bucket", bucket)
    sums = dealt.groupBy(*keys, "__bucket").agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "__bucket", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy(*keys, "__bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumnsRenamed({c: f"__of_{c}" for c in (*keys, "__bucket")})
    joined = dealt.join(sums, reduce(and_, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in (*keys, "__bucket")]))
    return joined.withColumn(name, F.col("__base") + F.sum(value).over(within)).select(*df.columns, name)
