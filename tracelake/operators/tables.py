"""Sorted pages, grids with subtotals and distributions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lanes import summed


def _order(order: list[tuple[str, str]]):
    return [F.col(c).asc() if way == "asc" else F.col(c).desc() for c, way in order]


def top_k(df: DataFrame, order: list[tuple[str, str]], k: int) -> DataFrame:
    """The first ``k`` rows by (column, "asc" or "desc"); end with a unique column."""
    return df.orderBy(*_order(order)).limit(k)


def page(df: DataFrame, order: list[tuple[str, str]], after: tuple | None, n: int) -> DataFrame:
    """The ``n`` rows that follow the row with the order's values ``after`` (the first ones for None).

    A keyset page: it filters by the last row seen, so page number 1000 costs
    what the first one does.  Order columns hold no nulls.
    """
    if after is not None:
        cases = []
        for k, (c, way) in enumerate(order):
            same = [F.col(x) == v for (x, _), v in zip(order[:k], after)]
            beyond = F.col(c) > after[k] if way == "asc" else F.col(c) < after[k]
            cases.append(reduce(lambda a, b: a & b, [*same, beyond]))
        df = df.where(reduce(lambda a, b: a | b, cases))
    return top_k(df, order, n)


def grid(df: DataFrame, levels: list[str], measures: dict[str, str]) -> DataFrame:
    """Groups and subtotals along the levels; ``level`` is how many of them a row has (0: the total).

    ``measures`` maps names to aggregate SQL.
    """
    shown = F.lit(len(levels)) - F.bit_count(F.grouping_id())
    return df.rollup(*levels).agg(shown.cast("int").alias("level"), *(F.expr(e).alias(n) for n, e in measures.items()))


def summarize(df: DataFrame, by: list[str], measure: str, approx: bool = False, more: Sequence[Column] = ()) -> DataFrame:
    """count, sum, min, max, p50, p95, p99 and distinct values of a measure in each group.

    Exact percentiles hold the distinct values of a group in memory
    (``summarize_ranked`` does not); ``approx`` uses sketches of bounded size
    (0.01 % in rank, 5 % in distinct values).
    ``more`` aggregates go into the same grouping.
    """
    if approx:
        p = F.percentile_approx(measure, [0.5, 0.95, 0.99], 10_000)
        distinct = F.approx_count_distinct(measure)
    else:
        p = F.percentile(measure, [0.5, 0.95, 0.99])
        distinct = F.count_distinct(measure)
    out = df.groupBy(*by).agg(F.count(measure).alias("n"), F.sum(measure).alias("total"), F.min(measure).alias("least"), F.max(measure).alias("most"), p.alias("p"), distinct.alias("n_distinct"), *more)
    named = out.columns[len(by) + 5 :]
    return out.select(*by, "n", "total", "least", "most", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), F.col("p")[2].alias("p99"), *named)


def summarize_ranked(df: DataFrame, by: list[str], measure: str, width: int | None = None) -> DataFrame:
    """``summarize`` of an integer measure, exact, with no group's values in one task.

    Values are counted by group first, which copies them no further than the map
    side.  Counts are summed up in the order of the values over bins of ``width``
    (by default of about as many values each), and a percentile is what lies at
    its rank, between two values in proportion.  Groups without a value are absent.
    """
    counts = df.where(F.col(measure).isNotNull()).groupBy(*by, F.col(measure).cast("bigint").alias("__value")).agg(F.count("*").alias("__n"))
    upto = summed(counts, by, ["__value"], "__n", "__upto", width)
    sizes = counts.groupBy(*[F.col(c).alias(f"__of_{c}") for c in by]).agg(F.sum("__n").alias("n"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in by], F.lit(True))
    placed = upto.join(sizes, same).withColumn("__before", F.col("__upto") - F.col("__n"))

    def at(rank: Column) -> Column:
        """The value at a rank (from 0), which lies in one row of the group."""
        return F.max(F.when((F.col("__before") <= rank) & (rank < F.col("__upto")), F.col("__value")))

    parts = []
    for p in (0.5, 0.95, 0.99):
        place = (F.col("n") - 1) * F.lit(p)
        parts += [at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))]
    told = placed.groupBy(*by).agg(
        F.max("n").alias("n"), F.sum(F.col("__value") * F.col("__n")).alias("total"), F.min("__value").alias("least"), F.max("__value").alias("most"), F.count("*").alias("n_distinct"), *[x.alias(f"__p{k}") for k, x in enumerate(parts)]
    )
    percentile = lambda k: F.col(f"__p{k}") + (F.col(f"__p{k + 1}") - F.col(f"__p{k}")) * F.col(f"__p{k + 2}")
    return told.select(*by, "n", "total", "least", "most", *[percentile(3 * k).alias(name) for k, name in enumerate(("p50", "p95", "p99"))], "n_distinct")
