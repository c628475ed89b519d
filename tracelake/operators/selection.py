"""The one selection that all panes share, as predicates on each table."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_STACKS = {"frames", "stack"}


@dataclass(frozen=True)
class Selection:
    """Time range, processes, threads and a stack frame; what is not set does not restrict.

    Each method returns a new selection.  Dimensions that are set all hold.
    """

    t0: int | None = None
    t1: int | None = None
    pids: tuple[int, ...] | None = None
    tids: tuple[int, ...] | None = None
    fn: str | int | None = None

    def time(self, t0: int, t1: int) -> Selection:
        """Instants with ``t0 <= ts < t1``; spans that overlap the range."""
        return replace(self, t0=t0, t1=t1)

    def process(self, *pids: int) -> Selection:
        return replace(self, pids=pids)

    def thread(self, *tids: int) -> Selection:
        return replace(self, tids=tids)

    @property
    def _stack(self) -> str:
        """The column of a frame: functions have names, addresses are numbers."""
        return "stack" if isinstance(self.fn, str) else "frames"

    def frame(self, fn_or_addr: str | int) -> Selection:
        """Samples whose stack holds the function (symbolized stacks) or the address."""
        return replace(self, fn=fn_or_addr)

    def predicate(self, df: DataFrame) -> Column:
        """What of the selection the table's columns can express."""
        has, parts = set(df.columns), [F.lit(True)]
        if self.t0 is not None and "ts_ns" in has:
            parts.append((F.col("ts_ns") >= self.t0) & (F.col("ts_ns") < self.t1))
        elif self.t0 is not None and "start_ns" in has:
            parts.append((F.col("start_ns") < self.t1) & (F.col("end_ns") > self.t0))
        if self.pids is not None and "pid" in has:
            parts.append(F.col("pid").isin(*self.pids))
        if self.tids is not None and "tid" in has:
            parts.append(F.col("tid").isin(*self.tids))
        if self.fn is not None and has & _STACKS:
            if self._stack not in has:
                raise ValueError(f"a {'function' if self._stack == 'stack' else 'frame address'} is selected in the column {self._stack}, which the samples lack" + "; symbolize them first" * (self._stack == "stack"))
            parts.append(F.array_contains(self._stack, self.fn))
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out

    def apply(self, tables: dict[str, DataFrame], carry: str | None = None) -> dict[str, DataFrame]:
        """Every table under the selection.

        ``carry="thread"`` takes a frame selection to the tables without stacks:
        they keep the threads that have a selected sample.
        """
        out = {name: df.where(self.predicate(df)) for name, df in tables.items()}
        if carry == "thread" and self.fn is not None:
            keys = ["trace_id", "pid", "tid"]
            holders = [df for name, df in out.items() if _STACKS & set(df.columns) and set(keys) <= set(df.columns)]
            for name, df in out.items():
                if holders and set(keys) <= set(df.columns) and not _STACKS & set(df.columns):
                    threads = holders[0].select(*keys)
                    for other in holders[1:]:
                        threads = threads.union(other.select(*keys))
                    out[name] = df.join(threads.distinct(), keys, "left_semi")
        return out


def compare(df: DataFrame, a: Selection, b: Selection, by: list[str]) -> DataFrame:
    """Rows of each group under both selections and their difference, in one pass; groups under neither are absent."""
    in_a, in_b = (F.sum(F.when(s.predicate(df), 1).otherwise(0)) for s in (a, b))
    rows = df.where(a.predicate(df) | b.predicate(df))
    return rows.groupBy(*by).agg(in_a.alias("n_a"), in_b.alias("n_b"), (in_b - in_a).alias("diff"))
