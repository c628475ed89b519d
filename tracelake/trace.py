"""A trace: named tables that SQL, filters and aggregations run over."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession

from .sources import storage


class Trace:
    """Tables by name.  ``sql`` sees each one as a view of its name."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = dict(tables)
        self.spark: SparkSession = next(iter(tables.values())).sparkSession

    @classmethod
    def read(cls, spark: SparkSession, path: str, trace_id: str | None = None, t0: int | None = None, t1: int | None = None) -> Trace:
        return cls(storage.read_trace(spark, path, trace_id, t0, t1))

    def table(self, name: str) -> DataFrame:
        return self.tables[name]

    def sql(self, text: str, **params) -> DataFrame:
        """Spark SQL over the tables; ``:name`` in the text stands for the parameter ``name``."""
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)
        return self.spark.sql(text, args=params or None)

    def filter(self, table: str, cond: Column | str) -> DataFrame:
        return self.table(table).where(cond)

    def aggregate(self, table: str, by: Sequence[str | Column], aggs: Sequence[Column]) -> DataFrame:
        return self.table(table).groupBy(*by).agg(*aggs)

    def project(self, table: str, cols: Sequence[str | Column]) -> DataFrame:
        return self.table(table).select(*cols)
