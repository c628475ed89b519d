"""Shared folder, written tables and bounded hand-over of small tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent, a temporary folder serves a local master and
    the warehouse any other, as a machine's own folder is not shared.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(known)
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        known = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    else:
        known = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    spark.conf.set("spark.checkpoint.dir", known)
    return known


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Cuts the lineage with files that outlive a lost executor.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Tables:
    """Tables written for one run of an operator, which removes them when it no longer reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, label: str, by: str | None = None) -> DataFrame:
        """``df`` written and read again, in a folder for each value of ``by`` if it is given."""
        self.paths.append(fresh_path(self.spark, label))
        df.write.parquet(self.paths[-1], partitionBy=by)
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def remove(self) -> None:
        for path in self.paths:
            remove_path(self.spark, path)
        self.paths = []


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours through Hadoop's file system, wherever it is."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def small(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are within ``limit``."""
    return F.broadcast(df) if rows <= limit else df


def set_aside(df: DataFrame, *helpers: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns that bear a helper's name renamed, and what to rename them back by (``withColumnsRenamed``)."""
    back = {}
    for name in (c for c in df.columns if c in helpers):
        other = name
        while other in df.columns or other in helpers or other in back:
            other += "_"
        back[other] = name
    return df.withColumnsRenamed({old: new for new, old in back.items()}), back


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 500 rows: the default of 10,000 whole texts takes too much of an executor's and a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
