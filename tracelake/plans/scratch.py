"""Tables written on the way, in a folder that driver and executors share."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset, a local master has the machine's own folder and any other the warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        shared = f"file://{tempfile.gettempdir()}/tracelake"
    return f"{(shared or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/{label}-{uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written there and read again: its rows, and the numbers given to them, stay as they are whatever is recomputed."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
