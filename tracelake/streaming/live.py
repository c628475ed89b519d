"""Ingest of decoded files as they land, and a live timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema
from ..functions.times import to_timestamp
from ..sources.normalize import normalize
from ..sources.storage import register


def ingest_stream(spark: SparkSession, in_dir: str, source: str, out: str, *, fmt: str = "json", time_bin_ns: int = 60_000_000_000, checkpoint: str | None = None, dedupe: list[str] | None = None, delay: str = "1 hour", **options) -> StreamingQuery:
    """Normalize what has landed since the last run into the events of the store ``out``, each file exactly once; ends when all is done.

    ``dedupe`` names the columns that make an event the same one in overlapping
    landings: the first to come is kept.  They are remembered, over runs too,
    until the event time has passed theirs by ``delay``, so a copy may land as
    much later; an event older than that when it lands is dropped as late.

    ``read_trace`` reads the store.  A table that is ingested is not to be
    written by ``write_trace`` too: its readers follow the stream's own log.
    """
    raw = spark.readStream.schema(schema.RAW[source]).format(fmt).load(in_dir)
    events = normalize(raw, source, **options).withColumn("time_bin", F.expr(f"(ts_ns - pmod(ts_ns, {time_bin_ns})) div {time_bin_ns}"))
    if dedupe:
        timed = events.withColumn("__time", to_timestamp("ts_ns")).withWatermark("__time", delay)
        events = timed.dropDuplicatesWithinWatermark(dedupe).drop("__time")
    register(spark, out, ["events"], time_bin_ns)
    writer = events.writeStream.format("parquet").option("path", f"{out}/events").option("checkpointLocation", checkpoint or f"{out}/_checkpoint")
    return writer.partitionBy("trace_id", "time_bin").trigger(availableNow=True).start()


def live_timeline(stream: DataFrame, width: str, delay: str, by: list[str]) -> DataFrame:
    """Events of each tumbling window and series; rows later than the watermark ``delay`` are dropped.

    In append mode a window comes once it is closed, so the last ones stay in state.
    """
    timed = stream.withColumn("time", to_timestamp("ts_ns")).withWatermark("time", delay)
    counts = timed.groupBy(F.window("time", width), *by).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")
