"""Rollups stored beside a trace: counts by zoom level, sketches of a measure, and an index from frames to where they occur.

Each one holds what adds up, so newly ingested events are appended as rows of
their own and readers put rows of one key together.  None reads events again.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators.timeline import build_pyramid, pixel_width
from .storage import tell, told

#: Buckets of a level, or bins of sketches, that are written to one file, about.
FILE_BUCKETS = 65_536


# ------------------------------------------------------------------- the pyramid


def write_pyramid(events: DataFrame, path: str, base_ns: int, levels: int, by: list[str], append: bool = False) -> None:
    """Store the zoom pyramid of the events, a folder for each level; ``append`` adds that of newly ingested ones."""
    spark, said = events.sparkSession, {"base_ns": base_ns, "levels": levels, "by": by}
    if append and told(spark, path) != said:
        raise ValueError(f"the pyramid has {told(spark, path)}, not {said}")
    rows = build_pyramid(events, base_ns, levels, by)
    dealt = rows.repartition("level", F.expr(f"bucket div {FILE_BUCKETS}")).sortWithinPartitions("level", "bucket")
    dealt.write.mode("append" if append else "overwrite").partitionBy("level").parquet(f"{path}/levels")
    if not append:
        tell(spark, path, said)


def _level_of(said: dict, t0: int, t1: int, w: int) -> tuple[int, list[int], int]:
    """The coarsest level whose buckets fit a pixel, the levels that pixels' edges need, and the width of a pixel."""
    base, bw = said["base_ns"], pixel_width(t0, t1, w)
    if any(x % base for x in (t0, t1, bw)):
        raise ValueError(f"the range and its pixels ({bw} ns) are not multiples of the finest buckets ({base} ns)")
    level = max(n for n in range(said["levels"]) if n == 0 or base << n <= bw)
    finer = [n for n in range(level) if any(x % (base << (n + 1)) for x in (t0, t1, bw))]
    return level, [*finer, level], bw


def timeline_from_pyramid(spark: SparkSession, path: str, t0: int, t1: int, w: int) -> DataFrame:
    """``timeline_counts`` of a stored pyramid: by, px and n of the pixels that have events.

    Whole buckets of the coarsest level that fits come first; what a pixel's edge
    cuts off them comes from the next finer level, and so on.  Levels that no
    edge needs are not read: on aligned pixels one level's files are.  The range
    and the pixel must be multiples of the finest bucket.
    """
    said = told(spark, path)
    if said is None:
        raise FileNotFoundError(f"no pyramid is stored in {path}")
    level, needed, bw = _level_of(said, t0, t1, w)
    rows = spark.read.parquet(f"{path}/levels")
    within = reduce(or_, [(F.col("level") == n) & F.col("bucket").between(t0 // (said["base_ns"] << n), (t1 - 1) // (said["base_ns"] << n)) for n in needed])
    rows = rows.where(F.col("level").isin(needed) & within)

    def inside(bucket: Column, width: Column) -> Column:
        """A bucket that lies in the range and in one pixel."""
        first = bucket * width - t0
        return (first >= 0) & (first + width <= t1 - t0) & (first % bw + width <= bw)

    width = F.expr(f"shiftleft({said['base_ns']}L, level)")
    above = inside(F.shiftright("bucket", 1), width * 2)
    counted = inside(F.col("bucket"), width) & ((F.col("level") == level) | ~above)
    px = F.expr(f"(bucket * shiftleft({said['base_ns']}L, level) - {t0}) div {bw}").alias("px")
    return rows.where(counted).select(*said["by"], px, "n").groupBy(*said["by"], "px").agg(F.sum("n").alias("n"))


# ------------------------------------------------------------------ the sketches


def write_sketches(events: DataFrame, path: str, measure: str, bin_ns: int, by: list[str], k: int = 800, append: bool = False) -> None:
    """Store count, sum, extremes, a KLL sketch and a HyperLogLog sketch of an integer measure for each group and time bin.

    ``append`` adds those of newly ingested events.  A null measure is left out.
    """
    spark, said = events.sparkSession, {"measure": measure, "bin_ns": bin_ns, "by": by, "k": k}
    if append and told(spark, path) != said:
        raise ValueError(f"the sketches have {told(spark, path)}, not {said}")
    value = F.col(measure).cast("bigint")
    binned = events.where(value.isNotNull()).select(*by, value.alias("value"), F.expr(f"(ts_ns - pmod(ts_ns, {bin_ns}L)) div {bin_ns}L").alias("time_bin"))
    sketches = binned.groupBy(*by, "time_bin").agg(
        F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"),
        F.kll_sketch_agg_bigint("value", k).alias("ranks"), F.hll_sketch_agg("value", 14).alias("kinds"),
    )
    sketches.repartition(F.expr(f"time_bin div {FILE_BUCKETS}")).sortWithinPartitions("time_bin").write.mode("append" if append else "overwrite").parquet(f"{path}/bins")
    if not append:
        tell(spark, path, said)


def summary_from_sketches(spark: SparkSession, path: str, t0: int | None = None, t1: int | None = None, by: list[str] | None = None) -> DataFrame:
    """``summarize`` over whole bins of stored sketches: n, total, least and most are exact, p50, p95, p99 and n_distinct are estimates.

    A percentile is a value of the data whose rank is off by less than 1 % of
    the rows with k = 800 (99 % sure), n_distinct by less than 3 %.  The range
    must be of whole bins, ``by`` some of the stored groups (None: all of them).
    """
    said = told(spark, path)
    if said is None:
        raise FileNotFoundError(f"no sketches are stored in {path}")
    if any(x is not None and x % said["bin_ns"] for x in (t0, t1)):
        raise ValueError(f"the range is not of whole bins of {said['bin_ns']} ns")
    bins, by = spark.read.parquet(f"{path}/bins"), said["by"] if by is None else by
    if t0 is not None:
        bins = bins.where(F.col("time_bin") >= t0 // said["bin_ns"])
    if t1 is not None:
        bins = bins.where(F.col("time_bin") < t1 // said["bin_ns"])
    merged = bins.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.kll_merge_agg_bigint("ranks", said["k"]).alias("ranks"), F.hll_sketch_estimate(F.hll_union_agg("kinds")).alias("n_distinct"),
    )
    merged = merged.where("n > 0")
    at = [F.kll_sketch_get_quantile_bigint("ranks", F.lit(p)).alias(name) for p, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))]
    return merged.select(*by, "n", "total", "least", "most", *at, "n_distinct")


# ------------------------------------------------------------- the index of frames


def write_frame_index(samples: DataFrame, path: str, time_bin_ns: int, stack: str = "frames", parts: int = 64, append: bool = False) -> None:
    """Store where each frame occurs: trace, time bin and thread, in ``parts`` folders by a hash of the frame, sorted by it."""
    spark, said = samples.sparkSession, {"time_bin_ns": time_bin_ns, "stack": stack, "parts": parts}
    if append and told(spark, path) != said:
        raise ValueError(f"the index has {told(spark, path)}, not {said}")
    binned = samples.withColumn("time_bin", F.expr(f"(ts_ns - pmod(ts_ns, {time_bin_ns}L)) div {time_bin_ns}L"))
    places = binned.select("trace_id", "time_bin", "pid", "tid", F.explode(F.array_distinct(stack)).alias("frame")).where("frame is not null").distinct()
    places = places.withColumn("part", F.pmod(F.xxhash64("frame"), F.lit(parts)))
    dealt = places.repartition("part", F.pmod(F.xxhash64("frame", "time_bin"), F.lit(8))).sortWithinPartitions("part", "frame", "trace_id", "time_bin")
    dealt.write.mode("append" if append else "overwrite").partitionBy("part").parquet(f"{path}/places")
    if not append:
        tell(spark, path, said)


def places_of(spark: SparkSession, path: str, frame: int | str, trace_id: str | None = None, t0: int | None = None, t1: int | None = None) -> DataFrame:
    """trace_id, time_bin, pid and tid where the frame occurs, from one folder of the index."""
    said = told(spark, path)
    if said is None:
        raise FileNotFoundError(f"no index of frames is stored in {path}")
    frame = F.lit(frame).cast("bigint") if isinstance(frame, int) else F.lit(frame)
    places = spark.read.parquet(f"{path}/places").where((F.col("part") == F.pmod(F.xxhash64(frame), F.lit(said["parts"]))) & (F.col("frame") == frame))
    if trace_id is not None:
        places = places.where(F.col("trace_id") == trace_id)
    if t0 is not None:
        places = places.where((F.col("time_bin") >= t0 // said["time_bin_ns"]) & (F.col("time_bin") <= (t1 - 1) // said["time_bin_ns"]))
    return places.select("trace_id", "time_bin", "pid", "tid")


def samples_with_frame(spark: SparkSession, store: str, index: str, frame: int | str, trace_id: str | None = None, t0: int | None = None, t1: int | None = None) -> DataFrame:
    """Stored samples whose stack holds the frame, from the partitions that the index names alone.

    The partitions come as the result of a join with the index, which Spark
    turns into a filter of folders before any stack is read; they are at most
    as many as the store has, so they are broadcast.
    """
    said = told(spark, index)
    width = told(spark, store, "_trace")["time_bin_ns"]
    if width != said["time_bin_ns"]:
        raise ValueError(f"the store has time bins of {width} ns, the index of {said['time_bin_ns']} ns")
    bins = places_of(spark, index, frame, trace_id, t0, t1).select("trace_id", "time_bin").distinct()
    samples = spark.read.schema(schema.TABLES["samples"] + ", time_bin bigint").parquet(f"{store}/samples")
    if t0 is not None:
        samples = samples.where((F.col("ts_ns") >= t0) & (F.col("ts_ns") < t1))
    held = samples.join(F.broadcast(bins), ["trace_id", "time_bin"], "left_semi")
    return held.where(F.array_contains(said["stack"], frame)).select(*[c.split()[0] for c in schema.TABLES["samples"].split(", ")])


def of_threads_with_frame(df: DataFrame, index: str, frame: int | str, trace_id: str | None = None) -> DataFrame:
    """Rows of the threads that have a sample with the frame, at any time; no stack is read."""
    threads = places_of(df.sparkSession, index, frame, trace_id).select("trace_id", "pid", "tid").distinct()
    return df.join(threads, ["trace_id", "pid", "tid"], "left_semi")

