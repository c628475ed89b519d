"""Nanoseconds from what the recording systems count in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000_000


def from_timestamp(ts: Column) -> Column:
    """Of a timestamp with or without a zone (the session's zone counts, so keep it at UTC)."""
    return F.unix_micros(ts.cast("timestamp")) * 1000


def from_seconds(seconds: Column) -> Column:
    """Of decimal seconds with nine places, exactly."""
    return (seconds.cast("decimal(20,9)") * SECOND).cast("bigint")


def from_ticks(ticks: str, start_ticks: str, start_ns: str, tick_hz: str) -> Column:
    """Of ticks since an own start.  Whole seconds go first: ticks since 1601 in ns would pass 2**63."""
    d = f"({ticks} - {start_ticks})"
    return F.expr(f"{start_ns} + ({d} div {tick_hz}) * {SECOND} + (({d} % {tick_hz}) * {SECOND}) div {tick_hz}")


def to_timestamp(ns: str) -> Column:
    """Of a column; microseconds are kept.  A watermark needs this type."""
    return F.expr(f"timestamp_micros({ns} div 1000)")
