"""The common trace format: one fixed schema for each table, whatever the recording system.

Times and durations are nanoseconds in a BIGINT, ranges are half open, stacks
are root first, and an address is the raw 64 bits in a BIGINT.
"""

from __future__ import annotations

EVENTS = "trace_id string, event_id bigint, ts_ns bigint, pid bigint, tid bigint, cpu int, kind string, name string, value double, args map<string,string>"
SPANS = "trace_id string, span_id bigint, start_ns bigint, end_ns bigint, pid bigint, tid bigint, kind string"
SAMPLES = "trace_id string, sample_id bigint, ts_ns bigint, pid bigint, tid bigint, frames array<bigint>, weight bigint"
SYMBOLS = "module string, lo bigint, hi bigint, fn string"
MODULES = "trace_id string, pid bigint, module string, base bigint, limit_addr bigint, load_ns bigint, unload_ns bigint"
SWITCHES = "trace_id string, switch_id bigint, ts_ns bigint, cpu int, pid bigint, tid bigint"

TABLES = {"events": EVENTS, "spans": SPANS, "samples": SAMPLES, "symbols": SYMBOLS, "modules": MODULES, "switches": SWITCHES}

#: The column that places a row in time, for tables that have one.
TIME = {"events": "ts_ns", "spans": "start_ns", "samples": "ts_ns", "switches": "ts_ns"}

#: Decoded rows of each recording system, before they are normalized.
RAW = {
    "linux": "time_s decimal(20,9), pid bigint, tid bigint, cpu int, event string, args_json string",
    "macos": "time_ns bigint, process_id bigint, thread_id bigint, probe string, payload_json string",
    "windows": "ticks bigint, start_ticks bigint, start_ns bigint, tick_hz bigint, ProcessId bigint, ThreadId bigint, Cpu int, Provider string, Task string, Payload string",
}
