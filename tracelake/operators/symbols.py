"""From addresses to modules and functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.addresses import hexadecimal, ordered
from ..plans.ranges import covering, disjoint, point_in_range
from ..plans.scratch import written

#: Bins of 2**12 addresses: a function rarely has more.
FUNCTION_BITS, MODULE_BITS = 12, 20
#: Bins of 2**40 ns, about 18 minutes, of the time that a module is loaded.
LOAD_BITS = 40


def module_pieces(modules: DataFrame, shift: int = MODULE_BITS) -> DataFrame:
    """Disjoint rectangles of addresses (``lo`` to ``hi``, as ``ordered``) and times (``since`` to ``until``), each with the module that holds it.

    Addresses are cut at all limits of a process first, then the times of each
    piece at all loads there; both are written, as more than one step reads them and every frame meets the last.  Of modules that overlap, the one loaded last holds
    the piece, of these that with the greatest base, then name.
    """
    process = ["trace_id", "pid"]
    limits = modules.select(*process, "module", "base", "load_ns", F.col("load_ns").alias("since"), (F.col("unload_ns") - 1).alias("until"), ordered(F.col("base")).alias("lo"), ordered(F.col("limit_addr") - 1).alias("hi"))
    loaded = written(covering(limits, keys=process, lo="lo", hi="hi", shift=shift, carry=["module", "base", "load_ns", "since", "until"], long_keys=False), "loaded")
    pieces = disjoint(loaded, keys=[*process, "lo", "hi"], lo="since", hi="until", shift=LOAD_BITS, best=F.struct("load_ns", "base", "module"), long_keys=False)
    return written(pieces.select(*process, "lo", "hi", "since", "until", F.col("best.module").alias("module")), "pieces")


def attach_module(frames: DataFrame, modules: DataFrame, shift: int = MODULE_BITS) -> DataFrame:
    """``module`` of each (trace_id, pid, ts_ns, addr): where the address lay at that time, else null.

    Modules are cut to disjoint rectangles once, so a frame lies in one of them
    at most and is joined as it is, without being told apart or joined back.
    """
    pieces = module_pieces(modules, shift)
    found = point_in_range(
        frames.drop("module"), pieces, keys=["trace_id", "pid"], point=ordered(F.col("addr")), lo=F.col("lo"), hi=F.col("hi"), shift=shift,
        also=lambda piece: (F.col("ts_ns") >= piece("since")) & (F.col("ts_ns") <= piece("until")),
    )
    return found.select(*[c for c in frames.columns if c != "module"], "module")


def functions(addresses: DataFrame, symbols: DataFrame, shift: int = FUNCTION_BITS) -> DataFrame:
    """``addresses`` (module, addr) with the function ``fn`` whose range holds each, else null.

    Functions of a module do not overlap, so rows stay as many as they are.
    """
    return point_in_range(addresses, symbols.select("module", "lo", "hi", "fn"), keys=["module"], point=ordered(F.col("addr")), lo=ordered(F.col("lo")), hi=ordered(F.col("hi") - 1), shift=shift)


def _named(df: DataFrame, symbols: DataFrame, shift: int) -> DataFrame:
    """``df`` with ``fn``; each address is looked up once, however many rows have it."""
    addresses = df.select("module", "addr").where("module is not null and addr is not null").distinct()
    known = functions(addresses, symbols, shift).where("fn is not null").select(F.col("module").alias("__module"), F.col("addr").alias("__addr"), "fn")
    return df.join(known, (F.col("module") == F.col("__module")) & (F.col("addr") == F.col("__addr")), "left").drop("__module", "__addr")


def symbolize(df: DataFrame, symbols: DataFrame, shift: int = FUNCTION_BITS) -> DataFrame:
    """``fn`` of each (module, addr): the function whose range holds it, else the address in hexadecimal."""
    return _named(df, symbols, shift).select(*df.columns, F.coalesce("fn", hexadecimal(F.col("addr"))).alias("fn"), F.col("fn").isNotNull().alias("resolved"))


def symbolize_stacks(samples: DataFrame, symbols: DataFrame, module: str = "app", modules: DataFrame | None = None) -> DataFrame:
    """Samples with ``stack``, the functions of ``frames`` in their order.

    With ``modules`` each frame is looked up in the module that lay there at the
    sample's time, else all of them in ``module``.  Each distinct stack is
    resolved once, so frames that all stacks share cost no more than others.  An
    empty or null stack gives an empty one, a null frame is "?".
    """
    keys = ["trace_id", "pid", "ts_ns", "frames"] if modules is not None else ["frames"]
    stacks = samples.select(*keys).distinct()
    frames = stacks.select(*keys, F.posexplode("frames").alias("place", "addr"))
    frames = attach_module(frames, modules) if modules is not None else frames.withColumn("module", F.lit(module))
    named = symbolize(frames, symbols)
    parts = F.array_sort(F.collect_list(F.struct("place", F.coalesce("fn", F.lit("?")).alias("fn"))))
    resolved = named.groupBy(*keys).agg(F.transform(parts, lambda x: x["fn"]).alias("stack"))
    return samples.join(resolved, keys, "left").select(*samples.columns, F.coalesce("stack", F.array().cast("array<string>")).alias("stack"))


def symbol_coverage(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Frames and unresolved ones of each module, and the share, of rows with ``resolved``."""
    unresolved = F.sum(F.when(F.col("resolved"), 0).otherwise(1))
    return df.groupBy(*(by or ["module"])).agg(F.count("*").alias("n_frames"), unresolved.alias("n_unresolved"), (unresolved / F.count("*")).alias("share"))
