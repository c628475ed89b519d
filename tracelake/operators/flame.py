"""Flame graphs of stacks, root first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lanes import summed
from ..plans.scratch import written
from .selection import Selection

#: Folded stacks that are put in order in one task.
STACKS = 65_536


def fold_stacks(samples: DataFrame, stack: str = "stack") -> DataFrame:
    """Equal stacks as one, with their weight."""
    return samples.groupBy(F.col(stack).alias("stack")).agg(F.sum("weight").alias("weight"))


def flame_tree(folded: DataFrame) -> DataFrame:
    """A node for each prefix of a stack: path, depth (1: root), name, total and self weight.

    Stacks are folded first, so a node costs as many rows as it has different
    stacks; an empty stack has no node.
    """
    depths = F.when(F.size("stack") > 0, F.sequence(F.lit(1), F.size("stack"))).otherwise(F.array().cast("array<int>"))
    prefixes = folded.select("stack", "weight", F.explode(depths).alias("depth")).select(
        F.slice("stack", 1, F.col("depth")).alias("path"), "depth", "weight", F.when(F.col("depth") == F.size("stack"), F.col("weight")).otherwise(0).alias("own")
    )
    nodes = prefixes.groupBy("path", "depth").agg(F.sum("weight").alias("total"), F.sum("own").alias("self"))
    return nodes.select("path", "depth", F.element_at("path", -1).alias("name"), "total", "self")


def flame_layout(tree: DataFrame) -> DataFrame:
    """Where each node begins: siblings stand by name from their parent's begin on, so ``[x, x + total)`` nest.

    The offset among siblings is a sum over one parent's children; a node's
    begin is the sum of the offsets of its ancestors and its own.
    """
    parent = F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))
    order = Window.partitionBy("parent").orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    placed = tree.withColumn("parent", parent).withColumn("offset", F.coalesce(F.sum("total").over(order), F.lit(0)))
    chain = placed.select("path", F.explode(F.sequence(F.lit(1), "depth")).alias("k")).select("path", F.slice("path", 1, F.col("k")).alias("above"))
    begins = chain.join(placed.select(F.col("path").alias("above"), "offset"), "above").groupBy("path").agg(F.sum("offset").alias("x"))
    return tree.join(begins, "path").select(*tree.columns, "x")


def _contexts(folded: DataFrame, *more: str) -> DataFrame:
    """A row for each frame of each stack: id, parent, depth, name, weight and own.

    A context's id is the MD5 of its parent's id and its name, so it stands for
    the whole path in 32 characters, and a stack's rows grow with its depth.
    """
    ids = F.aggregate("stack", F.array(F.lit("")), lambda acc, name: F.array_append(acc, F.md5(F.concat(F.element_at(acc, -1), name))))
    named = folded.select(F.transform("stack", lambda x: F.coalesce(x.cast("string"), F.lit("?"))).alias("stack"), "weight", *more).withColumn("ids", ids)
    frames = named.select("ids", "weight", *more, F.size("stack").alias("n"), F.posexplode("stack").alias("at", "name"))
    own = F.when(F.col("at") + 1 == F.col("n"), F.col("weight")).otherwise(0)
    return frames.select(F.get("ids", F.col("at") + 1).alias("id"), F.get("ids", F.col("at")).alias("parent"), (F.col("at") + 1).alias("depth"), "name", "weight", own.alias("own"), *more)


def _nodes(frames: DataFrame, *more: Column) -> DataFrame:
    same = [F.first(c).alias(c) for c in ("parent", "depth", "name")]  # the id says what they are
    return frames.groupBy("id").agg(*same, F.sum("weight").alias("total"), F.sum("own").alias("self"), *more)


def context_tree(folded: DataFrame) -> DataFrame:
    """The calling-context tree of folded stacks: id, parent ("" at the root), depth (1: root), name, total and self.

    It is ``flame_tree`` with ids for paths: its bytes grow with the depth of
    stacks, not with its square.  A null frame is "?"; an empty stack has no node.
    """
    return _nodes(_contexts(folded))


def context_layout(folded: DataFrame) -> DataFrame:
    """``context_tree`` with ``x``, the begin of each node, by one running sum over the folded stacks.

    Stacks are sorted by ranges over all tasks, a stack after those that go on
    from it; what is before the first stack of a node is then to its left.
    Siblings stand by name from their parent's begin on, as in ``flame_layout``.
    The sorted stacks are written once.
    """
    told = folded.where(F.size("stack") > 0).select("stack", "weight")
    ends = F.array(F.struct(F.lit(1).alias("last"), F.lit("").alias("name")))
    steps = F.transform("stack", lambda x: F.struct(F.lit(0).alias("last"), F.coalesce(x.cast("string"), F.lit("?")).alias("name")))
    placed = told.withColumn("key", F.concat(steps, ends)).repartitionByRange("key").sortWithinPartitions("key").drop("key")
    placed = written(placed.withColumn("at", F.monotonically_increasing_id()), "stacks")
    upto = summed(placed, [], ["at"], "weight", "upto", STACKS)
    return _nodes(_contexts(upto.withColumn("before", F.col("upto") - F.col("weight")), "before"), F.min("before").alias("x"))


def context_paths(nodes: DataFrame, folded: DataFrame) -> DataFrame:
    """``nodes`` with ``path``, for a display of few nodes: each takes its path from one stack that passes it."""
    frames = _contexts(folded.withColumn("whole", F.col("stack")), "whole")
    paths = frames.join(nodes.select("id"), "id", "left_semi").groupBy("id").agg(F.min("whole").alias("whole"))
    return nodes.join(paths, "id").withColumn("path", F.slice("whole", 1, F.col("depth"))).drop("whole")


def function_summary(samples: DataFrame, stack: str = "stack") -> DataFrame:
    """Self and inclusive weight of each function; one that recurs in a stack counts once."""
    folded = fold_stacks(samples, stack)
    frames = folded.select(F.explode(F.array_distinct("stack")).alias("fn"), "weight", F.element_at("stack", F.size("stack")).alias("top"))
    return frames.groupBy("fn").agg(F.sum("weight").alias("inclusive"), F.sum(F.when(F.col("fn") == F.col("top"), F.col("weight")).otherwise(0)).alias("self"))


def flame(samples: DataFrame, sel: Selection, stack: str = "stack") -> DataFrame:
    """The laid out flame graph of the samples under a selection."""
    return flame_layout(flame_tree(fold_stacks(samples.where(sel.predicate(samples)), stack)))


def flame_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Totals of each path in two folded profiles and their difference; a path that one lacks has 0 there."""
    left, right = (flame_tree(x).select("path", F.col("total").alias(n)) for x, n in ((a, "total_a"), (b, "total_b")))
    both = left.join(right, "path", "full").select("path", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total_a", "total_b")))
    return both.withColumn("diff", F.col("total_b") - F.col("total_a"))


def flame_contexts(samples: DataFrame, sel: Selection, stack: str = "stack") -> DataFrame:
    """``flame`` with ids of contexts for paths."""
    return context_layout(fold_stacks(samples.where(sel.predicate(samples)), stack))


def context_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """``flame_diff`` with ids of contexts for paths, in one pass over both folded profiles."""
    sides = a.select("stack", F.col("weight").alias("weight"), F.lit(0).cast("bigint").alias("other")).unionByName(b.select("stack", F.lit(0).cast("bigint").alias("weight"), F.col("weight").alias("other")))
    nodes = _nodes(_contexts(sides, "other"), F.sum("other").alias("total_b"))
    return nodes.select("id", "parent", "depth", "name", F.col("total").alias("total_a"), "total_b", (F.col("total_b") - F.col("total")).alias("diff"))
