"""A Merkle manifest of a dataset with a witness for every row.

Leaves of a part (a language) stand in the order of their ids.  They are cut
into aligned blocks of ``ARITY ** LEVELS``, and a block is one task's group:
its leaves are appended one by one to the open subtrees of a frontier.  A leaf
that is appended gets a partial witness, the run of siblings that is open at
that moment; each sibling that follows extends the run, and when a run is
complete its digest is appended to the level above, which extends the witnesses
of all leaves below.  The roots of the blocks are then appended as leaves are,
by the same code over the blocks of blocks, until a part has one root; the
roots of the parts make the last tree.

A witness is one (run, at) for each level: the digests of the run in hexadecimal
behind each other, and the place of the own one.  Siblings are the run without
the own digest, and a digest is folded by putting it at its place.  Leaves,
proofs and folding are Spark expressions; Python runs in the blocks alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, small

ARITY, LEVELS = 8, 4
BLOCK = ARITY**LEVELS
#: Rows of a table by part or block that are broadcast; more are shuffled.
BROADCAST_ROWS = 20_000


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 in hexadecimal of the fields behind each other: `-` for null, else UTF-8 bytes, `:`, value."""
    told = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in fields]
    return F.sha2(F.concat(*told), 256)


class Frontier:
    """Open subtrees of one block, and the witnesses of its leaves."""

    def __init__(self):
        self.open: list[list] = []  # for each level the open run of (digest, first leaf, end leaf)
        self.witnesses: list[list[tuple[list, int]]] = []  # for each leaf (run, at) by level; a run that is open still grows

    def append(self, digest: str) -> None:
        self.witnesses.append([])
        self._add(0, digest, len(self.witnesses) - 1, len(self.witnesses))

    def _add(self, level: int, digest: str, first: int, end: int) -> None:
        if level == len(self.open):
            self.open.append([])
        run = self.open[level]
        for leaf in range(first, end):
            self.witnesses[leaf].append((run, len(run)))
        run.append((digest, first, end))
        if len(run) == ARITY:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        self._add(level + 1, _digest(run), run[0][1], run[-1][2])

    def finish(self, levels: int | None) -> str:
        """The block's digest after so many levels; None: as many as leave one node."""
        level = 0
        while levels is None or level < levels:
            run = self.open[level]
            above = any(self.open[level + 1 :])
            if levels is None and not above and len(run) == 1:
                break
            if run:
                self._close(level)
            level += 1
        (digest, first, end), = self.open[level]
        for leaf in range(first, end):
            del self.witnesses[leaf][level:]
        return digest


def _digest(run: list) -> str:
    return sha256("".join(x[0] for x in run).encode()).hexdigest()


def _grow(rows: pa.Table) -> pa.Table:
    """One block: rows with position, n (nodes of the part) and digest get their witnesses, and the first one the root."""
    rows = rows.sort_by("position")
    tree, digests = Frontier(), rows.column("digest").to_pylist()
    for digest in digests:
        tree.append(digest)
    root = tree.finish(LEVELS if rows.column("n")[0].as_py() > BLOCK else None)
    told: dict[int, str] = {}
    for witness in tree.witnesses:
        for run, _ in witness:
            if id(run) not in told:
                told[id(run)] = "".join(x[0] for x in run)
    runs = pa.array([[told[id(run)] for run, _ in w] for w in tree.witnesses], pa.list_(pa.string()))
    ats = pa.array([[at for _, at in w] for w in tree.witnesses], pa.list_(pa.int32()))
    roots = pa.array([root] + [None] * (len(digests) - 1), pa.string())
    return rows.append_column("runs", runs).append_column("ats", ats).append_column("root", roots)


def numbered(rows: DataFrame, order: Sequence[str], tables: Tables) -> DataFrame:
    """``rows`` with position (from 0) within ``part`` in ``order``, and n, the rows of the part.

    Rows are sorted over all tasks by ranges and counted by part and task, so a
    part that holds most of the rows is spread like any other.  ``order`` must
    be total; a column that tells equal rows apart makes it so.
    """
    by = ["part", *order]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    placed = tables.written(placed, "sorted").withColumn("__task", F.shiftright("__at", 33))
    counts = tables.written(placed.groupBy("part", "__task").agg(F.min("__at").alias("__first"), F.count("*").alias("__many")), "counts")
    base = F.coalesce(F.expr("sum(__many) over (partition by part order by __task rows between unbounded preceding and 1 preceding)"), F.lit(0))
    counts = counts.select("part", "__task", "__first", base.alias("__base"), F.expr("sum(__many) over (partition by part)").alias("n"))
    joined = placed.join(small(counts, counts.count(), BROADCAST_ROWS), ["part", "__task"])
    return joined.withColumn("position", F.col("__base") + F.col("__at") - F.col("__first")).drop("__at", "__task", "__first", "__base")


def grow(nodes: DataFrame, tables: Tables, lasting: Tables | None = None) -> tuple[list[DataFrame], DataFrame]:
    """(stages, roots) of the trees over nodes with part, position, n and digest.

    A stage has the columns of its nodes, block, runs, ats and, in one row of
    each block, root; the nodes of the next stage are these roots.  ``roots``
    has part and root.  ``lasting`` keeps the first stage.
    """
    stages, roots = [], []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        dealt = nodes.withColumn("block", F.expr(f"position div {BLOCK}"))
        kinds = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema] + ["runs array<string>", "ats array<int>", "root string"])
        stages.append(((not stages and lasting) or tables).written(dealt.groupBy("part", "block").applyInArrow(_grow, kinds), "grown"))
        above = stages[-1].where("root is not null").select("part", F.col("block").alias("position"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), F.col("root").alias("digest"))
        roots.append(above.where("n = 1").select("part", F.col("digest").alias("root")))
        if most <= BLOCK:
            return stages, reduce(DataFrame.unionByName, roots)
        nodes, most = above.where("n > 1"), -(-most // BLOCK)


def _above(stages: list[DataFrame]) -> DataFrame:
    """part, block of the first stage, and the runs and ats from the block's root up to the part's."""
    none = {"runs": F.array().cast("array<string>"), "ats": F.array().cast("array<int>"), "at": F.col("block")}
    blocks = stages[0].where("root is not null").select("part", "block").withColumns(none)
    for stage in stages[1:]:
        step = stage.select("part", F.col("position").alias("at"), F.col("runs").alias("__runs"), F.col("ats").alias("__ats"), F.col("block").alias("__next"))
        longer = {c: F.concat(c, F.coalesce(f"__{c}", none[c])) for c in ("runs", "ats")}
        blocks = blocks.join(step, ["part", "at"], "left").withColumns(longer).select("part", "block", "runs", "ats", F.col("__next").alias("at"))
    return blocks.drop("at")


_RUN = "substring(x.runs, 1, 64 * x.ats)", "substring(x.runs, 64 * x.ats + 65)"


def siblings() -> Column:
    """The digests of all siblings of a witness (runs, ats) behind each other, level by level, left to right."""
    return F.expr(f"aggregate(arrays_zip(runs, ats), '', (acc, x) -> concat(acc, {_RUN[0]}, {_RUN[1]}))")


def folded(digest: str) -> Column:
    """The root that a digest leads to by a witness (runs, ats)."""
    return F.expr(f"aggregate(arrays_zip(runs, ats), {digest}, (acc, x) -> sha2(concat({_RUN[0]}, acc, {_RUN[1]}), 256))")


def manifest(rows: DataFrame, *, part_col: str, id_col: str, fields: Sequence[str], carry: dict[str, Column] | None = None) -> DataFrame:
    """id, leaf, runs, ats (the witness from leaf to root), subroot, root, and what ``carry`` names, for every row.

    Parts are ordered with null first, then by the bytes of their name; a null
    id comes first in its part, equal ids go by their leaves.  Equal rows are
    leaves of their own, whose places are exchangeable.  A null field is told
    apart from an empty one.  An empty table gives no rows.  Other columns take
    no part, and names of columns may be any.
    """
    lasting, tables = Tables(rows.sparkSession), Tables(rows.sparkSession)
    part = F.when(F.col(part_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), F.col(part_col).cast("string")))  # sorts null first, and joins
    leaves = rows.select(part.alias("part"), F.col(id_col).alias("id"), leaf_digest([F.col(c) for c in fields]).alias("digest"), F.monotonically_increasing_id().alias("__row"), *[c.alias(f"carry_{n}") for n, c in (carry or {}).items()])
    leaves = tables.written(leaves, "leaves")
    placed = tables.written(numbered(leaves, ["id", "digest", "__row"], tables).drop("__row"), "placed")
    stages, subroots = grow(placed, tables, lasting)
    subroots = subroots.select(F.lit("").alias("part"), F.col("part").alias("of"), F.col("root").alias("digest"))
    tops = tables.written(numbered(subroots, ["of"], tables), "tops")
    upper, roots = grow(tops, tables)
    root = roots.first()
    of = upper[0].select(F.col("of").alias("part"), F.col("digest").alias("subroot"), F.col("block").alias("top"), F.col("runs").alias("runs1"), F.col("ats").alias("ats1"))
    last = _above(upper).select(F.col("block").alias("top"), F.col("runs").alias("runs2"), F.col("ats").alias("ats2"))
    above = _above(stages).join(of.join(last, "top"), "part")
    above = above.select("part", "block", F.concat("runs", "runs1", "runs2").alias("up_runs"), F.concat("ats", "ats1", "ats2").alias("up_ats"), "subroot")
    above = lasting.written(above, "above")
    met = stages[0].join(small(above, above.count(), BROADCAST_ROWS // 10), ["part", "block"])
    out = met.select(
        F.col("id").alias(id_col), F.col("digest").alias("leaf"), F.concat("runs", "up_runs").alias("runs"), F.concat("ats", "up_ats").alias("ats"), "subroot",
        F.lit(root["root"] if root else None).cast("string").alias("root"), *[F.col(f"carry_{n}").alias(n) for n in (carry or {})],
    )
    tables.remove()
    return out


def document_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents by language, and whether a copy of each row leads to the root.

    The copies have their texts' A-Z lower-cased where 3 divides the CRC-32 of
    the id; nothing else is changed, so a copy without such letters verifies.  A
    null id has no digits, so its copy is unchanged.
    """
    told = ["doc_id", "source", "lang", "n_chars"]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    copy = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, lower).otherwise(F.col("text"))
    rows = manifest(docs, part_col="lang", id_col="doc_id", fields=[*told, "text"], carry={"copy": leaf_digest([*map(F.col, told), copy])})
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(), 256).alias("proof_sha256"), folded("copy").alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
