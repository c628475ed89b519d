"""Best-fit packing of token pieces into sequences of a fixed size.

Bulk-synchronous best fit.  Pieces and gaps are sorted into the ranges of
their sizes, of which there are as many as a sequence has places, and counted.
Each round matches all pieces of one range with their successors, the smallest
gaps that hold them; rank settles which piece takes which gap, the gaps are
updated, and the next smaller range follows.  Rounds read counts of alike pieces
and runs of alike gaps, so they are one small task; ranks of single pieces, which
grow with the corpus, are distributed.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables
from .tokens import encoder

#: Pieces of one length that are ranked in one group, about, and ranks that are looked up together.
GROUP, BLOCK = 1024, 1024


def token_pieces(
    docs: DataFrame, vocabulary: str, size: int, *, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, keep_ids: bool = False
) -> DataFrame:
    """Ids of whole texts with an end id, cut only where longer than ``size``.

    Columns doc_id, piece, start, length, ids_crc32 (and ids if asked for).  The
    first piece of a long document has what is over after pieces of ``size``.
    A null text is empty; without an end id an empty document has no piece.
    """
    tail = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(vocabulary)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else []))}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = pieces.encode(text) + tail
                n = len(ids) // 4
                first = n % size or size
                for k, start in enumerate([0, *range(first, n, size)] if n else []):
                    end = min(n, start + size if k else first)
                    part = ids[4 * start : 4 * end]
                    for name, value in zip(out, (doc_id, k, start, end - start, zlib.crc32(part), np.frombuffer(part, "<u4").astype(np.int32) if keep_ids else None)):
                        out[name].append(value)
            kinds = {"piece": pa.int32(), "ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def sweep(counts: dict[int, int], size: int) -> pd.DataFrame:
    """Best fit of so many pieces of each length, in rounds from the longest length on.

    A round takes all pieces of one length at once.  Gaps are kept sorted by
    their size; the successor of the length is the smallest gap that holds it,
    which takes as many of the pieces as fit, then the next larger gap, and what
    no gap holds opens sequences.  Gaps of one size are alike and kept as runs of
    sequence numbers, pieces are told apart by their rank alone, and both are
    updated before the next round.  So the work follows the number of lengths
    and runs, not of pieces.

    Rows have length, rank (of the first piece), n (pieces), first (sequence),
    per (pieces to a sequence, the last of which may have fewer) and offset.
    """
    rooms: list[int] = []
    runs: dict[int, list[tuple[int, int]]] = {}  # gap size to (first sequence, sequences)
    out, opened = [], 0
    for length in sorted((x for x in counts if x > 0), reverse=True):
        left, rank, made = counts[length], 0, []

        def take(room: int, first: int, many: int) -> int:
            """Fill up to ``many`` gaps of one size; returns how many were taken."""
            nonlocal left, rank
            per = room // length
            used = min(many, -(-left // per))
            full = min(used, left // per)
            for n_sequences, each in ((full, per), (used - full, left - full * per)):
                if n_sequences:
                    out.append((length, rank, n_sequences * each, first, each, size - room))
                    made.append((room - each * length, first, n_sequences))
                    rank, left, first = rank + n_sequences * each, left - n_sequences * each, first + n_sequences
            return used

        at = bisect_left(rooms, length)
        while left and at < len(rooms):
            room = rooms[at]
            while left and runs[room]:
                first, many = runs[room].pop()
                used = take(room, first, many)
                if used < many:
                    runs[room].append((first + used, many - used))
            if runs[room]:
                break
            del runs[room], rooms[at]
        if left:
            opened += take(size, opened, -(-left // (size // length)))
        for room, first, many in made:
            if room and room not in runs:
                insort(rooms, room)
                runs[room] = []
            if room:
                runs[room].append((first, many))
    return pd.DataFrame(out, columns=_PLACED).astype("int64")


_PLACED = ["length", "rank", "n", "first", "per", "offset"]


def places(pieces: DataFrame, size: int, tables: Tables) -> DataFrame:
    """__row, sequence_id and offset of pieces with a length from 1 to ``size``, from __row and length.

    Lengths are counted where the pieces lie.  The table of counts has ``size``
    rows at most, whatever the corpus, and one task sweeps it.  All that grows
    with the corpus is distributed: pieces of a length are dealt to groups and
    ranked within them, and ranks find their run of sequences by blocks.
    """
    lengths = pieces.select("__row", "length")
    counts = tables.written(lengths.groupBy("length").agg(F.count("*").alias("many")), "counts")  # size rows at most
    kinds = ", ".join(f"{c} long" for c in _PLACED)
    runs = counts.groupBy().applyInPandas(lambda rows: sweep(dict(zip(rows["length"].tolist(), rows["many"].tolist())), size), kinds)
    runs = tables.written(runs, "runs")
    groups = F.broadcast(counts.select("length", F.ceil(F.col("many") / GROUP).alias("groups")))
    dealt = lengths.join(groups, "length").withColumn("group", F.pmod(F.xxhash64("__row"), F.col("groups")))
    sizes = dealt.groupBy("length", "group").agg(F.count("*").alias("many"))
    before = Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "group", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("length", "group").orderBy("__row"))
    ranked = dealt.withColumn("within", rank).join(sizes, ["length", "group"]).withColumn("at", F.col("base") + F.col("within") - 1)
    ranked = ranked.select("__row", "length", "at", F.expr(f"at div {BLOCK}").alias("block"))
    blocks = F.sequence(F.expr(f"rank div {BLOCK}"), F.expr(f"(rank + n - 1) div {BLOCK}"))
    runs = runs.withColumn("block", F.explode(blocks))
    met = ranked.join(runs, ["length", "block"]).where("at >= rank and at < rank + n")
    return met.select("__row", F.expr("first + (at - rank) div per").alias("sequence_id"), F.expr("offset + (at - rank) % per * length").alias("offset"))


def pack(pieces: DataFrame, size: int) -> DataFrame:
    """Add sequence_id and offset to pieces with a length from 1 to ``size``.

    Equal rows are told apart by a running number, so no number of them meets
    in one task.
    """
    lasting, tables = Tables(pieces.sparkSession), Tables(pieces.sparkSession)
    columns = pieces.columns
    pieces = lasting.written(pieces.withColumn("__row", F.monotonically_increasing_id()), "pieces")
    found = lasting.written(places(pieces, size, tables), "places")
    tables.remove()
    return pieces.join(found, "__row").select(*columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, vocabulary: str, size: int = 1024, **options) -> DataFrame:
    """Encode, cut and pack documents into sequences of at most ``size`` ids."""
    pieces = token_pieces(docs, vocabulary, size, **options)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return pack(pieces, size).select(*columns, *(["ids"] if options.get("keep_ids") else []))
