"""Runs of words that repeat with a period, found by recursive frequency splitting.

A run has a smallest period q (words q apart are identical), at least
``TIMES * q`` and at least ``LEAST`` words, and no neighbouring word extends it.
So each of its words occurs ``TIMES`` times in it: a word that occurs less often
within a segment of the text is in no run there and splits the segment.  Pieces
too short for a run are dropped, the others are counted anew, until no word
splits.  What survives is scanned by lags.

Short lags are compared over a whole segment.  For lags from b to 2b - 1, b a
power of two, a run holds one of the blocks of b words that start at multiples
of b within its first period, and the block recurs one period further on; so
only lags at which such a block recurs are scanned, and only where three periods
agree.  Blocks are compared by ranks that double in length, which are exact.
The work on a text of n words grows with n log² n at most, whatever it repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIMES, LEAST = 4, 6
#: Lags below this are compared over whole segments.
SHORT = 16
#: Bytes of a text that are cut into words at a time.
PART = 1 << 20

_SPACE = b" \t\n\r\x0b\x0c"


def word_ids(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The number of each word, and the words by number.  Words are what stands between bytes 9 to 13 and 32."""
    known: dict[bytes, int] = {}
    parts, at = [], 0
    while at < len(text):
        end = min(len(text), at + PART)
        while end < len(text) and text[end] not in _SPACE:
            end += 1
        parts.append(np.array([known.setdefault(w, len(known)) for w in text[at:end].split()], dtype=np.int32))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32), list(known)


def segments(ids: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches in which every word occurs ``TIMES`` times at least."""
    place, label = np.arange(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
    while len(place):
        _, inverse, counts = np.unique(label * (int(ids.max()) + 1) + ids[place], return_inverse=True, return_counts=True)
        rare = counts[inverse] < TIMES
        split = np.zeros(int(label[-1]) + 1, dtype=bool)
        split[label[rare]] = True
        whole = ~split[label]
        edges = np.flatnonzero(np.diff(label[whole], prepend=-1, append=-1))
        stable = place[whole]
        yield from ((int(stable[a]), int(stable[b - 1]) + 1) for a, b in zip(edges[:-1], edges[1:]))
        left = ~whole & ~rare
        place, label = place[left], label[left]
        if len(place):
            new = np.flatnonzero((np.diff(place, prepend=-2) != 1) | (np.diff(label, prepend=-1) != 0))
            size = np.diff(new, append=len(place))
            long_enough = np.repeat(size >= LEAST, size)
            label = np.repeat(np.cumsum(size >= LEAST) - 1, size)[long_enough]
            place = place[long_enough]


def _stretches(same: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).view(np.int8)))
    for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist()):
        if b - a >= least:
            yield a, b


def _reach(ids: np.ndarray, at: int, lag: int, step: int) -> int:
    """How far words agree with those ``lag`` further on, from ``at`` on (step 1) or before ``at`` (step -1)."""
    here, width = at, 64
    while True:
        a, b = (here, min(here + width, len(ids) - lag)) if step > 0 else (max(0, here - width), here)
        if a >= b:
            return here
        other = np.flatnonzero(ids[a:b] != ids[a + lag : b + lag])
        if len(other):
            return a + int(other[0]) if step > 0 else a + int(other[-1]) + 1
        here, width = (b if step > 0 else a), 2 * width


def scan(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one segment."""
    n, found = len(ids), []
    reach = np.zeros(n + 1, dtype=np.int64)  # the farthest end of a run of a smaller period over each place

    def add(start: int, end: int, period: int) -> None:
        found.append((start, end - start, period))
        np.maximum(reach[start:end], end, out=reach[start:end])

    for q in range(1, min(SHORT - 1, n // TIMES) + 1):
        for a, b in list(_stretches(ids[:-q] == ids[q:], max(LEAST, TIMES * q) - q)):
            if reach[a] < b + q:  # else a smaller period divides q
                add(a, b + q, q)
    rank, block = ids.astype(np.int64), 1
    while TIMES * block <= n:
        if block >= SHORT:
            _scan_blocks(ids, rank, block, reach, add)
        pairs = rank[:-block] * (int(rank.max()) + 1) + rank[block:]
        rank, block = np.unique(pairs, return_inverse=True)[1], 2 * block
    return found


def _scan_blocks(ids: np.ndarray, rank: np.ndarray, block: int, reach: np.ndarray, add) -> None:
    """Runs with periods from ``block`` to 2 * block - 1; ``rank`` tells the blocks at all places apart."""
    n, m = len(ids), len(rank)
    keys = rank * (2 * m + 2 * block) + np.arange(m)
    sorted_keys = np.sort(keys)
    starts = np.arange(0, m, block)
    low = np.searchsorted(sorted_keys, keys[starts] + block)
    many = np.searchsorted(sorted_keys, keys[starts] + np.minimum(2 * block, n // TIMES + 1)) - low
    many = np.maximum(many, 0)
    which = np.repeat(low - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
    s = np.repeat(starts, many)
    q = sorted_keys[which] % (2 * m + 2 * block) - s
    ok = (s + 3 * q <= n) & (reach[s] < s + 2 * q)
    s, q = s[ok], q[ok]
    # three periods from s on: blocks at the begin and at the end of the two stretches that must agree
    ok = (rank[s + q - block] == rank[s + 2 * q - block]) & (rank[s + q] == rank[s + 2 * q]) & (rank[s + 2 * q - block] == rank[s + 3 * q - block])
    s, q = s[ok], q[ok]
    order = np.lexsort((s, q))
    last, seen = -1, -1  # the period and the end of the stretch of the last candidate
    for a, lag in zip(s[order].tolist(), q[order].tolist()):
        if lag == last and a < seen or reach[a] >= a + 2 * lag:
            continue
        start, end = _reach(ids, a, lag, -1), _reach(ids, a, lag, 1)
        last, seen = lag, end
        if end + lag - start >= TIMES * lag:
            add(start, end + lag, lag)


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period."""
    out = []
    for a, b in segments(ids):
        out += [(a + start, length, q) for start, length, q in scan(ids[a:b])]
    return sorted(out, key=lambda x: (x[0], x[2]))


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, runs (array of start, length, period; by start and period) and collapsed, for every row.

    ``collapsed`` is the text's words without those that a run has after its
    first period, joined by one space.  A null or empty text has no runs and
    collapses to an empty one; repeated rows are rows of their own, ids may be
    null, other columns take no part whatever their names, and an empty table
    gives no rows.  A text is handled in one task, in some tens of bytes for
    each of its words.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            found, collapsed = [], []
            for text in batch.column(1).to_pylist():
                ids, words = word_ids((text or "").encode())
                own = runs(ids) if len(ids) else []
                kept = np.ones(len(ids), dtype=bool)
                for start, length, q in own:
                    kept[start + q : start + length] = False
                found.append([{"start": a, "length": n, "period": q} for a, n, q in own])
                collapsed.append(b" ".join(map(words.__getitem__, ids[kept].tolist())).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind), pa.array(collapsed, pa.string())], names=["id", "runs", "collapsed"])

    kinds = f"id {rows.schema['id'].dataType.simpleString()}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return rows.mapInArrow(find, kinds).withColumnRenamed("id", id_col)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs`` in which about every tenth text goes on with copies of a stretch of its own.

    With h the CRC-32 of the id's digits, g = h div 10 and n words, where 10
    divides h the words from a = g % n on repeat with the period
    1 + (n - a) div (3 + g % 8).
    """
    words: Column = F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), x -> x <> '')")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    told = docs.select("doc_id", "text", F.when((h % 10 == 0) & F.col("text").isNotNull(), words).alias("w"), F.floor(h / 10).alias("g"))
    told = told.withColumn("n", F.size("w").cast("long"))
    a = F.when(F.col("n") > 0, F.col("g") % F.col("n"))
    told = told.withColumn("a", a).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    changed = F.expr("array_join(transform(w, (x, i) -> if(i < a, x, w[cast(a + (i - a) % p as int)])), ' ')")
    return told.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))
