"""Benchmark decontamination with suffix arrays of the training text.

A shard is a run of documents of one task.  Its suffix array holds every word
of it, sorted by the words that follow (as many as a window has, at least).
Every suffix of the test items is looked up there by binary search, which gives
all places that begin with the suffix's window.  Pairs of a place and a test
suffix that follow each other on both sides join to verbatim matches of full
length, with their locations in the document and in the item.

The test items go to the tasks in blocks of bounded size, one block after the
other; hits of several blocks meet by document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import memory
from .arrays import chunks, per_text, runs, word_hashes
from .common import Tables

WINDOW = 10
#: Bytes of test text that are broadcast at once.
BLOCK_BYTES = 16 << 20
#: Bytes of training text in a shard, whose suffix array takes about 15 times as much; a longer text is a shard alone.
SHARD_BYTES = 1 << 20

# Words are runs of a-z, digits and bytes from 128 on, after A-Z is lower-cased.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def _hashed(coded: list[bytes], limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end text, hashes of the words, bounds of each text's words)."""
    for first, end, units, bounds in chunks(coded, b"\0", limit):
        low = _LOWER[units]
        mask = _IN_WORD[low]
        starts, ends = runs(mask)
        yield first, end, word_hashes(low, mask, starts, ends), per_text(starts, bounds)


class TestIndex:
    """The words of a block of items behind each other, and the suffixes that begin a window, by window length (shorter for an item with fewer words).

    Flat arrays: eight bytes for a word and eight for a suffix.
    """

    __test__ = False

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        parts, sizes = [], []
        for _, _, h, b in _hashed([(t or "").encode() for _, t in items], 1 << 20):
            parts.append(h)
            sizes.append(np.diff(b))
        self.names = [n for n, _ in items]
        self.words = np.concatenate([*parts, np.zeros(0, np.uint64)])
        sizes = np.concatenate([*sizes, np.zeros(0, np.int64)])
        self.ends = np.cumsum(sizes)
        length = np.minimum(sizes, window)
        self.suffixes = {
            int(n): np.concatenate([np.arange(e - s, e - n + 1) for s, e in zip(sizes[length == n].tolist(), self.ends[length == n].tolist())]) for n in np.unique(length[length > 0])
        }

    def item(self, suffix: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, suffix, side="right")


def suffix_array(numbers: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Places of all words, sorted by the ``depth`` words from there on; a document's end sorts first.

    ``numbers``: words as numbers from 1 on; ``ends``: for each word the end of
    its document.  Sorted lengths double in each step.
    """
    rank, place, k = numbers.astype(np.int64), np.arange(len(numbers)), 1
    order = np.argsort(rank, kind="stable") if depth == 1 else place
    while k < depth and len(rank):
        after = np.zeros(len(rank), dtype=np.int64)
        after[:-k] = rank[k:]
        after[place + k >= ends] = 0
        key = rank * (int(rank.max()) + 1) + after
        order = np.argsort(key)
        sorted_ = key[order]
        rank[order] = np.cumsum(np.concatenate(([1], sorted_[1:] != sorted_[:-1])))
        k *= 2
    return order


def _bound(numbers: np.ndarray, order: np.ndarray, ends: np.ndarray, asked: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of windows (rows of ``asked``) in the suffix array: first place not before them, or first one after them."""
    low, high = np.zeros(len(asked), dtype=np.int64), np.full(len(asked), len(order), dtype=np.int64)
    while (going := np.flatnonzero(low < high)).size:
        mid = (low[going] + high[going]) // 2
        at, same, less = order[mid], np.ones(len(going), dtype=bool), np.zeros(len(going), dtype=bool)
        end = ends[at]
        for k in range(asked.shape[1]):
            mine = np.where(at + k < end, numbers[np.minimum(at + k, len(numbers) - 1)], 0)
            theirs = asked[going, k]
            less |= same & (mine < theirs)
            same &= mine == theirs
            if not same.any():
                break
        right = (less | same) if after else less
        low[going[right]], high[going[~right]] = mid[right] + 1, mid[~right]
    return low


def _pairs(index: TestIndex, hashes: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(window length, places in the shard, test suffixes there) of all occurrences."""
    if not len(hashes) or not len(index.words):
        return
    known, numbers = np.unique(hashes, return_inverse=True)
    numbers = numbers.astype(np.int64) + 1
    at = np.minimum(np.searchsorted(known, index.words), len(known) - 1)
    asked = np.where(known[at] == index.words, at + 1, 0)  # zero: the shard lacks the word
    lacking = np.concatenate(([0], np.cumsum(asked == 0)))
    depth = 1 << (max(index.suffixes) - 1).bit_length()
    order = suffix_array(numbers, ends, depth)
    for size, suffixes in index.suffixes.items():
        able = suffixes[lacking[suffixes + size] == lacking[suffixes]]
        if not len(able):
            continue
        windows = asked[able[:, None] + np.arange(size)]
        first, last = (_bound(numbers, order, ends, windows, after) for after in (False, True))
        many = last - first
        if many.any():
            place = order[np.repeat(first - np.cumsum(many) + many, many) + np.arange(int(many.sum()))]
            yield size, place, np.repeat(able, many)


def _matches(index: TestIndex, size: int, place: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, test suffixes, lengths) of the longest verbatim matches that the pairs are part of."""
    item = index.item(suffix)
    order = np.lexsort((place, place - suffix))
    place, suffix, item = place[order], suffix[order], item[order]
    head = np.ones(len(place), dtype=bool)
    head[1:] = (np.diff(place) != 1) | (np.diff(suffix) != 1) | (np.diff(item) != 0)
    at = np.flatnonzero(head)
    return place[at], suffix[at], np.diff(np.concatenate((at, [len(place)]))) + size - 1


def _shards(texts: list[str | None], shard_bytes: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, end text, hashes of the words, bounds of the texts, end of each word's text)."""
    for first, end, hashes, bounds in _hashed([(t or "").encode() for t in texts], shard_bytes):
        yield first, end, hashes, bounds, np.repeat(bounds[1:], np.diff(bounds))


_FOUND = "n_words long, places array<int>, items array<string>, matches array<struct<at:int, length:int, item:string, item_at:int>>"


def _search(rows: DataFrame, index, shard_bytes: int, hits_only: bool) -> DataFrame:
    """row, n_words, hit places, items and longest matches of each row, or of those with a hit.

    ``index`` is a broadcast TestIndex; ``rows`` has row and text.
    """
    match = pa.struct([("at", pa.int32()), ("length", pa.int32()), ("item", pa.string()), ("item_at", pa.int32())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory.release()
        test: TestIndex = index.value
        starts = np.concatenate(([0], test.ends[:-1])) if len(test.ends) else np.zeros(1, np.int64)
        for batch in batches:
            for first, end, hashes, bounds, ends in _shards(batch.column(1).to_pylist(), shard_bytes):
                edge = np.zeros(len(hashes) + 1, dtype=np.int64)
                items, matches = [set() for _ in range(first, end)], [[] for _ in range(first, end)]
                for size, place, suffix in _pairs(test, hashes, ends):
                    np.add.at(edge, place, 1)
                    np.add.at(edge, place + size, -1)
                    at, suffix, length = _matches(test, size, place, suffix)
                    text, item = np.searchsorted(bounds, at, side="right") - 1, test.item(suffix)
                    for t, i, p, n, q in zip(text.tolist(), item.tolist(), (at - bounds[text]).tolist(), length.tolist(), (suffix - starts[item]).tolist()):
                        items[t].add(test.names[i])
                        matches[t].append({"at": p, "length": n, "item": test.names[i], "item_at": q})
                hit = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                of = np.searchsorted(hit, bounds)
                places = pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.array(hit - np.repeat(bounds[:-1], np.diff(of)), pa.int32()))
                out = pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[first:end],
                        pa.array(np.diff(bounds)),
                        places,
                        pa.array([sorted(i for i in x if i is not None) for x in items], pa.list_(pa.string())),
                        pa.array([sorted(x, key=lambda m: (-m["length"], m["at"], m["item"] is None, m["item"], m["item_at"])) for x in matches], pa.list_(match)),
                    ],
                    names=["row", "n_words", "places", "items", "matches"],
                )
                yield out.filter(pa.array(np.diff(of) > 0)) if hits_only else out

    kind = dict(rows.dtypes)["row"]
    return rows.select("row", "text").mapInArrow(search, f"row {kind}, {_FOUND}")


class _Blocks:
    """Blocks of test items, dealt by a hash; one at least.  Each is a broadcast index that lasts as long as it is used."""

    def __init__(self, tests: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int):
        self.tests = tests.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text is not null").distinct()  # copies of an item would meet in one block
        self.window = window
        self.n = max(1, math.ceil((self.tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes))

    def index(self, block: int):
        part = self.tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(self.n)) == block).collect()  # about block_bytes
        return self.tests.sparkSession.sparkContext.broadcast(TestIndex(sorted(((r["item"], r["text"]) for r in part), key=str), self.window))


def overlaps(docs: DataFrame, tests: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_words, places (of words inside a test window), items (as strings, sorted) and matches.

    A window is ``window`` words of an item, or all of an item with fewer.
    ``matches`` has the verbatim matches that no longer one holds: place in the
    document, length in words, item and place in the item; the longest first,
    of equal ones that with the least place, then item.

    Null texts and texts without words have and match nothing; a null item id
    matches without a name; every row of ``docs`` gives one, repeated rows too;
    either table may be empty.
    """
    rows = docs.select(F.col(id_col).alias("row"), F.col(text_col).alias("text"))
    blocks = _Blocks(tests, item_col, item_text_col, window, block_bytes)
    if blocks.n == 1:
        return _search(rows, blocks.index(0), shard_bytes, False).withColumnRenamed("row", "doc_id")
    lasting, tables = Tables(docs.sparkSession), Tables(docs.sparkSession)
    rows = tables.written(rows.select(F.monotonically_increasing_id().alias("row"), F.col("row").alias("doc_id"), "text"), "rows")
    hits = None
    for block in range(blocks.n):
        index = blocks.index(block)
        one = tables.written(_search(rows, index, shard_bytes, block > 0), "hits")  # the first block tells n_words of all rows
        hits = one if hits is None else hits.unionByName(one)
        index.unpersist()
    order = "(a, b) -> CASE WHEN a.length <> b.length THEN b.length - a.length WHEN a.at <> b.at THEN a.at - b.at WHEN a.item < b.item THEN -1 WHEN a.item > b.item THEN 1 ELSE a.item_at - b.item_at END"
    merged = hits.groupBy("row").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.flatten(F.collect_list("matches")).alias("matches"),
    )
    merged = merged.withColumn("matches", F.expr(f"array_sort(matches, {order})"))
    merged = lasting.written(merged.join(rows.select("row", "doc_id"), "row").select("doc_id", "n_words", "places", "items", "matches"), "merged")
    tables.remove()
    return merged


def drop_contaminated(docs: DataFrame, tests: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` without the rows that share a window with a test item; all columns stay.

    Each block of test items is a filter over the rows, so nothing is shuffled;
    between two blocks the rows that are left are written.
    """
    blocks, tables = _Blocks(tests, item_col, item_text_col, window, block_bytes), []
    for block in range(blocks.n):
        index = blocks.index(block)

        def clean(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            memory.release()
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                keep = np.ones(len(texts), dtype=bool)
                for first, _, hashes, bounds, ends in _shards(texts, shard_bytes):
                    for _, place, _ in _pairs(index.value, hashes, ends):
                        keep[first + np.searchsorted(bounds, place, side="right") - 1] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
        if block < blocks.n - 1:
            tables.append(Tables(docs.sparkSession))
            docs = tables[-1].written(docs, "clean")
            index.unpersist()
            for old in tables[:-1]:
                old.remove()
    return docs
