"""Token counts by a two-tier lookup on the map side.

The first tier is a table of frequent pre-tokens and their numbers of tokens,
at most ``FREQUENT`` entries, that is broadcast.  Spark finds them with a
frequent-items sketch over each partition's texts, all texts in sum; the
sketches' items are then added up by word, so no task gets more than its share
and no pre-token occurrence is shuffled.  The second tier is a cache in each
worker for what the first one lacks.

White space parts pre-tokens whatever stands around it.  So a text is cut at
it where it has characters for which Python's classes might differ from the
library's: the segments with such characters are counted by the library, and
their counts are cached too; all others are cut into pre-tokens here.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import memory

#: Entries of the broadcast table and of the sketches behind it, and of a worker's cache.
FREQUENT, TRACKED, CACHE = 20_000, 65_536, 500_000
#: Characters of a segment that is cached at most.
SEGMENT = 64

#: A segment with one of these goes to the library: characters beyond Latin
#: letters, some that the libraries class differently, and the start of a special string.
_ODD = re.compile("[^\x00-\x7e\xa0-ɏ]|[\xb2\xb3\xb9\xbc-\xbe\x1c-\x1f]|<\\|")
_SPACE = re.compile("[ \t\n\x0b\x0c\r]+")

# The file's pre-token pattern, for characters that _ODD lets through.
_PRE_TOKEN = re.compile(r"'(?:[stmd]|re|ve|ll)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")

_COUNTERS: dict[str, "_Counter"] = memory.cache()


class _Counter(dict):
    """Tokens of a pre-token or odd segment; what it lacks the library counts."""

    def __init__(self, path: str, frequent: dict[str, int]):
        super().__init__(frequent)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.model._resize_cache(0)  # our cache stands before it
        self.most = len(self) + CACHE

    def __missing__(self, part: str) -> int:
        n = self.by_library(part)
        if len(self) < self.most and len(part) <= SEGMENT:
            self[part] = n
        return n

    def by_library(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not _ODD.search(text):
            return sum(map(self.__getitem__, _PRE_TOKEN.findall(text.lower())))
        segments = _SPACE.split(text)
        odd = [x for x in segments if _ODD.search(x)]
        plain = " ".join([x for x in segments if not _ODD.search(x)])
        return sum(map(self.__getitem__, odd)) + sum(map(self.__getitem__, _PRE_TOKEN.findall(plain.lower())))


def frequent_words(docs: DataFrame, text_col: str, n: int = FREQUENT) -> list[str]:
    """About the ``n`` most frequent words over all texts, from a sketch of each partition.

    Words are runs of letters; a text with characters beyond Latin ones is cut at white space alone.
    """
    text = F.col(text_col)
    cut = F.when(text.rlike("[^\x00-\x7e\xa0-ɏ]"), F.split(text, "[ \t\n\x0b\x0c\r]+")).otherwise(F.split(F.lower(text), r"[^\p{L}]+"))
    words = docs.select(F.spark_partition_id().alias("part"), F.explode(cut).alias("word")).where(f"word <> '' and length(word) <= {SEGMENT}")
    tops = words.groupBy("part").agg(F.expr(f"approx_top_k(word, {n}, {max(n, TRACKED)})").alias("top"))
    found = tops.select(F.explode("top").alias("x")).groupBy(F.col("x.item").alias("word")).agg(F.sum("x.count").alias("n"))
    return [r["word"] for r in found.orderBy(F.desc("n"), "word").limit(n).collect()]  # n rows at most


def token_counts(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of every row, repeated rows too.

    A null text counts as empty, a null id stays null, an empty table gives no
    rows.  No pre-token is shuffled.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counter = _Counter(vocabulary, {})
    words = frequent_words(rows, "text")
    # a line for each word and two bytes for its tokens: some hundred kilobytes
    table = rows.sparkSession.sparkContext.broadcast(("\n".join(words), b"".join(counter.by_library(w).to_bytes(2, "little") for w in words)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _COUNTERS:
            memory.release()
            known, sizes = table.value
            _COUNTERS[vocabulary] = _Counter(vocabulary, {w: int.from_bytes(sizes[2 * k : 2 * k + 2], "little") for k, w in enumerate(known.split("\n")) if w})
        counts = _COUNTERS[vocabulary]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [counts.count(x) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x.encode()) if x else 0 for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
