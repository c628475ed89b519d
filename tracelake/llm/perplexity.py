"""Quality rules: base counts and the perplexity of a character n-gram model.

The model is an interpolated modified Kneser-Ney model of order four over
UTF-16 units.  Every language has two, counted over the two halves of its
documents, and a document is scored by the one that has not seen it, nor any
copy of it: halves go by a hash of the text.  Four units fill a 64-bit integer
exactly, so an n-gram is its own key.  Each task counts its texts in sorted
arrays; Spark adds the counts and computes the smoothed probabilities with
groupings and joins.  For scoring, the n-grams of all orders and the weights
that contexts leave to shorter n-grams are held in arrays sorted by a mixed
key, with a bucket index over them, in slices of bounded size.  All slices are
broadcast, and a task takes one after the other to the n-grams that it holds,
so the texts are read once whatever the size of the model.  An n-gram without a count backs off to the shorter one; a unit without
a count has what the model leaves to one further symbol.

A document is rejected if the logarithm of its perplexity leaves the band of
its language, which is set by the quartiles over the language's documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import memory
from .arrays import chunks, mix
from .common import Tables, small

ORDER = 4
#: Quartile distances below the first and above the third quartile that a document may lie.
BAND = 3.0
#: N-grams and contexts of a slice of the model (12 bytes each), of which a worker has one in memory at a time.
#: Those of one and two units, which a language has few of, are in every slice.
BROADCAST_NGRAMS = 4_000_000
#: Languages up to which tables with a row for each are broadcast.
MOST_LANGUAGES = 10_000
#: N-grams a task holds before it hands its counts on.
HELD = 2_000_000
#: N-grams a task holds before the slices of a model of several go over them.
SCORED_AT_ONCE = 4_000_000
#: The unit before a text, three times; a text's own is counted like it.
_BEGIN = np.uint16(0xFFFF)


# ------------------------------------------------------------------ base counts

_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text; a null has no words."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()  # bytes: white space is 9 to 13 and 32
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, _SYMBOLS))
    seen: set[str] = set()
    repeated_lines = 0
    for line in text.split("\n"):
        if line.strip(_SPACES):
            repeated_lines += line in seen
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        count: dict[tuple, int] = {}
        for w in windows:
            count[w] = count.get(w, 0) + 1
        end = 0  # words before it are counted
        for k, w in enumerate(windows):
            if count[w] > 1:
                repeated += k + 3 - max(k, end)
                end = k + 3
    return len(words), chars, symbols, repeated_lines, repeated


# ---------------------------------------------------------------------- counting


def _ngrams(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end text, n-grams, bounds of each text's n-grams), an n-gram for each unit of a text."""
    sep = _BEGIN.tobytes() * (ORDER - 1)
    coded = [t.encode("utf-16-le", "surrogatepass") + sep[2:] for t in texts]
    for first, end, units, bounds in chunks(coded, sep[:2]):
        wide = np.concatenate((np.frombuffer(sep, "<u2"), units)).astype(np.uint64)
        grams = wide[: len(units)] << np.uint64(48) | wide[1 : len(units) + 1] << np.uint64(32) | wide[2 : len(units) + 2] << np.uint64(16) | wide[3:]
        real = np.ones(len(units), dtype=bool)
        for k in range(1, ORDER):
            real[bounds[1:] - k] = False  # what stands between two texts
        yield first, end, grams[real], bounds - np.arange(len(bounds)) * (ORDER - 1)


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[at], np.add.reduceat(count, at)


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[list, list]] = {}

    def out(lang: str) -> pa.RecordBatch:
        key, count = _merge(*held.pop(lang))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(key)), pa.array(key.view(np.int64)), pa.array(count)], names=["lang", "gram", "n"])

    for batch in batches:
        by: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text:
                by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            for _, _, grams, _ in _ngrams(texts):
                key = np.sort(grams)
                at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                keys, counts = held.setdefault(lang, ([], []))
                keys.append(key[at])
                counts.append(np.diff(np.concatenate((at, [len(key)]))))
                if sum(map(len, keys)) > HELD:
                    held[lang] = tuple([x] for x in _merge(keys, counts))
                    if len(held[lang][0][0]) > HELD // 2:
                        yield out(lang)
    for lang in list(held):
        yield out(lang)


def ngram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram and n over all texts, from columns lang and text."""
    counted = docs.select("lang", "text").mapInArrow(_count_task, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


# ------------------------------------------------------------------------- model


def _discounts(counts: DataFrame) -> DataFrame:
    """lang and the discounts d1, d2, d3 for counts of one, two and more (0.5, 1 and 1.5 where the counts of counts give none)."""
    n = [F.count(F.when(F.col("n") == k, 1)).cast("double") for k in (1, 2, 3, 4)]

    def bounded(d: Column, k: int) -> Column:
        return F.when(d.isNull() | (d <= 0) | (d > k), F.lit(k / 2)).otherwise(d)

    ratio = lambda a, b: F.try_divide(a, b)
    y = ratio(n[0], n[0] + 2 * n[1])
    return counts.groupBy("lang").agg(
        bounded(1 - 2 * y * ratio(n[1], n[0]), 1).alias("d1"), bounded(2 - 3 * y * ratio(n[2], n[1]), 2).alias("d2"), bounded(3 - 4 * y * ratio(n[3], n[2]), 3).alias("d3")
    )


def _suffix(gram: Column, units: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << 16 * units) - 1))


def kneser_ney(counts: DataFrame, models: int, tables: Tables) -> DataFrame:
    """lang, part, gram and logp (natural logarithm) of the n-grams that were counted and of their contexts.

    Part ``k`` has the probabilities of n-grams of ``k`` units; part ``-k`` has
    for their contexts the weight of the shorter n-gram, for ``k = 1`` what a
    unit without a count has.  The highest order has its counts, each lower one
    the number of distinct units that stand before it.  Each order is written
    before the next uses it.
    """
    orders = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        longer = orders[k + 1]
        orders[k] = tables.written(longer.groupBy("lang", _suffix(F.col("gram"), k).alias("gram")).agg(F.count("*").alias("n")), "ngrams")
    below, parts = None, []
    for k in range(1, ORDER + 1):
        table = orders[k].join(small(_discounts(orders[k]), models, MOST_LANGUAGES), "lang")
        discount = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        table = table.withColumn("context", F.shiftrightunsigned("gram", 16) if k > 1 else F.lit(0).cast("long")).withColumn("d", discount)
        context = table.groupBy("lang", "context").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("weight"), F.count("*").alias("symbols"))
        if k == 1:
            context = context.withColumn("weight", F.col("weight") / (F.col("symbols") + 1))
        context = tables.written(context.drop("symbols"), "contexts")
        own = (F.col("n") - F.col("d")) / F.col("total")
        if below is None:
            table = table.join(small(context.drop("context"), models, MOST_LANGUAGES), "lang").withColumn("p", own + F.col("weight"))
        else:
            lower = below.select("lang", F.col("gram").alias("shorter"), F.col("p").alias("below"))
            table = table.join(context, ["lang", "context"]).withColumn("shorter", _suffix(F.col("gram"), k - 1)).join(lower, ["lang", "shorter"])
            table = table.withColumn("p", own + F.col("weight") * F.col("below"))
        below = tables.written(table.select("lang", "gram", "p"), "model")
        parts.append(below.select("lang", F.lit(k).alias("part"), "gram", F.log("p").alias("logp")))
        parts.append(context.select("lang", F.lit(-k).alias("part"), F.col("context").alias("gram"), F.log("weight").alias("logp")))
    return reduce(DataFrame.unionByName, parts)


class HashArrays:
    """Logarithms of one part of a model: keys sorted by their mixed value, with an index of buckets."""

    def __init__(self, grams: np.ndarray, logp: np.ndarray):
        key = mix(grams.view(np.uint64))
        order = np.argsort(key)
        self.key, self.logp = key[order], logp[order].astype(np.float32)
        self.shift = np.uint64(64 - max(1, int(np.ceil(np.log2(len(key) + 1)))))
        size = 1 << int(64 - self.shift)
        edges = np.searchsorted(self.key, np.arange(size, dtype=np.uint64) << self.shift)
        self.start = np.concatenate((edges, [len(key)])).astype(np.int32)

    def get(self, grams: np.ndarray) -> np.ndarray:
        """Logarithms, NaN for keys that the arrays lack."""
        key = mix(grams)
        bucket = (key >> self.shift).astype(np.int64)
        at, end = self.start[bucket].astype(np.int64), self.start[bucket + 1]
        out = np.full(len(key), np.nan, dtype=np.float32)
        left = np.flatnonzero(at < end)
        while len(left):
            same = self.key[at[left]] == key[left]
            out[left[same]] = self.logp[at[left[same]]]
            left = left[~same]
            at[left] += 1
            left = left[at[left] < end[left]]
        return out


class BackOff:
    """A language's model, or a slice of it: hash arrays by part."""

    def __init__(self, part: np.ndarray, grams: np.ndarray, logp: np.ndarray):
        self.arrays = {int(k): HashArrays(grams[part == k], logp[part == k]) for k in np.unique(part)}

    def _get(self, part: int, grams: np.ndarray) -> np.ndarray:
        return self.arrays[part].get(grams) if part in self.arrays else np.full(len(grams), np.nan, dtype=np.float32)

    def logs(self, grams: np.ndarray) -> np.ndarray:
        """Log probabilities of n-grams of the highest order."""
        out, left = np.zeros(len(grams)), np.arange(len(grams))
        for k in range(ORDER, 0, -1):
            shorter = grams[left] & np.uint64((1 << 16 * k) - 1)
            logp = self._get(k, shorter)
            known = ~np.isnan(logp)
            out[left[known]] += logp[known]
            left, shorter = left[~known], shorter[~known]
            if not len(left):
                break
            out[left] += np.nan_to_num(self._get(-k, shorter >> np.uint64(16)))  # a context without a count leaves all
        return out


# ----------------------------------------------------------------------- scoring

_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCORED = "doc_id long, lang string, " + ", ".join(f"{c} long" for c in _BASE) + ", units long, total double"
#: Spreads two units over the slices; a product with them stays below 2 ** 63.
_SPREAD = 0x5F356495


def _slice_of(part: Column, gram: Column, slices: int) -> Column:
    """The slice of a row of the model: by the two units in the middle of the n-grams of four units that look it up."""
    middle = F.when(part > 0, F.shiftrightunsigned(gram, 16)).otherwise(gram).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.pmod(F.shiftrightunsigned(middle * F.lit(_SPREAD), 24), F.lit(slices))


def _in_slice(grams: np.ndarray, slices: int, k: int) -> np.ndarray:
    middle = (grams >> np.uint64(16)) & np.uint64(0xFFFFFFFF)
    return (middle * np.uint64(_SPREAD) >> np.uint64(24)) % np.uint64(slices) == k


def _score(docs: DataFrame, models: list) -> DataFrame:
    """Base counts, n-grams and the sum of their negative log probabilities of each row.

    ``models`` are the broadcast slices of the model.  Of several a worker keeps
    none: it reads one after the other from the executor's copy for every
    ``SCORED_AT_ONCE`` n-grams.  The sum is null where there is no model, that is
    where all texts of a language are in one half.
    """
    slices = len(models)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory.release()
        waiting: list[tuple] = []  # rows without their texts, and what has been added up for them
        held: list[tuple] = []

        def add_up() -> None:
            for k, model in enumerate(models):
                arrays = model.value if slices == 1 or not hasattr(model, "_path") else model.load_from_path(model._path)
                for key, total, at, grams, bounds in held:
                    if key in arrays:
                        logs = np.zeros(len(grams))
                        here = np.flatnonzero(_in_slice(grams, slices, k)) if slices > 1 else np.arange(len(grams))
                        logs[here] = arrays[key].logs(grams[here])
                        total[at] = np.nan_to_num(total[at]) - np.add.reduceat(logs, bounds[:-1])
                del arrays
            held.clear()

        def done() -> Iterator[pa.RecordBatch]:
            for batch, counts, units, total in waiting:
                columns = [*batch, *(pa.array(counts[:, c]) for c in range(len(_BASE))), pa.array(units), pa.array(total, mask=np.isnan(total))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang", *_BASE, "units", "total"])
            waiting.clear()

        n = 0
        for batch in batches:
            keys, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            counts = np.array([base_counts(t) for t in texts], dtype=np.int64).reshape(-1, len(_BASE))
            units, total = np.zeros(len(texts), dtype=np.int64), np.full(len(texts), np.nan)
            for key in set(keys):
                at = np.array([i for i, (x, t) in enumerate(zip(keys, texts)) if x == key and t], dtype=np.int64)
                for first, end, grams, bounds in _ngrams([texts[i] for i in at]):
                    units[at[first:end]] = np.diff(bounds)
                    held.append((key, total, at[first:end], grams, bounds))
                    n += len(grams)
                    if slices == 1 or n > SCORED_AT_ONCE:
                        add_up()
                        n = 0
            waiting.append(((batch.column(0), batch.column(1)), counts, units, total))
            if not held:
                yield from done()
        add_up()
        yield from done()

    return docs.select("doc_id", "lang", "judge", "text").mapInArrow(score, _SCORED)


def _arrays(model: DataFrame) -> dict[str, BackOff]:
    """The model's parts by language; ``model`` is of a counted size."""
    table = model.select("lang", F.col("part").cast("byte").alias("part"), "gram", F.col("logp").cast("float").alias("logp")).toArrow()
    langs = table.column("lang").combine_chunks().dictionary_encode()
    code, part, grams, logp = langs.indices.to_numpy(), *(table.column(c).to_numpy() for c in ("part", "gram", "logp"))
    return {x: BackOff(part[code == k], grams[code == k], logp[code == k]) for k, x in enumerate(langs.dictionary.to_pylist())}


def scores(rows: DataFrame, model: DataFrame, n: int, at_once: int, tables: Tables, lasting: Tables) -> DataFrame:
    """Base counts and log perplexity of each row, written; one pass over the texts.

    A model of more than ``at_once`` rows is parted into slices, read one at a
    time on the driver.  All that an n-gram may back off to is in its slice.
    """
    slices = max(1, -(-n // at_once))
    if slices > 1:
        every = F.abs("part") < ORDER - 1
        parted = model.withColumn("slice", F.when(every, -1).otherwise(_slice_of(F.col("part"), F.col("gram"), slices)))
        model = tables.written(parted.repartition("slice"), "slices", by="slice")
    context, models = rows.sparkSession.sparkContext, []
    for k in range(slices):
        models.append(context.broadcast(_arrays(model if slices == 1 else model.where(F.col("slice").isin(-1, k)))))
    scored = lasting.written(_score(rows, models), "scored")
    for one in models:
        one.destroy()
    return scored.withColumn("log_ppl", F.try_divide("total", "units"))


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_words: int = 50, repeat_share: float = 0.5, band: float = BAND, broadcast_ngrams: int = BROADCAST_NGRAMS) -> DataFrame:
    """doc_id, the five base counts, base_failed, kept, log_ppl, and the band's low and high.

    A null text has no words, a null language is a language of its own, a null
    id stays null, and repeated rows each count and give one.  The bands are
    set by the rows that pass the base rules.  A document has no perplexity,
    and is judged by the base rules alone, if it has no text or if all texts of
    its language are in its own half (copies of a single text, say).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("\0")).alias("lang"), F.col(text_col).alias("text"))
    half = F.pmod(F.xxhash64("text"), F.lit(2))
    rows = rows.withColumn("counted", F.concat("lang", F.lit("\0"), half)).withColumn("judge", F.concat("lang", F.lit("\0"), 1 - half))
    lasting, tables = Tables(docs.sparkSession), Tables(docs.sparkSession)
    counts = tables.written(ngram_counts(rows.select(F.col("counted").alias("lang"), "text")), "ngrams")
    models = counts.select("lang").distinct().count()
    model = kneser_ney(counts, models, tables)
    scored = scores(rows, model, model.count(), broadcast_ngrams, tables, lasting)
    tables.remove()
    failed = (F.col("n_words") < least_words) | (F.col("n_repeat_words") > F.lit(repeat_share) * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    quartiles = scored.where(~F.col("base_failed")).groupBy("lang").agg(F.percentile_approx("log_ppl", [0.25, 0.75], 10_000).alias("q"))
    q1, q3 = F.col("q")[0], F.col("q")[1]
    bands = quartiles.select("lang", (q1 - band * (q3 - q1)).alias("low"), (q3 + band * (q3 - q1)).alias("high"))
    judged = scored.join(small(bands, models, MOST_LANGUAGES), "lang", "left")
    inside = F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(True))
    return judged.select("doc_id", *_BASE, "base_failed", (~F.col("base_failed") & inside).alias("kept"), "log_ppl", "low", "high")
