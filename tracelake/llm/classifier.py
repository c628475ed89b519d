"""Quality classifier: supervised subword embeddings with a softmax output.

A text's features are its words, a mark for a word that repeats the one before
it, and its runs of three and four bytes, all hashed into ``BUCKETS``.  The
vectors of its features are averaged and a softmax layer stands on them; both
are learned together by stochastic gradient descent in numpy, in one task, on
at most ``SAMPLE`` labelled documents.  As the layer is linear, a learned
bucket comes down to one number for scoring, and the table of these numbers is
what the tasks get: ``BUCKETS`` of them, however large the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import memory
from .arrays import chunks, per_text, runs, word_hashes

#: Labelled documents that the model is fitted on: those with the least hashes of their ids.
SAMPLE = 4000
BUCKETS = 1 << 17
DIMENSION, EPOCHS, RATE = 8, 6, 4.0
#: Scores from here on count as good.
THRESHOLD = 0.7

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0, 9, 10, 11, 12, 13, 32]] = True
_REPEATED = 1  # the bucket of a repeated word


def _features(texts: list[str | None]) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """(first text, end text, families); a family has buckets, and each text's first and end among them."""
    mask = np.uint32(BUCKETS - 1)
    for first, end, units, bounds in chunks([(t or "").encode() for t in texts], b"\0"):
        visible = ~_SPACE[units]
        starts, ends = runs(visible)
        hashes = word_hashes(units, visible, starts, ends)
        at = per_text(starts, bounds)
        again = np.zeros(len(hashes), dtype=bool)
        again[1:] = hashes[1:] == hashes[:-1]
        again[at[at < len(hashes)]] = False
        families = [((hashes & np.uint64(mask)).astype(np.int64), at[:-1], at[1:])]
        repeated = np.concatenate(([0], np.cumsum(again)))[at]
        families.append((np.full(int(again.sum()), _REPEATED), repeated[:-1], repeated[1:]))
        wide = units.astype(np.uint32)
        for n, odd in ((3, 0x9E3779B1), (4, 0x85EBCA77)):
            gram = np.zeros(max(0, len(wide) - n + 1), dtype=np.uint32)
            for k in range(n):
                gram = gram << np.uint32(8) | wide[k : len(wide) - n + 1 + k]
            buckets = (gram * np.uint32(odd)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
            families.append((buckets.astype(np.int64), bounds[:-1].clip(max=len(gram)), np.maximum(bounds[1:] - n, bounds[:-1]).clip(max=len(gram))))
        yield first, end, families


def _train(texts: list[str], labels: list[int]) -> tuple[np.ndarray, float]:
    """One number for each bucket, and the bias: the log odds of label 1 for averaged buckets."""
    examples = []
    for first, end, families in _features(texts):
        for k in range(end - first):
            own = np.concatenate([b[x[k] : y[k]] for b, x, y in families])
            if len(own):
                bucket, n = np.unique(own, return_counts=True)
                examples.append((bucket.astype(np.int32), (n / len(own)).astype(np.float32), labels[first + k]))
    rng = np.random.default_rng(7)
    vectors = rng.uniform(-1 / DIMENSION, 1 / DIMENSION, (BUCKETS, DIMENSION)).astype(np.float32)
    layer, bias = np.zeros((DIMENSION, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    done, steps = 0, max(1, EPOCHS * len(examples))
    for _ in range(EPOCHS):
        for k in rng.permutation(len(examples)):
            bucket, share, label = examples[k]
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            mean = share @ vectors[bucket]
            logits = mean @ layer + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1  # the gradient of the loss at the logits
            back = layer @ p
            layer -= np.float32(0.1) * rate * np.outer(mean, p)
            bias -= np.float32(0.01) * rate * p
            vectors[bucket] -= rate * np.outer(share, back)
    return (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, float] | None:
    """Learn from labelled rows outside the held-out fold.

    Null ids, texts and labels do not count; of an id with several labels the
    least counts, of one with several texts that with the least hash.  Without
    labels of both kinds there is no model.
    """
    known = labels.select(F.col(label_id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    known = known.where(~held_out(F.col("id"))).groupBy("id").agg(F.min("label").alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(known), "id")
    rows = rows.groupBy("id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.min("label").alias("label"))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory.release()
        all_rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=str)
        if len({label for _, _, label in all_rows}) == 2:
            weights, bias = _train([t for _, t, _ in all_rows], [label for _, _, label in all_rows])
            yield pa.RecordBatch.from_pydict({"weights": [weights.tobytes()], "bias": [bias]})

    made = rows.select("id", "text", "label").repartition(1).mapInArrow(train, "weights binary, bias double").collect()
    if not made:
        return None
    return np.frombuffer(made[0]["weights"], dtype=np.float32), made[0]["bias"]


def score(texts: list[str | None], weights: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(len(texts), bias)
    for first, end, families in _features(texts):
        total, n = np.zeros(end - first), np.zeros(end - first, dtype=np.int64)
        for buckets, x, y in families:
            so_far = np.concatenate(([0.0], np.cumsum(weights[buckets], dtype=np.float64)))
            total += so_far[y] - so_far[x]
            n += y - x
        out[first:end] += total / np.maximum(n, 1)
    return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Texts without features, nulls among them, have the score of the bias alone.
    Without a model every score is even.  A null id is not held out, repeated rows each give one.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    fitted = fit(docs, labels, id_col=id_col, text_col=text_col, **options) or (np.zeros(BUCKETS, dtype=np.float32), 0.0)
    model = docs.sparkSession.sparkContext.broadcast(fitted)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory.release()
        for batch in batches:
            found = score(batch.column(2).to_pylist(), *model.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(judge, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def drop_low_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """``docs`` without the rows whose score is below the threshold; all columns stay, and all rows without a model."""
    fitted = fit(docs, labels, id_col=id_col, text_col=text_col, **options)
    if fitted is None:
        return docs
    model = docs.sparkSession.sparkContext.broadcast(fitted)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory.release()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.filter(pa.array(score(texts, *model.value) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
