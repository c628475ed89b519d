"""Exact search for the greatest inner products, by buckets of vector length.

Vectors are sorted by length over all tasks and cut into buckets of neighbours.
For a query with threshold t (its k-th best score so far) and a bucket whose
longest vector has the length l, only vectors with a cosine of t / (|q| * l) at
least can enter the result: the bucket's local threshold.  Above 1 the bucket is
passed over.  Else one of two prunings is chosen for the query in this bucket:

* coordinates: where the query is strongest, a candidate's coordinate must lie in
  an interval that narrows with the local threshold; the bucket's sorted list of
  that coordinate gives the candidates.  Taken if the interval keeps few of them.
* length: only the bucket's vectors with a length of t / |q| at least.

What is left is verified by exact integer products.  Queries go to the buckets
in blocks of bounded size, each with first thresholds from the longest vectors;
a task raises them as it goes and gives its k best, and these are merged.
(LEMP: Teflioudi and Gemulla, TODS 42(1), 2016.)
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables

#: Vectors of a bucket, bytes of a block of queries, vectors that give first thresholds (at most, and in bytes).
BUCKET, BLOCK_BYTES, SEEDS, SEED_BYTES = 2048, 16 << 20, 4096, 8 << 20
#: Products that a task keeps before it takes the best of them.
MOST_HELD = 1 << 20
#: An interval of coordinates is used if it keeps less than this share of a bucket: gathered products cost so much more than those of matrices.
SHARE = 1 / 8
#: Vectors of this length or more take no part: their products might not fit 64 bits.
LONGEST = float(1 << 31)
#: Below this, products of floats are exact.
EXACT = float(1 << 53)
#: Slack of rounded comparisons; it only keeps more.
SLACK = 1e-9

NONE = np.iinfo(np.int64).min


def integer_vectors(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """row, id, v (little-endian 64-bit floor(scale * x)) and norm, of the vectors that take part."""
    x = F.transform(F.col(vector_col), lambda a: a.cast("double"))
    usable = F.col("x").isNotNull() & ~F.exists("x", lambda a: a.isNull() | F.isnan(a) | (F.abs(a * scale) >= LONGEST))
    told = rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), x.alias("x")).where(F.coalesce(usable, F.lit(False)))

    def floor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            bounds, flat = lists.offsets.to_numpy(), np.floor(scale * lists.values.to_numpy(zero_copy_only=False)).astype("<i8")
            parts = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
            norms = [float(np.sqrt((p.astype(np.float64) ** 2).sum())) for p in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array(norms, pa.float64())], names=["row", "id", "v", "norm"])

    return told.mapInArrow(floor, "row long, id long, v binary, norm double").where(F.col("norm") < LONGEST)


def _matrix(vectors: list[bytes], width: int, kind) -> np.ndarray:
    """A row for each vector; a shorter one is filled up with zeros."""
    if all(len(v) == 8 * width for v in vectors):
        return np.frombuffer(b"".join(vectors), dtype="<i8").reshape(len(vectors), width).astype(kind)
    return np.frombuffer(b"".join(v + bytes(8 * width - len(v)) for v in vectors), dtype="<i8").reshape(len(vectors), width).astype(kind)


class Search:
    """Queries of one block with their k best so far."""

    def __init__(self, rows: np.ndarray, matrix: np.ndarray, norms: np.ndarray, thresholds: np.ndarray, k: int):
        self.rows, self.matrix, self.norms, self.k = rows, matrix, norms, k
        self.floor = thresholds.copy()  # scores below take no part
        self.direction = matrix / np.maximum(norms, 1.0)[:, None]
        self.focus = np.abs(self.direction).argmax(axis=1) if matrix.size else np.zeros(len(rows), dtype=np.int64)
        at = np.arange(len(rows))
        self.cosine = np.clip(self.direction[at, self.focus], -1, 1) if matrix.size else np.zeros(len(rows))
        self.by_row = np.argsort(rows)
        none = np.zeros(0, dtype=np.int64)
        self.best = none, none, none, none  # query, score, id (a null as the greatest), row
        self.held: list[tuple] = []

    def _own(self, candidates: np.ndarray) -> np.ndarray:
        """For each candidate the query that it is itself, else -1."""
        at = np.searchsorted(self.rows, candidates, sorter=self.by_row)
        at = self.by_row[np.minimum(at, len(self.rows) - 1)]
        return np.where(self.rows[at] == candidates, at, -1)

    def _found(self, *products: np.ndarray) -> None:
        """Keep (query, score, id, row) of products until there are many."""
        if len(products[0]):
            self.held.append(products)
            if sum(len(x[0]) for x in self.held) > MOST_HELD:
                self._take()

    def _take(self) -> None:
        """Merge what was found, keep the k best of each query, raise the thresholds."""
        if not self.held:
            return
        query, score, ids, rows = (np.concatenate(x) for x in zip(self.best, *self.held))
        self.held = []
        order = np.lexsort((rows, ids, -score, query))
        query, score, ids, rows = query[order], score[order], ids[order], rows[order]
        first = np.flatnonzero(np.diff(query, prepend=-1))
        rank = np.arange(len(query)) - np.repeat(first, np.diff(first, append=len(query)))
        last = rank == self.k - 1
        self.floor[query[last]] = np.maximum(self.floor[query[last]], score[last])
        kept = rank < self.k
        self.best = query[kept], score[kept], ids[kept], rows[kept]

    def meet(self, ids: np.ndarray, rows: np.ndarray, matrix: np.ndarray, norms: np.ndarray) -> dict[str, int]:
        """Search one bucket; tells how many queries were passed over, pruned by coordinates and by length."""
        order = np.argsort(-norms, kind="stable")
        ids, rows, matrix, norms = ids[order], rows[order], matrix[order], norms[order]
        longest, own = norms[0], self._own(rows)
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(self.floor > 0, self.floor / np.maximum(self.norms, 1e-300), -np.inf) * (1 - SLACK)
        alive = np.flatnonzero((need <= longest) | (self.floor <= 0))
        local = np.minimum(need[alive] / longest, 1.0) if longest else np.full(len(alive), -np.inf)
        by_coordinate = np.zeros(len(alive), dtype=bool)
        low, high = np.zeros(len(alive), dtype=np.int64), np.zeros(len(alive), dtype=np.int64)
        sharp = np.flatnonzero(local > 0)
        sorted_by: dict[int, np.ndarray] = {}
        if len(sharp) and longest:
            unit = matrix / np.maximum(norms, 1.0)[:, None]
            angle, own_angle = np.arccos(local[sharp]), np.arccos(self.cosine[alive[sharp]])
            least = np.where(own_angle + angle >= np.pi, -1.0, np.cos(np.minimum(own_angle + angle, np.pi))) - SLACK
            most = np.where(own_angle <= angle, 1.0, np.cos(own_angle - angle)) + SLACK
            focus = self.focus[alive[sharp]]
            for f in np.unique(focus).tolist():
                here = np.flatnonzero(focus == f)
                sorted_by[f] = np.argsort(unit[:, f], kind="stable")
                values = unit[sorted_by[f], f]
                low[sharp[here]], high[sharp[here]] = np.searchsorted(values, least[here]), np.searchsorted(values, most[here], side="right")
            by_coordinate[sharp] = high[sharp] - low[sharp] < SHARE * len(ids)
        for f, listed in sorted_by.items():
            mine = np.flatnonzero(by_coordinate & (self.focus[alive] == f))
            self._gathered(alive[mine], low[mine], high[mine], listed, ids, rows, matrix, own)
        mine = np.flatnonzero(~by_coordinate)
        mine = mine[np.argsort(-need[alive[mine]], kind="stable")]
        prefix = np.searchsorted(-norms, -need[alive[mine]], side="right")
        for a in range(0, len(mine), 256):
            some, n = alive[mine[a : a + 256]], int(prefix[a : a + 256].max())
            scores = (self.matrix[some] @ matrix[:n].T).astype(np.int64)
            at = np.full(len(self.rows), -1)
            at[some] = np.arange(len(some))
            itself = np.flatnonzero(own[:n] >= 0)
            itself = itself[at[own[itself]] >= 0]
            scores[at[own[itself]], itself] = NONE
            if n >= self.k and (self.floor[some] == NONE).any():
                self.floor[some] = np.maximum(self.floor[some], np.partition(scores, n - self.k, axis=1)[:, n - self.k])
            x, y = np.nonzero((scores >= self.floor[some][:, None]) & (scores > NONE))
            self._found(some[x], scores[x, y], ids[y], rows[y])
        self._take()
        return {"over": len(self.rows) - len(alive), "coordinate": int(by_coordinate.sum()), "length": len(mine)}

    def _gathered(self, queries: np.ndarray, low: np.ndarray, high: np.ndarray, listed: np.ndarray, ids: np.ndarray, rows: np.ndarray, matrix: np.ndarray, own: np.ndarray) -> None:
        """Products of each query with the candidates ``listed[low:high]``, some thousands at a time."""
        many = np.maximum(high - low, 0)
        query, place = np.repeat(np.arange(len(queries)), many), np.repeat(low - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        for a in range(0, len(query), 1 << 14):
            q, c = queries[query[a : a + (1 << 14)]], listed[place[a : a + (1 << 14)]]
            score = np.einsum("ij,ij->i", self.matrix[q], matrix[c]).astype(np.int64)
            hit = (score >= self.floor[q]) & (own[c] != q)
            self._found(q[hit], score[hit], ids[c[hit]], rows[c[hit]])


_LAST = np.iinfo(np.int64).max


def _ids(column: pa.Array) -> np.ndarray:
    """Ids as integers, a null as the greatest one, so that it comes last among ties."""
    return column.fill_null(_LAST).to_numpy(zero_copy_only=False)


def top_products(rows: DataFrame, is_query: Callable[[Column], Column], k: int = 10, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: of each query the ``k`` greatest integer products with other rows.

    A row is a query if ``is_query`` of its id holds.
    Ties go to the smaller id, a null id comes last.  Vectors that are null or
    hold null or non-finite components take no part, nor do those with a length
    of 2**31 or more after scaling, whose scores might not fit 64 bits.  An
    empty vector has the score 0 with any other; of vectors that differ in
    dimensions the shorter one counts as filled up with zeros.  Repeated rows
    are queries and candidates of their own: a row is no candidate of itself
    but of its copies.  An empty table, or none but the query, gives no rows.
    Other columns take no part.  Queries are collected in blocks of
    ``BLOCK_BYTES``.
    """
    spark, lasting, tables = rows.sparkSession, Tables(rows.sparkSession), Tables(rows.sparkSession)
    given = rows.select(F.col(id_col), F.col(vector_col))
    found = tables.written(integer_vectors(given, id_col=id_col, vector_col=vector_col, scale=scale), "vectors")
    told = found.agg(F.max("norm"), F.max(F.octet_length("v")), F.count("*")).first()
    longest, width = told[0] or 0.0, max(1, (told[1] or 0) // 8)
    kind = np.float64 if longest * longest < EXACT else np.int64
    order = [F.desc("norm"), F.col("row")]
    placed = found.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("bucket", F.expr(f"monotonically_increasing_id() div {BUCKET}"))
    buckets = tables.written(placed, "buckets")

    seeds = found.orderBy(*order).limit(max(1, min(SEEDS, SEED_BYTES // (8 * width)))).toArrow()
    seed_rows, seed_ids, seed_norms = seeds.column("row").to_numpy(), _ids(seeds.column("id").combine_chunks()), seeds.column("norm").to_numpy()
    seeds = spark.sparkContext.broadcast((seed_ids, seed_rows, seeds.column("v").to_pylist(), seed_norms))

    def first_thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, at, vectors, norms = seeds.value
        matrix = _matrix(vectors, width, kind)
        for batch in batches:
            if batch.num_rows:
                search = Search(batch.column(0).to_numpy(), _matrix(batch.column(2).to_pylist(), width, kind), batch.column(3).to_numpy(), np.full(batch.num_rows, NONE), k)
                search.meet(ids, at, matrix, norms)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(search.floor)], names=["row", "id", "v", "norm", "threshold"])

    asked = found.where(is_query(F.col("id")))
    asked = tables.written(asked.mapInArrow(first_thresholds, "row long, id long, v binary, norm double, threshold long"), "queries")
    blocks = max(1, -(-asked.count() * 8 * width // BLOCK_BYTES))
    out = []
    for n in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == n).toArrow()
        if not part.num_rows:
            continue
        block = spark.sparkContext.broadcast((part.column("row").to_numpy(), part.column("v").to_pylist(), part.column("norm").to_numpy(), part.column("threshold").to_numpy()))
        rows_, _, norms_, floors_ = block.value
        least = float(np.where(floors_ > 0, floors_ / np.maximum(norms_, 1e-300), 0.0).min()) * (1 - SLACK)

        def search(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            rows, vectors, norms, floors = block.value
            state = Search(rows, _matrix(vectors, width, kind), norms, floors, k)
            for ids, at, own, sizes in _bucketed(batches):
                state.meet(ids, at, _matrix(own, width, kind), sizes)
            query, score, ids, at = state.best
            if len(query):
                ids = pa.array(ids, mask=ids == _LAST)
                yield pa.RecordBatch.from_arrays([pa.array(rows[query]), pa.array(score), ids, pa.array(at)], names=["query", "score", "vec_id", "row"])

        near = buckets.where(F.col("norm") >= least).select("id", "row", "v", "norm", "bucket")
        out.append(tables.written(near.mapInArrow(search, "query long, score long, vec_id long, row long"), "products"))
    if not out:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    merged = reduce(DataFrame.unionByName, out).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    named = asked.select(F.col("row").alias("query"), F.col("id").alias("query_id"))
    out = lasting.written(merged.join(named, "query").select("query_id", "rank", "vec_id", "score"), "top")
    tables.remove()
    return out


def _bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]]:
    """ids, rows, vectors and norms of one bucket after the other, from rows in the order of buckets."""
    held, number = [], None

    def bucket():
        table = pa.Table.from_batches(held).combine_chunks()
        return _ids(table.column(0).combine_chunks()), table.column(1).to_numpy(), table.column(2).to_pylist(), table.column(3).to_numpy()

    for batch in batches:
        numbers = batch.column(4).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
        for a, b in zip(edges[:-1], edges[1:]):
            if a == b:
                continue
            if held and numbers[a] != number:
                yield bucket()
                held = []
            number = numbers[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield bucket()
