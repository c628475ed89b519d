"""Exact search against all products."""

import math
import random

import numpy as np
import pytest
from tracelake.llm import retrieval


def top_by_hand(rows, every, k):
    """Rows are (id, vector)."""
    ints = []
    for n, (i, v) in enumerate(rows):
        if v is not None and all(x is not None and math.isfinite(x) and abs(1024 * x) < 2**31 for x in v):
            w = [math.floor(1024 * float(x)) for x in v]
            if sum(x * x for x in w) < 2**62:
                ints.append((n, i, w))
    out = []
    for n, i, q in ints:
        if i is not None and i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, c)), j is None, j or 0, j) for m, j, c in ints if m != n)
            out += [(i, rank + 1, x[3], -x[0]) for rank, x in enumerate(scored[:k])]
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, row int, score string")


def got(spark, rows, every=10, k=10):
    found = retrieval.top_products(table(spark, rows), lambda i: i % every == 0, k)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, found.collect()), key=repr)


def vectors(seed, n, width, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, width))
    x = centres[rng.integers(0, 8, n)] + 0.2 * rng.normal(size=(n, width))
    x = x / np.linalg.norm(x, axis=1, keepdims=True) * np.exp(spread * rng.normal(size=(n, 1)))
    return [(k, [float(a) for a in v]) for k, v in enumerate(x)]


@pytest.mark.parametrize("spread", [0.0, 1.0, 3.0])
def test_top_is_that_of_all_products(spark, monkeypatch, spread):
    monkeypatch.setattr(retrieval, "BUCKET", 64)
    monkeypatch.setattr(retrieval, "SEEDS", 50)
    monkeypatch.setattr(retrieval, "MOST_HELD", 100)
    rows = vectors(1, 700, 6, spread)
    random.Random(1).shuffle(rows)
    assert got(spark, rows) == top_by_hand(rows, 10, 10)
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 20 * 48)  # several blocks of queries
    assert got(spark, rows, 10, 3) == top_by_hand(rows, 10, 3)


def test_edges(spark):
    one = [0.5, -0.25, 1.0]
    rows = [(0, one), (0, one), (10, [1.0, 1.0, 1.0]), (11, None), (12, [None, 1.0, 1.0]), (13, [float("nan"), 1.0, 1.0]), (14, [float("inf"), 1.0, 1.0])]
    rows += [(20, [0.0, 0.0, 0.0]), (21, []), (30, [1.0]), (22, [1.0, 2.0, 3.0, 4.0]), (None, one), (None, [-1.0, 0.0, -0.001]), (40, [-1.0, -1.0, -1.0]), (23, [1e300, 0.0, 0.0]), (24, [2.0e6, 2.0e6, 0.0])]
    rows += [(k, one) for k in range(100, 120)]  # ties go to the smaller id
    assert got(spark, rows) == top_by_hand(rows, 10, 10)
    assert got(spark, [(0, one)]) == [] and got(spark, []) == []


def test_products_beyond_53_bits_are_exact(spark):
    rng = random.Random(4)
    rows = [(k, [rng.uniform(-1, 1) * 1e6 for _ in range(4)]) for k in range(120)]
    assert got(spark, rows) == top_by_hand(rows, 10, 10)


def test_buckets_choose_what_prunes():
    """Near neighbours in short vectors: buckets of short ones are passed over, sharp ones go by coordinates, loose ones by length."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 8))
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    x[:2000] = np.sign(x[:2000]) * (np.abs(x[:2000]) == np.abs(x[:2000]).max(axis=1, keepdims=True)) + 0.01 * x[:2000]  # along one axis each
    x = np.floor(1024 * x * np.exp(0.1 * rng.normal(size=(4000, 1))))
    norms = np.linalg.norm(x, axis=1)
    order = np.argsort(-norms)
    queries = order[::40]
    search = retrieval.Search(queries, x[queries], norms[queries], np.full(len(queries), retrieval.NONE), 5)
    seen = {"over": 0, "coordinate": 0, "length": 0}
    for a in range(0, 4000, 250):
        part = order[a : a + 250]
        for name, n in search.meet(part, part, x[part], norms[part]).items():
            seen[name] += n
    assert min(seen.values()) > 0 and sum(seen.values()) == 16 * len(queries)
    query, score, ids, _ = search.best
    for n, q in enumerate(queries):
        products = sorted((-int(x[q] @ x[c]), int(c)) for c in range(4000) if c != q)[:5]
        assert list(zip((-score[query == n]).tolist(), ids[query == n].tolist())) == products
