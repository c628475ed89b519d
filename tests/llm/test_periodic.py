"""Runs of words against a search through all periods."""

import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from tracelake.llm import periodic, queries


def runs_by_hand(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                part = w[i : i + length]
                if not any(all(part[t] == part[t + p] for t in range(length - p)) for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


def row_by_hand(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n and doc_id is not None:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = runs_by_hand(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    digests = [sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{length},{q}\n" for s, length, q in found), " ".join(x for i, x in enumerate(w) if i not in gone))]
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *digests)


def pieces(rng, words, size):
    w = []
    while len(w) < size:
        if rng.random() < 0.5:
            unit = [rng.randrange(words) for _ in range(rng.choice([1, 2, 3, 5, 8, 15, 16, 17, 31, 32, 33, 40]))]
            w += (unit * rng.randrange(1, 7))[: -rng.randrange(1, len(unit) + 1)]
        else:
            w.append(rng.randrange(words))
    return w


@pytest.mark.parametrize("words", [1, 2, 3, 6, 40, 1000])
def test_runs_of_planted_texts(words):
    rng = random.Random(words)
    for _ in range(150):
        w = pieces(rng, words, rng.choice([6, 30, 120, 400]))
        assert periodic.runs(np.array(w, dtype=np.int32)) == runs_by_hand(w)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=80), st.integers(1, 20), st.lists(st.integers(0, 4), min_size=1, max_size=25))
def test_runs_of_any_text(head, times, unit):
    w = head + unit * times + head
    assert periodic.runs(np.array(w, dtype=np.int32)) == runs_by_hand(w) if w else True


def test_segments_are_stable():
    rng = random.Random(2)
    for _ in range(100):
        w = np.array(pieces(rng, 12, 200))
        found = list(periodic.segments(w))
        for a, b in found:
            assert b - a >= 6 and np.unique(w[a:b], return_counts=True)[1].min() >= 4
        inside = {i for a, b in found for i in range(a, b)}
        assert all(set(range(s, s + n)) <= inside for s, n, _ in runs_by_hand(w.tolist()))


def test_long_repeats_take_little_time():
    """A quarter of a million words that repeat in the worst ways; a scan of all lags would take hours."""
    a, b = [0], [0, 1]
    while len(b) < 250_000:
        a, b = b, b + a
    unit = random.Random(3)
    long = [unit.randrange(9) for _ in range(50_000)]
    assert periodic.runs(np.zeros(250_000, dtype=np.int32)) == [(0, 250_000, 1)]
    assert periodic.runs(np.array(b, dtype=np.int32)) == []  # exponents of the Fibonacci word stay below 3.7
    found = periodic.runs(np.array(long * 5, dtype=np.int32))
    assert (0, 250_000, 50_000) in found


def test_words_are_cut_at_any_place(monkeypatch):
    text = "ab\x0bc\x0c\rd é f  g\n" * 5
    for part in (1, 3, 7, 1 << 20):
        monkeypatch.setattr(periodic, "PART", part)
        ids, words = periodic.word_ids(text.encode())
        assert [words[k].decode() for k in ids] == re.findall(r"[^\x20\x09-\x0D]+", text)


def test_query_by_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()]
    got = queries.op11_periodic_runs(spark, f"{DATA}/sf0.001").collect()
    assert sorted(map(tuple, got)) == sorted(row_by_hand(*d) for d in docs)
    assert any(r.n_runs for r in got)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "a " * 7), (4, "a b " * 4), (4, "a b " * 4), (5, "x y " * 6), (6, "a a a a a")]
    rows += [(k, f"w{k} v " * 30 + "end") for k in range(100, 160)]
    docs = spark.createDataFrame([(i, t, "r", 1) for i, t in rows], "doc_id long, text string, runs string, id int")
    got = periodic.periodic_runs(periodic.with_planted_runs(docs))
    assert got.columns == ["doc_id", "runs", "collapsed"]
    found = sorted(repr((r.doc_id, len(r.runs), sha256(r.collapsed.encode()).hexdigest())) for r in got.collect())
    assert found == sorted(repr((x[0], x[1], x[-1])) for x in (row_by_hand(*r) for r in rows))
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
