"""The near-duplicate stage against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tracelake.llm import arrays, neardup, simhash
from tracelake.llm.common import Tables


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_drop_near_duplicates(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, copies = [], set()
    for k in range(60):
        text = [word() for _ in range(rng.choice((40, 150, 600)))]
        rows.append((10 * k, " ".join(text)))
        if k % 3 == 0:
            rows.append((10 * k + 1, "\n".join(text).upper()))
            copies.add(10 * k + 1)
        if k % 4 == 0 and len(text) > 100:
            for j in range(0, len(text), 120):
                text[j] = word()
            rows.append((10 * k + 2, " ".join(text)))
            copies.add(10 * k + 2)
    rows += [(5000, ""), (5001, None), (None, rows[0][1]), rows[7]]
    for block in (neardup.BLOCK, 7):
        monkeypatch.setattr(neardup, "BLOCK", block)
        docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, node long, component long")
        got = neardup.drop_near_duplicates(docs)
        assert got.columns == docs.columns
        assert sorted(r.doc_id for r in got.collect()) == sorted({i for i, _ in rows if i is not None} - copies - {5001})
    assert neardup.drop_near_duplicates(docs.limit(0)).count() == 0


def test_shingles_of_few_words_in_all(monkeypatch):
    """Chunks and batches with fewer words than a shingle has, as the last one of a partition may be."""
    for n in (1, 3, 5):
        for total in range(2 * n + 1):
            for cut in range(total + 1):
                words = [f"w{k}" for k in range(total)]
                for texts in ([" ".join(words[:cut]), None, " ".join(words[cut:])], [" ".join(words)], words):
                    for limit in (1, 1 << 20):
                        monkeypatch.setattr(arrays.chunks, "__defaults__", (limit,))
                        got = arrays.shingle_sets(texts, n)
                        assert [len(x) for x in got] == [min(1, len((t or "").split())) if len((t or "").split()) < n else len((t or "").split()) - n + 1 for t in texts]


def test_a_batch_of_few_words(spark):
    docs = spark.createDataFrame([(1, "a b", 7), (2, "c", 8), (3, "", 9), (4, "A B", 7)], "doc_id long, text string, __row int").coalesce(1)
    got = neardup.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a b", 7), (2, "c", 8), (3, "", 9)]


def test_repeated_lines_do_not_decide_near_duplicates(spark):
    words = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    line = "\n".join([words("line", 10)] * 10)
    body = words("c", 100)
    texts = [words("a", 60) + "\n" + line, words("b", 60) + "\n" + line, body + "\nlast\n", body + "\n" + "\n".join([words("last", 3)] * 30)]
    kept = {r.doc_id for r in neardup.drop_near_duplicates(table(spark, texts)).collect()}
    assert kept == {0, 1, 2}  # similarity 0.08 and 0.92


def test_no_pair_at_the_similarity_is_missed_and_none_below_is_linked(spark):
    words = lambda k, n: [f"w{k}x{j}" for j in range(n)]
    texts, kept = [], set()
    for k in range(200):
        kept.add(len(texts))  # 4 of 5 shingles
        texts += [" ".join(words(k, 8)), " ".join(words(k, 9))]
    for k in range(200, 260):
        base = words(k, 304)  # 300 shingles: 34 changed give 266 / 334 = 0.796, 33 give 267 / 333 = 0.802
        kept |= {len(texts), len(texts) + 1}
        texts += [" ".join(base), " ".join(["new"] + base[1:271] + [f"n{k}x{j}" for j in range(33)])]
        kept.add(len(texts))
        texts += [" ".join(words(f"{k}y", 304)), " ".join(["new"] + words(f"{k}y", 304)[1:272] + [f"n{k}x{j}" for j in range(32)])]
    assert {r.doc_id for r in neardup.drop_near_duplicates(table(spark, texts)).collect()} == kept


def near_by_hand(docs):
    """Ids that stay, by all pairs with a common shingle."""
    sets = []
    for i, text in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent, holders = list(range(len(docs))), defaultdict(list)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in enumerate(sets):
        for j in {j for x in s or {None} for j in holders[x]}:
            both = len(s & sets[j])
            if s == sets[j] or both and 10 * both >= 8 * (len(s) + len(sets[j]) - both):
                parent[root(k)] = root(j)
        for x in s or {None}:
            holders[x].append(k)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[root(k)] = min(i, least.get(root(k), i))
    return sorted(least.values())


def test_given_documents_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = neardup.drop_near_duplicates(docs)
    assert sorted(r.doc_id for r in got.collect()) == near_by_hand([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def star(n, changes, seed):
    """A text of 100 words and copies of it that are like it, but mostly not like each other."""
    rng = random.Random(seed)
    base = [f"b{seed}x{k}" for k in range(100)]
    out = [base]
    for k in range(n):
        own = list(base)
        at = rng.sample(range(100), changes)
        for j in at:
            own[j] = f"c{seed}x{k}x{j}"
        out.append(own)
    rng.shuffle(out)
    return [" ".join(x) for x in out]


@pytest.mark.parametrize("sizes", [(1024, 512, 32), (16, 8, 2), (1000, 16, 3)])
def test_large_groups_are_those_of_brute_force(spark, monkeypatch, sizes):
    for name, value in zip(("BLOCK", "CHUNK", "HUBS"), sizes):
        monkeypatch.setattr(neardup, name, value)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = star(80, 2, 1) + star(30, 3, 2) + star(40, 1, 3) + [f"{passage} " + " ".join(f"t{i}x{k}" for k in range(20)) for i in range(40)]
    docs = list(enumerate(texts))
    expected = near_by_hand(docs)
    got = neardup.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == expected and 30 < len(expected) < 150


def test_rows_sent_grow_with_the_rows_alone(spark):
    """Rows of shards for three sizes: the same number for each text."""
    for n in (50, 100, 200):
        rows = spark.createDataFrame([(k, k, f"a{k} b{k} c{k} d{k} e{k} f{k}") for k in range(n)], "__row long, __id long, text string")
        assert sum(len(r["keys"]) for r in neardup.sketches(rows, 5).collect()) == neardup.KEYS * n


def test_exact_links_are_those_of_brute_force(spark, monkeypatch):
    rng, rows = np.random.default_rng(8), []
    for k in range(30):
        base = rng.integers(0, 1 << 63, 40).astype(np.uint64)
        for j in range(2 + 20 * (k == 0)):
            own = base.copy()
            n = int(rng.integers(0, 10))
            own[rng.permutation(40)[:n]] = rng.integers(0, 1 << 63, n).astype(np.uint64)
            rows.append((100 * k + j, k, np.unique(own)))
    parent = {n: {n} for n, _, _ in rows}
    for n, c, x in rows:
        for m, d, y in rows:
            i = len(set(x.tolist()) & set(y.tolist()))
            if n < m and c == d and 10 * i >= 8 * (len(x) + len(y) - i) and parent[n] is not parent[m]:
                parent[n] |= parent[m]
                for z in parent[m]:
                    parent[z] = parent[n]
    expected = {n: min(g) for n, g in parent.items() if len(g) > 1}
    sets = spark.createDataFrame([(n, c, bytearray(x.tobytes()), len(x)) for n, c, x in rows], "node long, component long, hashes binary, n_shingles long")
    for exact, columns in ((neardup.CHUNK, neardup.COLUMNS), (5, 16)):
        monkeypatch.setattr(neardup, "CHUNK", exact)
        monkeypatch.setattr(neardup, "COLUMNS", columns)
        found = simhash.components(neardup.exact_links(sets, sets.select("component", "n_shingles"), 0.8, Tables(spark))).collect()
        assert {r.node: r.component for r in found} == expected


def test_trees_link_fingerprints_and_the_stage_uses_them(spark, monkeypatch):
    """The stage had no vantage-point trees."""
    rng, seen = random.Random(12), []
    bases = [rng.getrandbits(64) for _ in range(20)]
    fps = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(5))) for b in bases for _ in range(6)] + bases[:5]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(k, signed(x)) for k, x in enumerate(fps)], "node long, f0 long")
    found = {r.node: r.component for r in simhash.components(neardup.tree_links(nodes, Tables(spark))).collect()}
    label = np.arange(len(fps))
    pairs = [(i, j) for i, x in enumerate(fps) for j, y in enumerate(fps[:i]) if (x ^ y).bit_count() <= neardup.RADIUS]
    simhash._unite(label, *map(np.array, zip(*pairs)))
    assert [found.get(k, k) for k in range(len(fps))] == simhash._root(label, np.arange(len(fps))).tolist()
    monkeypatch.setattr(neardup, "near_links", lambda *x: seen.append(x) or simhash.near_links(*x))
    assert neardup.drop_near_duplicates(table(spark, ["a b c d e f", "A b c d e f", "x"])).count() == 2 and len(seen) == 1


def test_links_get_fewer_from_round_to_round(spark, monkeypatch):
    """All links were joined in every round, 525,066 rows for about 42,000 links of a corpus with one large group."""
    tables = []
    monkeypatch.setattr(simhash, "written", lambda df, label, f=simhash.written: tables.append((label, f(df, label))) or tables[-1][1])
    monkeypatch.setattr(simhash, "remove_path", lambda *x: None)
    order = random.Random(13).sample(range(100, 220), 120)
    links = [(900, k) for k in range(60)] + list(zip(order, order[1:])) + [(400, 400), (500, 501), (501, 500)]
    got = {r.node: r.component for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {900: 0} | {k: 0 for k in range(60)} | {k: 100 for k in order} | {500: 500, 501: 500}
    sizes = [df.count() for label, df in tables if label == "links"]
    assert sizes[0] == 180 and sizes[-1] == 0 and all(b < a for a, b in zip(sizes, sizes[1:])) and sum(sizes) < 2 * sizes[0]
    assert simhash.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
