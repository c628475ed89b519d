"""Each operator against brute force on whole small tables, and its edge cases."""

import bisect
import functools
import math
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from tracelake.llm import classifier, decontam, linededup, packing, perplexity, queries, simhash, sstable, tokencount, tokens, urlfilter

SF = "/root/testdata/sf0.001"
BYTES, WORDS = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, "   ", "\n\n", "a", "x  y\n z", "a\u3000b \u00a0 c", "\x1c \x85", "<|endoftext|> and <|startoftext|>", "İstanbul ΣΑΣ ½ ² 漢字 🙂", "don't we'll I'M", "a \nb\n c\n \nd", "w " * 5000, "\u0301e\ufb01"]


def table(spark, texts, lang="en", source="s"):
    return spark.createDataFrame([(i, t, lang, source, 0) for i, t in enumerate(texts)], DOCS)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def odd(spark):
    """Odd texts with null and repeated ids, null languages and sources, and clashing columns."""
    rows = [(i, t, None if i % 3 else "en", None if i % 2 else "s", i, i, "x") for i, t in enumerate(ODD)]
    rows += [rows[4], (None, "no id", "en", "s", 1, 1, "x"), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS + ", row long, host string")


def empty(spark):
    return spark.createDataFrame([], DOCS)


# ------------------------------------------------------------------ perplexity


def base_by_regex(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    count, hit, seen, dup = Counter(windows), set(), set(), 0
    for k, w in enumerate(windows):
        if count[w] > 1:
            hit |= {k, k + 1, k + 2}
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def units_of(text):
    coded = text.encode("utf-16-le")
    return [0xFFFF] * 3 + [int.from_bytes(coded[k : k + 2], "little") for k in range(0, len(coded), 2)]


def kneser_ney_by_hand(texts):
    """The log probability of a unit after three others, by a model of ``texts``."""
    counts = {4: Counter(tuple(u[k - 3 : k + 1]) for u in map(units_of, texts) for k in range(3, len(u)))}
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discount, total, left = {}, defaultdict(Counter), defaultdict(Counter)
    for n in (1, 2, 3, 4):
        cc, d = Counter(counts[n].values()), {}
        for k in (1, 2, 3):
            try:
                d[k] = k - (k + 1) * cc[1] / (cc[1] + 2 * cc[2]) * cc[k + 1] / cc[k]
            except ZeroDivisionError:
                d[k] = 0
            if not 0 < d[k] <= k:
                d[k] = k / 2
        discount[n] = d
        for g, c in counts[n].items():
            total[n][g[:-1]] += c
            left[n][g[:-1]] += d[min(c, 3)]

    def p(g):
        n = len(g)
        lower = p(g[1:]) if n > 1 else 1 / (len(counts[1]) + 1)
        if not total[n][g[:-1]]:
            return lower
        c = counts[n][g]
        own = (c - discount[n][min(c, 3)]) / total[n][g[:-1]] if c else 0
        return own + left[n][g[:-1]] / total[n][g[:-1]] * lower

    return lambda g: math.log(p(g))


def log_perplexities_by_hand(texts):
    """Of each text by the model of the texts in the other half; the half is the lowest bit of the text's hash."""
    half = [xxh64_intdigest(t.encode(), 42) & 1 for t in texts]
    log = [kneser_ney_by_hand([t for t, h in zip(texts, half) if h != k]) for k in (0, 1)]
    units = list(map(units_of, texts))
    return [-sum(log[h](tuple(u[k - 3 : k + 1])) for k in range(3, len(u))) / (len(u) - 3) if len(u) > 3 else None for u, h in zip(units, half)]


def test_perplexity_is_that_of_a_model_by_hand(spark, monkeypatch):
    slices, arrays = [], perplexity._arrays
    monkeypatch.setattr(perplexity, "_arrays", lambda model: slices.append(1) or arrays(model))
    docs = documents(spark).where("lang = 'en'").collect()
    texts = [r.text for r in docs][:60] + ["🙂 x", "aaaa", "漢字 and \0 units that no other text has", ""]
    expected = log_perplexities_by_hand(texts)
    read, score = [], perplexity._score
    monkeypatch.setattr(perplexity, "_score", lambda docs, models: read.append(len(models)) or score(docs, models))
    for limit, at_once in (10**6, 10**6), (15000, 10**6), (15000, 300):  # whole, in slices, in slices for a few texts at a time
        monkeypatch.setattr(perplexity, "SCORED_AT_ONCE", at_once)
        got = perplexity.quality_rules(table(spark, texts), broadcast_ngrams=limit).orderBy("doc_id").collect()
        assert [r.log_ppl for r in got] == [x if x is None else pytest.approx(x, abs=1e-5) for x in expected]
        inside = sorted(x for x, r in zip(expected, got) if not r.base_failed)
        q1, q3 = (inside[max(0, math.ceil(q * len(inside)) - 1)] for q in (0.25, 0.75))
        for r, text in zip(got, texts):
            assert tuple(r)[1:6] == base_by_regex(text)
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert (r.low, r.high) == pytest.approx((q1 - 3 * (q3 - q1), q3 + 3 * (q3 - q1)), abs=1e-4)
            assert r.kept == (not r.base_failed and r.low <= r.log_ppl <= r.high)
    assert len(slices) >= 5 and len(read) == 3 and read[0] == 1 < read[1]  # each model goes over the texts once


def test_bands_are_those_of_a_language(spark):
    """Rows of several languages are scored and judged as if each language were alone, and junk in each goes."""
    docs = documents(spark).where("lang is not null and length(text) > 0").select("doc_id", "text", "lang", "source", "n_chars")
    rows = {r.doc_id: tuple(r)[1:] for r in perplexity.quality_rules(docs).collect()}
    for lang in [r.lang for r in docs.select("lang").distinct().collect()]:
        alone = perplexity.quality_rules(docs.where(F.col("lang") == lang)).collect()
        assert all(rows[r.doc_id] == pytest.approx(tuple(r)[1:], abs=1e-6) for r in alone)


def test_copies_are_scored_by_what_they_are_no_part_of(spark):
    copies = table(spark, ["one text " * 30] * 5)
    assert all(r.log_ppl is None and r.kept == (not r.base_failed) for r in perplexity.quality_rules(copies).collect())


def test_perplexity_edges(spark):
    got = perplexity.quality_rules(odd(spark)).collect()
    assert Counter(tuple(r)[1:6] for r in got) == Counter(base_by_regex(r.text) for r in odd(spark).collect())
    assert perplexity.quality_rules(empty(spark)).count() == 0
    assert perplexity.base_counts("a b c a b c a b") == base_by_regex("a b c a b c a b")


def test_junk_leaves_the_band_and_clean_text_does_not(spark):
    docs = documents(spark).where("lang = 'en' and text not like '%!!%' and text not like '%$$$%' and text not like '%|%'")
    clean = [r.text for r in docs.collect() if len(r.text.split()) >= 50]
    junk = [" ".join(w.upper() + "!!" for w in clean[0].split()), " ".join("#$%&"[k % 4] * 9 for k in range(80))]
    got = {r.doc_id: r for r in perplexity.quality_rules(table(spark, clean + junk)).collect()}
    assert not got[len(clean)].kept and not got[len(clean) + 1].kept
    scored = [r for i, r in got.items() if i < len(clean) and not r.base_failed]
    assert sum(r.kept for r in scored) >= 0.97 * len(scored)


# --------------------------------------------------------------- contamination


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def hits_by_hand(docs, tests):
    windows = defaultdict(set)
    for item, text in tests:
        w = words_of(text)
        size = min(10, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[k : k + size])].add(item)
    out = []
    for doc, text in docs:
        w, hit, items = words_of(text), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (found := windows.get(tuple(w[k : k + size]))) is not None:
                    hit |= set(range(k, k + size))
                    items |= found
        out.append((doc, len(w), sorted(hit), sorted(str(i) for i in items if i is not None)))
    return sorted(out, key=str)


def matches_by_hand(docs, tests):
    """Verbatim matches of a window or more, each as far to both sides as it goes."""
    out = []
    for doc, text in docs:
        w, found = words_of(text), []
        begins = defaultdict(list)
        for k, x in enumerate(w):
            begins[x].append(k)
        for item, t in tests:
            q = words_of(t)
            size = min(10, len(q))
            for j in range(len(q) - size + 1 if q else 0):
                for p in begins[q[j]]:
                    if w[p : p + size] != q[j : j + size] or p and j and w[p - 1] == q[j - 1] and len(q) > size:
                        continue
                    n = size
                    while p + n < len(w) and j + n < len(q) and w[p + n] == q[j + n]:
                        n += 1
                    found.append((p, n, None if item is None else str(item), j))
        out.append((doc, len(w), sorted(found, key=str)))
    return sorted(out, key=str)


def test_the_longest_match_is_over_all_items(spark):
    a = [f"a{k}" for k in range(60)]
    tests = spark.createDataFrame([("A", " ".join(a[:30] + ["x"])), ("B", " ".join(a)), ("C", " ".join(a[:12])), ("D", " ".join(a[20:50] * 2))], "item_id string, text string")
    docs = spark.createDataFrame([(1, "z " + " ".join(a) + " z"), (2, " ".join(a[20:50] * 3)), (3, " ".join(a[:9]))], "doc_id long, text string")
    for options in ({}, {"block_bytes": 200}):
        got = {r.doc_id: [tuple(m) for m in r.matches] for r in decontam.overlaps(docs, tests, **options).collect()}
        assert got[1][0] == (1, 60, "B", 0) and set(got[1][1:]) == {(1, 30, "A", 0), (1, 12, "C", 0), (21, 30, "D", 0), (21, 30, "D", 30)}
        assert got[2][:2] == [(0, 60, "D", 0), (30, 60, "D", 0)] and got[3] == []


def test_suffix_array_is_sorted():
    import numpy as np

    rng = np.random.default_rng(2)
    for n, depth in ((0, 16), (1, 16), (400, 1), (400, 4), (400, 16)):
        numbers, cuts = rng.integers(1, 4, n), sorted({*rng.integers(0, n + 1, 9).tolist(), n})
        ends = np.array([next(c for c in cuts if c > k) for k in range(n)], dtype=np.int64)
        order = decontam.suffix_array(numbers, ends, depth)
        words = [tuple(numbers[k : min(k + depth, ends[k])].tolist()) for k in order]
        assert sorted(order.tolist()) == list(range(n)) and words == sorted(words)


def test_the_index_is_small():
    import random

    rng = random.Random(3)
    items = [(str(k), " ".join(rng.choice(["alpha", "beta", "of", "gamma7"]) + str(rng.randint(0, 10**6)) for _ in range(200))) for k in range(500)]
    index = decontam.TestIndex(items, 10)
    size = index.words.nbytes + index.ends.nbytes + sum(x.nbytes for x in index.suffixes.values())
    assert size < 3 * sum(len(t) for _, t in items)


def test_overlaps_are_those_of_brute_force(spark):
    long_item = " ".join(f"q{k}" for k in range(30))
    docs = [(r.doc_id, r.text) for r in documents(spark).collect()]
    docs += [(1000, "x " + long_item.upper() + " q1 tiny ITEM"), (1001, "tiny"), (1002, None), (1003, ""), (1000, "tiny item"), (None, "tiny item"), (1004, " ".join(long_item.split()[:9]))]
    tests = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    tests += [(500, long_item), (501, "Tiny item"), (502, ""), (503, None), (None, "tiny"), (504, long_item + " end")]
    d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(tests, "item_id long, text string")
    expected = hits_by_hand(docs, tests)
    for options in ({}, {"block_bytes": 4000}, {"shard_bytes": 5000}):
        got = decontam.overlaps(d, t, **options).collect()
        assert sorted(((r.doc_id, r.n_words, r.places, r["items"]) for r in got), key=str) == expected
        assert sorted(((r.doc_id, r.n_words, sorted(map(tuple, r.matches), key=str)) for r in got), key=str) == matches_by_hand(docs, tests)
    best = {r.doc_id: r for r in got if r.n_words > 30}[1000].matches[0]
    assert tuple(best) == (1, 30, "500", 0)
    kept = decontam.drop_contaminated(d, t)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((x[0] for x in expected if not x[2]), key=str)
    assert decontam.drop_contaminated(d, t, block_bytes=4000).count() == kept.count() and kept.columns == d.columns


def test_overlaps_edges(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontam.overlaps(odd(spark), none).collect()
    assert len(got) == odd(spark).count() and not any(r.places for r in got)
    assert decontam.overlaps(empty(spark), none).count() == 0 == decontam.drop_contaminated(empty(spark), none).count()
    assert decontam.drop_contaminated(odd(spark), none).count() == len(got)


# ------------------------------------------------------------------ classifier


def test_classifier_on_held_out_rows(spark):
    big = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    got = classifier.quality_scores(docs, labels)
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert got.count() == docs.count() and {r.held_out for r in rows} == {True}
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    assert all(r.predicted for r in rows if r.quality)
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.collect())
    # labels of the held-out fold, the source and the language make no difference
    other = classifier.quality_scores(docs.selectExpr("doc_id", "text", "'x' as lang", "'y' as source"), labels.where("crc32(cast(doc_id as string)) % 4 <> 2"))
    assert got.join(other.select("doc_id", other["score"].alias("s2")), "doc_id").where("abs(score - s2) > 1e-9").count() == 0


MASK = (1 << 64) - 1


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def buckets_by_hand(text):
    """Words, words that repeat the one before, and runs of three and four bytes, each as a bucket."""
    data, n = text.encode(), classifier.BUCKETS
    words = [w for w in re.split(rb"[\x00\x09-\x0d\x20]+", data) if w]
    out = [mixed(sum((c + 1) * mixed((k + 1) * 0x9E3779B97F4A7C15 & MASK) for k, c in enumerate(w)) & MASK) % n for w in words]
    out += [1 for a, b in zip(words, words[1:]) if a == b]
    for size, odd_ in ((3, 0x9E3779B1), (4, 0x85EBCA77)):
        grams = [int.from_bytes(data[k : k + size], "big") for k in range(max(0, len(data) + 1 - size))]
        out += [(g * odd_ & 0xFFFFFFFF) >> (32 - n.bit_length() + 1) for g in grams]
    return out


def test_classifier_is_that_by_hand():
    """Averaging, softmax and each step of gradient descent, one number after the other."""
    import numpy as np

    texts = ["good calm words", "good good words here", "$$ !! ##", "spam spam $$", "é ü calm", "x"]
    labels = [1, 1, 0, 0, 1, 0]
    weights, bias = classifier._train(texts, labels)
    rng = np.random.default_rng(7)
    d = classifier.DIMENSION
    start = rng.uniform(-1 / d, 1 / d, (classifier.BUCKETS, d)).astype(np.float32)
    vectors, layer, base = {}, [[0.0, 0.0] for _ in range(d)], [0.0, 0.0]
    done, steps = 0, classifier.EPOCHS * len(texts)
    for _ in range(classifier.EPOCHS):
        for k in rng.permutation(len(texts)):
            own = Counter(buckets_by_hand(texts[k]))
            rate = classifier.RATE * (1 - done / steps)
            done += 1
            for b in own:
                vectors.setdefault(b, [float(x) for x in start[b]])
            total = sum(own.values())
            mean = [sum(n / total * vectors[b][j] for b, n in own.items()) for j in range(d)]
            logits = [sum(mean[j] * layer[j][c] for j in range(d)) + base[c] for c in (0, 1)]
            odds = [math.exp(x - max(logits)) for x in logits]
            slope = [x / sum(odds) - (c == labels[k]) for c, x in enumerate(odds)]
            back = [sum(layer[j][c] * slope[c] for c in (0, 1)) for j in range(d)]
            for c in (0, 1):
                for j in range(d):
                    layer[j][c] -= 0.1 * rate * mean[j] * slope[c]
                base[c] -= 0.01 * rate * slope[c]
            for b, n in own.items():
                for j in range(d):
                    vectors[b][j] -= rate * n / total * back[j]
    assert abs(bias - (base[1] - base[0])) < 1e-3
    for b, v in vectors.items():
        assert abs(weights[b] - sum(v[j] * (layer[j][1] - layer[j][0]) for j in range(d))) < 1e-2 * max(1, abs(weights[b]))
    unseen = ["good spam", "", None, "new text of calm words", "$$"]
    for text, got in zip(unseen, classifier.score(unseen, weights, bias)):
        own = buckets_by_hand(text or "")
        assert abs(got - 1 / (1 + math.exp(-(bias + (sum(float(weights[b]) for b in own) / len(own) if own else 0))))) < 1e-9
    assert [x >= 0.5 for x in classifier.score(texts, weights, bias)] == [x == 1 for x in labels]


def test_classifier_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in classifier.quality_scores(odd(spark), none).collect()} == {0.5}
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (None, 1, 0), (12, None, 0), (5, 1, 0), (6, 0, 0), (0, 1, 1)], "doc_id long, quality int, toxic int")
    got = classifier.quality_scores(odd(spark), labels).collect()
    assert len(got) == odd(spark).count() and len({r.score for r in got if r.doc_id in (0, 1)}) == 1
    assert classifier.quality_scores(empty(spark), labels).count() == 0 == classifier.drop_low_quality(empty(spark), labels).count()


def test_many_rows_of_one_id_leave_the_other_labels_in(spark):
    good, bad = "plain words of a calm text " * 3, "$$$ !!! ### spam " * 3
    ids = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 != 2][:40]
    rows = [(ids[0], good + str(k)) for k in range(300)] + [(i, bad if k % 2 else good) for k, i in enumerate(ids) if k]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(k % 2 == 0), 0) for k, i in enumerate(ids)], "doc_id long, quality int, toxic int")
    got = classifier.quality_scores(docs, labels, sample=40).collect()
    assert {r.predicted for r in got if r.doc_id in ids[0::2]} == {1} and {r.predicted for r in got if r.doc_id in ids[1::2]} == {0}


def test_no_model_drops_no_row(spark):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        assert classifier.drop_low_quality(odd(spark), known).count() == odd(spark).count()


# ------------------------------------------------------------------ line dedup


def lines_by_hand(rows, one_in):
    pages, has = Counter(s for _, _, s in rows), Counter()
    for _, text, s in rows:
        for line in set((text or "").split("\n")) if text is not None else ():
            has[s, line] += 1
    gone = {k for k, n in has.items() if n > pages[k[0]] / one_in + (1 - 1 / one_in) * math.sqrt(pages[k[0]]) + 1e-9 and k[1].strip(" ")}
    out = []
    for i, text, s in rows:
        lines = text.split("\n") if text is not None else []
        kept = [x for x in lines if (s, x) not in gone]
        out.append((i, len(lines), len(lines) - len(kept), None if text is None else "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup(spark):
    rows = [(i, f"menu\nbody {i}\n\nmenu\nfoot {i % 3}", "a" if i % 4 else None) for i in range(40)] + [(99, None, "a"), (98, "", "b"), (97, "menu", "b"), (1, "menu\nbody 1", "a"), (None, "menu", None)]
    docs = spark.createDataFrame([(i, t, "en", s, 0, "clash") for i, t, s in rows], DOCS + ", host string")
    for one_in in (20, 3, 2):
        got = linededup.drop_boilerplate(docs, one_in=one_in)
        assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=str) == lines_by_hand(rows, one_in)
    assert got.where("host = 'clash'").count() == len(rows)
    assert linededup.drop_boilerplate(empty(spark)).count() == 0


def test_a_line_needs_no_least_number_of_pages(spark):
    """Hosts of one to six pages: all of two pages, two of three, three of six; one page alone never."""
    rows = [(f"h{n}x{k}", "menu\n" * (j < k) + f"own {n} {k} {j}") for n in range(1, 7) for k in range(n + 1) for j in range(n)]
    docs = spark.createDataFrame([(j, t, "en", h, 0) for j, (h, t) in enumerate(rows)], DOCS)
    gone = {r.source for r in linededup.drop_boilerplate(docs).where("n_dropped > 0").collect()}
    assert gone == {f"h{n}x{k}" for n in range(1, 7) for k in range(n + 1) if k > n / 20 + 0.95 * math.sqrt(n) + 1e-9} and {"h2x2", "h3x2", "h6x3"} <= gone and "h1x1" not in gone


def test_line_dedup_keeps_foreign_columns(spark):
    rows = [(k, f"menu\nbody {k}", "en", "a", 0, f"n{k}", k, "h", [1], "y") for k in range(10)]
    docs = spark.createDataFrame(rows, DOCS + ", n_lines string, n_dropped int, __host string, __common array<int>, __kept string")
    got = linededup.drop_boilerplate(docs, told=False)
    assert got.columns == docs.columns
    assert sorted(tuple(r) for r in got.collect()) == sorted((r[0], f"body {r[0]}", *r[2:]) for r in rows)
    assert {r.n_lines for r in linededup.drop_boilerplate(docs).collect()} == {2}


# -------------------------------------------------------------- tokens, packing


library = functools.cache(Tokenizer.from_file)


def library_ids(path, text):
    return library(path).encode(text or "", add_special_tokens=False).ids


def test_pieces_encode_as_the_library_does():
    import random

    library = Tokenizer.from_file(BYTES)
    encoder = tokens.encoder(BYTES)
    parts = ["a", "b ", " ", "\n", "'s", "1", "!", "é", "  ", "\t", " \n", " ", "<|endoftext|>", "\r\n", "漢", "　", "x", "\x1d", " a", " 1", " !", "²", "\x85", "’", " _"]
    rng = random.Random(1)
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(5000)] + [t for t in ODD if t]
    for text in texts:
        assert encoder.encode(text) == tokens._packed(library.encode(text, add_special_tokens=False).ids)


def test_caches_of_long_pieces_are_bounded():
    """Texts without spaces, as Chinese, base64 or minified code: what a worker keeps has a fixed size."""
    import random

    encoder = tokens.PieceEncoder(BYTES)
    rng = random.Random(2)
    for _ in range(20):
        text = "".join(rng.choice("abcdefgh0123456789+/") for _ in range(20_000)) + " " + "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(5_000))
        assert encoder.encode(text) == tokens._packed(library(BYTES).encode(text, add_special_tokens=False).ids)
    for cache in (encoder.pieces, encoder.pieces.words):
        assert all(len(k) <= tokens.LONGEST for k in cache) and sum(len(k) + len(v) for k, v in cache.items()) < 1 << 20


def test_caches_stop_at_their_bytes(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_BYTES", 500)
    encoder = tokens.PieceEncoder(BYTES)
    text = " ".join(f"word{k}" for k in range(2000))
    assert encoder.encode(text) == tokens._packed(library(BYTES).encode(text, add_special_tokens=False).ids)
    for cache in (encoder.pieces, encoder.pieces.words):
        assert 0 < sum(len(k) + len(v) for k, v in cache.items()) < 600


def test_token_counts(spark):
    library = Tokenizer.from_file(WORDS)
    docs = documents(spark).select("doc_id", "text").union(odd(spark).select("doc_id", "text"))
    got = tokencount.token_counts(docs, WORDS).collect()
    expected = Counter((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == expected
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert tokencount.token_counts(empty(spark), WORDS).count() == 0


def test_only_odd_segments_go_to_the_library(monkeypatch):
    import random

    library, counter, asked = Tokenizer.from_file(WORDS), tokencount._Counter(WORDS, {}), []
    monkeypatch.setattr(counter, "by_library", lambda text, f=counter.by_library: asked.append(text) or f(text))
    texts = ["Ελληνικά κείμενο ΣΑΣ Ωμέγα και English words", "русский текст, ещё раз и English", "漢字かな交じり文 と words", "curly ‘quotes’ and “doubles” — dash… here", "नमस्ते दुनिया", "مرحبا بالعالم", "éa ́x Å", "a<|endoftext|>b <|startoftext|> c", "xy z  w　v"]
    rng = random.Random(6)
    parts = ["a", "B ", " ", "\n", "'s", "'S ", "1", "!", "é", "É ", "\t", "<|endoftext|>", "漢", "Σ", "ς ", "　", "x", "", "²", "", "’", "’s ", "İ", "ß", "ﬁ", "́", "🙂", "Ж"]
    for text in texts + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)] + [t for t in ODD if t]:
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)
    asked.clear()
    counter.clear()
    counter.count("plain words here — and “more” of them " * 50)
    assert sorted(asked) == sorted({"plain", "words", "here", "—", "and", "“more”", "of", "them"})  # no text goes whole


def test_frequent_words_are_added_up_over_partitions(spark):
    docs = spark.createDataFrame([(f"Alpha beta — gamma{k} " * (k % 3),) for k in range(60)] + [(None,), ("",)], "text string").repartition(6)
    assert {"Alpha", "beta", "—"} <= set(tokencount.frequent_words(docs, "text", 5)[:4]) and tokencount.frequent_words(docs.limit(0), "text") == []


def test_token_table_round_trip(spark, tmp_path):
    docs = documents(spark).select("doc_id", "text").union(odd(spark).select("doc_id", "text")).repartition(3)
    path = f"file://{tmp_path}/table"
    shards = sstable.write_token_table(docs, BYTES, path)
    got = sorted(sstable.read_token_table(spark, path, shards).collect(), key=lambda r: r.start)
    start, expected = 0, []
    assert [r.doc_id is not None for r in got] == sorted(r.doc_id is not None for r in got)
    by_id = defaultdict(list)
    for r in docs.collect():
        ids = library_ids(BYTES, r.text) + [2]
        by_id[r.doc_id].append(ids)
        expected.append((r.doc_id, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(expected)
    for r in got:
        assert r.start == start
        start += r.n_tokens
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(r.doc_id for r in docs.collect() if r.doc_id is not None)
    for doc_id in (0, 4, 77, None):
        assert sorted(x.tolist() for x in sstable.lookup(path, shards, doc_id)) == sorted(by_id[doc_id])
    assert sstable.lookup(path, shards, 10**12) == [] == sstable.lookup(path, shards, -5)
    assert sstable.token_table(empty(spark), BYTES).count() == 0


def test_packing(spark):
    docs = documents(spark).select("doc_id", "text").union(odd(spark).select("doc_id", "text"))
    got = packing.pack_documents(docs, BYTES, 1024, keep_ids=True).collect()
    pieces = []
    for r in docs.collect():
        ids = library_ids(BYTES, r.text) + [2]
        first = len(ids) % 1024 or 1024
        for k, s in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[s : s + 1024 if k else first]
            pieces.append((r.doc_id, k, s, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)), tuple(part)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == Counter(pieces)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= best_fit([p[3] for p in pieces])
    assert packing.pack_documents(empty(spark), BYTES).count() == 0


def best_fit(lengths, size=1024):
    """Number of sequences of best fit in falling order, one piece after the other."""
    rooms, n = [], 0
    for x in sorted(lengths, reverse=True):
        k = bisect.bisect_left(rooms, x)
        if k == len(rooms):
            room, n = size, n + 1
        else:
            room = rooms.pop(k)
        bisect.insort(rooms, room - x)
    return n


CASES = {
    "none": [],
    "few": [600] * 3 + [424] * 2 + [512] * 5,
    "whole and least": [1024] * 2 + [1] * 2000,
    "each length": [k for k in range(1, 1025) for _ in range(k % 3)],
    "one length": [342] * 700,
    "short ones into few gaps": [1 + k * k % 19 for k in range(3000)] + [500 + k % 524 for k in range(60)],
}


@pytest.mark.parametrize("name", CASES)
def test_packing_is_like_best_fit(spark, name):
    lengths = CASES[name]
    pieces = spark.createDataFrame([(n,) for n in lengths], "length long")
    by = defaultdict(list)
    for r in packing.pack(pieces, 1024).collect():
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        ends = [0]
        for offset, length in sorted(parts):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 1024
    assert Counter(n for parts in by.values() for _, n in parts) == Counter(lengths)
    assert len(by) <= best_fit(lengths)


def test_a_sweep_is_best_fit():
    """As many sequences as best fit opens with one piece after the other; each piece in one place, no gaps, no overlaps."""
    import random

    rng = random.Random(4)
    cases = [[rng.randint(1, 40) for _ in range(rng.randrange(300))] for _ in range(60)]
    cases += [[min(40, 1 + int(rng.expovariate(0.15))) for _ in range(400)] for _ in range(40)] + [[rng.choice([7, 13, 14, 20, 21, 40]) for _ in range(300)] for _ in range(20)]
    for lengths in cases:
        runs = packing.sweep(Counter(lengths), 40)
        filled, seen = defaultdict(list), Counter()
        for length, rank, n, first, per, offset in runs.itertuples(index=False):
            assert rank == seen[length]
            seen[length] += n
            for k in range(n):
                filled[first + k // per].append((offset + k % per * length, length))
        assert seen == Counter(lengths)
        for parts in filled.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 40
        assert len(filled) == best_fit(lengths, 40)


def test_ranks_and_blocks_lose_no_piece(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 50)
    monkeypatch.setattr(packing, "BLOCK", 16)
    lengths = [1 + k * k % 97 for k in range(3000)]
    got = packing.pack(spark.createDataFrame([(n,) for n in lengths], "length long"), 100).collect()
    assert Counter(r.length for r in got) == Counter(lengths)
    assert len({(r.sequence_id, r.offset) for r in got}) == 3000 and len({r.sequence_id for r in got}) == best_fit(lengths, 100)


def test_equal_rows_are_dealt_out(spark):
    docs = spark.createDataFrame([(None, "")] * 3000, "doc_id long, text string")
    got = packing.pack_documents(docs, BYTES, 1024).collect()
    assert len(got) == 3000 and len({r.sequence_id for r in got}) == 3 and len({(r.sequence_id, r.offset) for r in got}) == 3000


# ------------------------------------------------------------------------- URLs


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "http://Example.NET/en/x?y", "https://a.example.net/EN/", "http://net/", "http://net", "x://B.net/q#f", "http://example.com/de/1", "http://notexample.com/de/1", "https://w.org/fr/", "http://www.spam.example.com/a/1.html?x", "https://m.spam.example.com/a/1/", "http://spam.example.com/a/2", "http://u:p@h.com:80?x/y", "http://a://b/c"]
    pages = spark.createDataFrame([(i, u, "", "x") for i, u in enumerate(urls + urls[-2:])] + [(None, urls[4], "", "y")], "page_id long, url string, html string, host string")
    listed = spark.createDataFrame([("spam.example.com/a/1",), ("spam.example.com/a/1",), (None,), ("",)], "url string")
    got = {r.page_id: tuple(r)[1:] for r in urlfilter.filter_urls(pages, listed, queries.RULES).collect()}
    assert len(got) == pages.count()
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[4] == ("example.net", "/en/x", "example.net/en/", "allow") and got[5] == ("a.example.net", "/EN/", "net/", "block")
    assert got[6][2:] == ("net/", "block") and got[7] == ("net", "", None, "allow") and got[8] == ("b.net", "/q", "net/", "block")
    assert got[9][2:] == ("example.com/de/", "block") and got[10][2:] == (None, "allow") and got[11][2:] == ("org/fr/", "allow")
    assert [got[k][3] for k in (12, 13, 14)] == ["block", "block", "allow"]
    assert got[15][:2] == ("u:p@h.com:80", "") and got[16][:2] == ("a:", "//b/c")
    none = spark.createDataFrame([], "url string")
    assert urlfilter.filter_urls(pages, none, []).where("verdict = 'allow'").count() == pages.count()
    assert urlfilter.filter_urls(pages.limit(0), listed, queries.RULES).count() == 0


def test_bloom_filter_lets_every_listed_url_pass(spark):
    listed = spark.range(3000).selectExpr("concat('h/', id) as url")
    pages = spark.range(20000).selectExpr("concat('h/', id) as url")
    tested = urlfilter.possible_hits(pages, listed, 3000).where("possible").collect()
    assert {f"h/{k}" for k in range(3000)} <= {r.url for r in tested} and len(tested) < 3000 + 0.02 * 17000


# ---------------------------------------------------------------------- SimHash


def fingerprint_by_hand(text, n=3):
    from xxhash import xxh64_intdigest

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def classes_by_hand(fps, radius):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = sorted(parent)
    for k, a in enumerate(fps):
        for b in fps[:k]:
            if bin(a ^ b).count("1") <= radius:
                parent[root(a)] = root(b)
    return {f: root(f) for f in fps}


def test_near_duplicate_classes(spark):
    extra = [(900 + k, " ".join(f"w{j}" for j in range(200 + (k % 5)))) for k in range(12)] + [(None, "zz yy"), (980, "ZZ\tyy"), (980, "ZZ\tyy"), (981, ""), (982, None), (983, " \n")]
    docs = documents(spark).select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = [(r.doc_id, fingerprint_by_hand(r.text)) for r in docs.collect()]
    classes = classes_by_hand({f for _, f in rows}, 2)
    least = {}
    for i, f in rows:
        if i is not None:
            least[classes[f]] = min(i, least.get(classes[f], i))
    expected = Counter((i, f"{f:016x}", least.get(classes[f])) for i, f in rows)
    got = simhash.near_duplicate_classes(docs)
    assert Counter(tuple(r) for r in got.collect()) == expected
    assert simhash.near_duplicate_classes(empty(spark)).count() == 0
    assert simhash.near_duplicate_classes(odd(spark)).count() == odd(spark).count()


def test_shards_lose_no_link(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(simhash, "SAMPLE", 500)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 1500)
    near = [int(x) ^ (1 << int(a)) ^ (1 << int(b)) for x, a, b in zip(base, rng.integers(0, 63, 1500), rng.integers(0, 63, 1500))]
    chain = [(1 << k) - 1 for k in range(0, 62, 2)]
    fps = sorted({int(x) for x in base} | set(near) | set(chain))
    trees = simhash.VantageTree(np.array(fps, dtype=np.uint64), 1, 0xFFFFFFFF, 1, shard=100)
    assert trees.leaves > 10
    for shard in (simhash.SHARD, 60):
        monkeypatch.setattr(simhash.VantageTree.__init__, "__defaults__", (shard,))
        links = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), 2)
        got = {r.node: r.component for r in simhash.components(links).collect()}
        classes = defaultdict(list)
        for f, c in classes_by_hand(set(fps), 2).items():
            classes[c].append(f)
        assert got == {f: min(m) for m in classes.values() if len(m) > 1 for f in m}


@pytest.mark.parametrize("low_bits", [0, 32])
def test_large_shards_are_parted_again(low_bits):
    """Fingerprints that share no bits, or one whole half; links are those of all pairs with one at home."""
    import numpy as np

    random = np.random.default_rng(5)
    base = random.integers(0, 1 << 63, 900, dtype=np.uint64) << np.uint64(low_bits)
    flips = np.uint64(1) << random.integers(low_bits, 64, (2, 900)).astype(np.uint64)
    fps = np.unique(np.concatenate((base, base ^ flips[0], base ^ flips[0] ^ flips[1], base[:50] ^ np.uint64(7 << 40))))
    home = random.random(len(fps)) < 0.7
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    for shard in (60, simhash.SHARD):
        links = simhash._shard_links(fps, home, 2, shard)
        label = {f: f for f in fps.view(np.int64).tolist()}
        for a, b in links.itertuples(index=False):
            label[a] = b
        top = np.array([label[f] for f in fps.view(np.int64).tolist()])
        assert (top[:, None] == top[None, :])[near & home[:, None]].all()
        known = np.arange(len(fps))
        while True:  # no link beyond what the distance reaches
            lower = np.where(near, known[None, :], len(fps)).min(axis=1)
            if (lower == known).all():
                break
            known = lower
        assert all(len(set(known[top == t])) == 1 for t in np.unique(top))
    tree = simhash.VantageTree(fps, 1, (1 << 64) - 1, 2, shard=60)
    assert np.bincount(tree.deal(fps)[0]).max() < len(fps) / 3
