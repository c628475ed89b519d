"""The Merkle manifest against trees by hand."""

import random
import zlib
from hashlib import sha256

import pytest
from tracelake.llm import merkle


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree_by_hand(leaves):
    """(root, for each leaf the runs and places from the leaf up)."""
    paths, nodes, of = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        for k, path in enumerate(paths):
            at = of[k]
            path.append((nodes[at // 8 * 8 : at // 8 * 8 + 8], at % 8))
        nodes, of = [h(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)], [x // 8 for x in of]
    return nodes[0], paths


def manifest_by_hand(rows):
    parts = {}
    for doc_id, text, lang, source, n_chars in rows:
        # the digits of a null id have no CRC-32, so its text stays
        head = [field(x) for x in (doc_id, source, lang, n_chars)]
        low = text if text is None or doc_id is None or zlib.crc32(str(doc_id).encode()) % 3 else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        parts.setdefault(lang, []).append((doc_id, h(*head, field(text)), h(*head, field(low))))
    langs = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        parts[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    built = {lang: tree_by_hand([x[1] for x in parts[lang]]) for lang in langs}
    root, tops = tree_by_hand([built[lang][0] for lang in langs]) if langs else (None, [])
    out = []
    for k, lang in enumerate(langs):
        for (doc_id, leaf, copy), path in zip(parts[lang], built[lang][1]):
            path = path + tops[k]
            proof = h(*[d for run, at in path for j, d in enumerate(run) if j != at])
            for run, at in path:
                copy = h(*run[:at], copy, *run[at + 1 :])
            out.append((doc_id, leaf, built[lang][0], root, proof, copy, copy == root))
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, part int, digest string")


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_manifest_is_that_by_hand(spark, monkeypatch, levels):
    """Small blocks make several stages; one language has most rows, another 8 times 8, others one or two."""
    rng = random.Random(levels)
    rows = [(k, rng.choice(["Some Text", "other text", "", None, "Üml\nÄ"]), "en", rng.choice(["s", None]), rng.choice([1, None])) for k in range(150 if levels > 1 else 700)]
    rows += [(1000 + k, "T", "de", "s", 1) for k in range(64)] + [(2000, "Lone", None, "s", 4), (2001, "x", "", "s", 4), (2002, None, "", None, None), (2003, "Ä", "ü", "s", 1)]
    rows += [rows[5], rows[5], (5, "Another", "en", "s", 1), (None, "No Id", "en", "s", 1)]
    rng.shuffle(rows)
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 8**levels)
    got = merkle.document_manifest(table(spark, rows)).collect()
    # the digits of a null id have no CRC-32, so its text stays
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, manifest_by_hand(rows)))
    tampered = {r.doc_id for r in got if not r.verified}
    assert tampered == {i for i, t, *_ in rows if i is not None and not zlib.crc32(str(i).encode()) % 3 and t and t != "".join(c.lower() if "A" <= c <= "Z" else c for c in t)}


def test_many_parts_make_a_top_tree_of_several_stages(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rows = [(k, f"T{k}", f"l{k % 75}", "s", 1) for k in range(200)]
    got = merkle.document_manifest(table(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted(manifest_by_hand(rows))


def test_manifest_of_an_empty_table_and_of_one_row(spark):
    assert merkle.document_manifest(table(spark, [])).count() == 0
    (one,) = merkle.document_manifest(table(spark, [(7, None, None, None, None)])).collect()
    assert one.leaf == one.subroot == one.root == one.folded_root == h("1:7----") and one.proof_sha256 == h() and one.verified


def test_a_frontier_extends_witnesses_as_siblings_come():
    tree = merkle.Frontier()
    tree.append("a")
    (run, at), = tree.witnesses[0]
    assert [x[0] for x in run] == ["a"] and at == 0
    tree.append("b")
    assert [x[0] for x in run] == ["a", "b"] and tree.witnesses[1] == [(run, 1)]
    for x in "cdefgh":
        tree.append(x)
    assert len(run) == 8 and tree.open[0] == [] and [len(w) for w in tree.witnesses] == [2] * 8
