"""Tree search against plain loops, and the tree itself."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from depgraph.llm import fp_tree
from depgraph.llm.common import ascii_words
from tests.llm.conftest import prose

ITEMS = "item_id long, text string"


def terms_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, top):
    """(item, rank, doc, score) by plain loops; documents and items are (number, text)."""
    held = [(number, Counter(terms_of(text))) for number, text in docs]
    n_docs, words = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    counts = Counter(t for _, c in held for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, terms in wanted.items():
        found = []
        for number, c in held:
            score = 0
            for t in terms & c.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * counts[t] + 1)))
                m = 100 - 50 + (50 * c.total() * n_docs) // words
                score += w * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                found.append((-score, number is None, number or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def test_words_are_the_terms():
    text = "A-b_C9 é ü İx\x00y\x7fz\n" + "".join(map(chr, range(128)))
    assert [w.decode() for w in ascii_words(text)] == terms_of(text)
    assert ascii_words(None) == ascii_words("") == []


@pytest.mark.parametrize("leaf", [1, 3, 64])
def test_random_tables_against_loops(spark, documents, monkeypatch, leaf):
    draw = random.Random(leaf)
    docs = [(i, prose(i % 70, draw.randrange(1, 60), 80)) for i in range(150)]
    docs += [(None, prose(3, 20, 80)), (None, prose(3, 20, 80)), (7, docs[7][1]), (900, None), (901, ""), (902, "...")]
    items = [(i, prose(500 + i, 12, 90)) for i in range(12)] + [(3, "w1 w2 W3"), (None, "w0 w5"), (None, "w6"), (50, None), (51, "unseen")]
    monkeypatch.setattr(fp_tree.Tree.__init__, "__defaults__", (leaf,))
    found = fp_tree.rank_documents(documents(*docs).repartition(5), spark.createDataFrame(items, ITEMS), 10)
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items, 10)


def test_passes_over_blocks_of_items(spark, documents, monkeypatch):
    docs = [(i, prose(i, 30, 60)) for i in range(40)]
    items = [(i, prose(900 + i, 8, 60)) for i in range(9)]
    monkeypatch.setattr(fp_tree, "PASS_TERMS", 20)
    frame = spark.createDataFrame(items, ITEMS)
    assert fp_tree.item_terms(frame).select("pass").distinct().count() > 2
    found = fp_tree.rank_documents(documents(*docs), frame, 5)
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items, 5)


def test_many_copies_are_one_profile(spark, documents):
    docs = [(i, "same words here again words") for i in range(500)] + [(1000 + i, f"other words {i}") for i in range(50)]
    items = [(1, "same words")]
    found = fp_tree.rank_documents(documents(*docs).coalesce(1), spark.createDataFrame(items, ITEMS), 50)
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items, 50)
    index = fp_tree.restricted_vectors(documents(*docs).coalesce(1), {b"same": 0, b"words": 1})
    (row,) = index.collect()
    assert len(next(fp_tree._unpack(_batch(row), ["copies"]))["copies"]) == 2  # the copies, and "other words <i>"
    assert (row.n_docs, row.n_words) == (550, 500 * 5 + 50 * 3)


def _batch(row):
    import pyarrow as pa

    return pa.RecordBatch.from_pylist([{k: bytes(v) if isinstance(v, bytearray) else v for k, v in row.asDict().items()}])


def _tree(vectors, lengths, leaf):
    """Tree over profiles given as [(term, times), ...]; terms are ranked by their number."""
    flat = np.array([p for v in vectors for p in v], dtype=np.int64).reshape(-1, 2)
    n = len(vectors)
    own = {
        "numbers": np.arange(n), "nameless": np.zeros(n, dtype=bool), "copies": np.ones(n, dtype=np.int64),
        "lengths": np.array(lengths), "edges": np.cumsum([0, *map(len, vectors)]), "terms": flat[:, 0], "times": flat[:, 1],
    }
    return fp_tree.Tree(own, np.arange(20), n, int(sum(lengths)), leaf)


def test_bounds_cover_their_subtrees_and_prune():
    draw = random.Random(1)
    vectors = [[(t, draw.randrange(1, 9)) for t in sorted(draw.sample(range(20), draw.randrange(1, 12)))] for _ in range(300)]
    tree = _tree(vectors, [draw.randrange(12, 200) for _ in vectors], 4)
    weights = np.arange(1, 21) * 100
    tree.weigh(weights)
    leaves = [n for n in tree.nodes if not n.children]
    assert sorted(p for n in leaves for p in range(n.first, n.last)) == list(range(300))
    for i, node in enumerate(tree.nodes):
        paths = [tuple(tree.rank[tree.edges[p]:tree.edges[p] + node.depth]) for p in range(node.first, node.last)]
        assert len(set(paths)) == 1
        for p in range(node.first, node.last):
            a, b = tree.edges[p], tree.edges[p + 1]
            assert (tree.adds[a:b] <= tree.bounds[i][tree.rank[a:b]]).all()
    best = fp_tree.Best(5)
    scored = tree.search(np.array([17, 18, 19]), best)
    assert len(best.heap) == 5 and scored < 300  # pruned


def test_profiles_of_one_path_are_cut_evenly():
    tree = _tree([[(0, i + 1), (3, 2)] for i in range(50)], [10 + i for i in range(50)], 8)
    assert [n.last - n.first for n in tree.nodes if not n.children] == [8] * 6 + [2]


def test_very_frequent_terms_weigh_little_or_nothing(spark, documents):
    """A term of every document has the weight floor(1000 ln((2N + 2) / (2N + 1))), which may be 0."""
    docs = [(i, "all") for i in range(1200)]
    items = [(1, "all")]
    found = fp_tree.rank_documents(documents(*docs), spark.createDataFrame(items, ITEMS), 50)
    assert found.collect() == [] and brute(docs, items, 50) == []


def test_text_item_numbers(spark, documents):
    items = spark.createDataFrame([("b", "x y"), ("a", "x")], "item_id string, text string")
    found = fp_tree.rank_documents(documents((1, "x y"), (2, "z"), (3, "x")), items, 50)
    assert sorted((r.item_id, r["rank"], r.doc_id) for r in found.collect()) == [("a", 1, 3), ("a", 2, 1), ("b", 1, 1), ("b", 2, 3)]
