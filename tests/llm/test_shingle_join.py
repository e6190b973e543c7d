from __future__ import annotations

import random

import numpy as np
import pytest

from depgraph.llm import shingle_join as J
from depgraph.llm.components import components
from tests.llm.conftest import prose


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(tuple(words[j:j + width]) for j in range(len(words) - width + 1))


def brute(texts, width, percent):
    sets = [shingles(t, width) for t in texts]
    root, links = list(range(len(texts))), [0] * len(texts)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [(i, len(sets[i]), top(i), links[i]) for i in range(len(texts))]


def copies(seed, n, words, edits):
    """A text and copies with a few words changed, dropped or added."""
    pick = random.Random(seed)
    base = prose(seed, words, 5000).split()
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(pick.randrange(edits + 1)):
            at = pick.randrange(len(own))
            own[at:at + pick.randrange(2)] = [f"e{pick.random()}"] * pick.randrange(2)
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("width, percent, block", [(4, 85, 400_000), (5, 80, 400_000), (4, 85, 1500)])
def test_components_and_links_match_brute_force(spark, documents, monkeypatch, width, percent, block):
    monkeypatch.setattr(J, "BLOCK_SHINGLES", block)
    passage = prose(9, 60, 5000)
    texts = copies(1, 40, 90, 6) + copies(2, 25, 200, 9) + copies(3, 12, 12, 2) + [copies(1, 1, 90, 0)[0]] * 5
    texts += [f"{prose(i, 50, 5000)} {passage} {prose(i + 500, 40, 5000)}" for i in range(30)]
    texts += ["a", "A", "a b", "a  b\n", "a b c", None, None, "", " \t", "é é é é é", "a b c d", prose(7, 20_000, 9000), prose(7, 20_000, 9000) + " x"]
    got = J.similar_documents(documents(*enumerate(texts)), width, percent).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got] == brute(texts, width, percent)


def test_repeated_rows_null_numbers_and_clashing_columns(spark, documents):
    from pyspark.sql import functions as F

    text = prose(1, 30)
    docs = documents((7, text), (7, text), (3, text), (None, text), (None, None)).withColumn("signature", F.lit(1))
    got = J.similar_documents(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.copies) for r in got) == [(0, 0, 1), (0, 3, 4), (3, 3, 4), (7, 3, 4), (7, 3, 4)]


def test_empty_table_and_no_duplicates(spark, empty, documents):
    assert J.similar_documents(empty).count() == 0
    got = J.similar_documents(documents((1, prose(1, 50)), (2, prose(2, 50)))).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 2)]


def test_links_derived_from_a_pivot_equal_direct_intersections():
    pick = random.Random(4)
    base = [np.uint64(x) for x in range(100)]
    sets = []
    for _ in range(60):
        own = set(base) - set(pick.sample(base, pick.randrange(30))) | {np.uint64(pick.randrange(100, 160)) for _ in range(pick.randrange(20))}
        sets.append(np.array(sorted(own), dtype=np.uint64))
    sets.sort(key=len)
    sizes = np.array(list(map(len, sets)))
    for i, near in J.linked_pairs(sets, sizes, 85):
        want = [j for j in range(60) if j != i and 100 * len(set(sets[i]) & set(sets[j])) >= 85 * len(set(sets[i]) | set(sets[j]))]
        assert near.tolist() == want


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 400)] + [(500, i) for i in range(501, 700)] + [(800, 800), (7, 3), (7, 3)]
    pick = random.Random(1)
    pick.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 401)}, **{i: 500 for i in range(501, 700)}}
