from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from depgraph.llm import decontamination as D
from tests.llm.conftest import prose

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(texts, items, window):
    found = []
    windows = [(i, w[j:j + window]) for i, t in items if (w := words(t)) for j in range(max(1, len(w) - window + 1))]
    for text in texts:
        own, hit, names = words(text), set(), set()
        for item, win in windows:
            for j in range(len(own) - len(win) + 1):
                if own[j:j + len(win)] == win:
                    hit.update(range(j, j + len(win)))
                    names.add(str(item))
        found.append((len(own), len(hit), sorted(names)))
    return found


def table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block_words", [200_000, 25])
def test_report_matches_brute_force(spark, documents, monkeypatch, block_words):
    monkeypatch.setattr(D, "BLOCK_WORDS", block_words)
    pick = random.Random(3)
    items = [(i, prose(i, 4 + i, 30)) for i in range(14)] + [(20, None), (21, "..."), (22, "w0"), (23, "W0 é"), (2, prose(2, 6, 30))]
    texts = []
    for i in range(60):
        text = prose(100 + i, pick.randrange(0, 80), 30)
        for _ in range(i % 3):
            item = pick.choice(items)[1] or ""
            text = f"{text} {item.upper() if i % 2 else item}, {prose(i, 5, 30)}"
        texts.append(text)
    texts += [None, "", "w0", "É w0 é", texts[5], "w0 " * 3000]
    docs = documents(*enumerate(texts))
    got = D.annotate(docs, table(spark, items), window=6, carry=["doc_id"]).orderBy("doc_id").collect()
    want = brute(texts, items, 6)
    assert [(r.contamination.n_words, r.contamination.n_hit, r.contamination["items"]) for r in got] == want


def test_longest_matches_and_places(spark, documents):
    item = [f"k{i}" for i in range(15)]
    text = " ".join(["a", *item[2:14], "b", *item[:10]])
    row = D.annotate(documents((1, text)), table(spark, [(7, " ".join(item))])).first().contamination
    assert sorted((m.word, m.item_word, m.words) for m in row.matches) == [(1, 2, 12), (14, 0, 10)]
    assert (row.n_words, row.n_hit) == (24, 22)


def test_suffix_array_is_sorted_and_searches_ranges():
    pick = np.random.default_rng(5)
    ids = pick.integers(0, 4, 500)
    array = D.SuffixArray(ids.astype(np.int64), 7, 5)
    padded = [*ids.tolist(), *[0] * 10]
    suffixes = [tuple(padded[p:p + 7]) for p in array.places]
    assert suffixes == sorted(suffixes) and len(suffixes) == (ids > 0).sum()
    query = np.array([padded[p:p + 7] for p in np.flatnonzero(ids)[:40]])
    query = query[(query > 0).all(axis=1)]
    low, high = array.search(query, np.full(len(query), 7))
    for q, a, b in zip(query.tolist(), low, high):
        assert sorted(array.places[a:b]) == [p for p in range(500) if padded[p:p + 7] == q]


def test_decontaminate_keeps_clean_rows_and_all_columns(spark, documents):
    item = prose(1, 12)
    docs = documents((1, prose(2, 40)), (2, "x " + item + " y"), (3, None), (1, prose(2, 40)))
    docs = docs.withColumn("contamination", F.lit("clash"))
    kept = D.decontaminate(docs, table(spark, [(1, item)]))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 1, 3]
    assert D.annotate(docs, table(spark, [(1, item)])).select("contamination.n_hit").count() == 4


def test_empty_tables(spark, empty, documents):
    assert D.annotate(empty, table(spark, [(1, "a b")])).count() == 0
    clean = D.annotate(documents((1, "a b")), table(spark, [])).first().contamination
    assert (clean.n_words, clean.n_hit, clean["items"]) == (2, 0, [])
