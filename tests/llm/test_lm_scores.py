from __future__ import annotations

import math
from collections import Counter

import pytest

from depgraph.llm import lm_scores as L
from tests.llm.conftest import prose


def brute(texts, order):
    docs = [(t or "").encode().lower().split() for t in texts]
    own = [Counter(tuple(d[i - n:i]) for n in range(1, order + 1) for i in range(n, len(d) + 1)) for d in docs]
    all_counts = sum(own, Counter())
    words = sum(map(len, docs))
    out = []
    for d, mine in zip(docs, own):
        rest, total, full = words - len(d), 0.0, 0

        def seen(gram):
            return all_counts[gram] - mine[gram]

        for i in range(len(d)):
            factor = 1.0
            for n in range(min(order, i + 1), 0, -1):
                gram = tuple(d[i - n + 1:i + 1])
                if n == 1:
                    score = seen(gram) / rest if seen(gram) else 1 / (rest + 1)
                elif seen(gram):
                    score = seen(gram) / seen(gram[:-1])
                else:
                    factor *= L.BACKOFF
                    continue
                full += n == order and seen(gram) > 0
                break
            total += math.log(factor * score)
        out.append((len(d), full, total))
    return out


@pytest.mark.parametrize("order, chunk, part", [(3, 16 << 20, 1 << 18), (3, 700, 60), (2, 16 << 20, 50), (1, 700, 1)])
def test_scores_match_brute_force(spark, documents, monkeypatch, order, chunk, part):
    monkeypatch.setattr(L, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(L, "BUCKET_ENTRIES", 500)
    monkeypatch.setattr(L, "SLICE_WORDS", part)
    texts = [prose(i, 3 + i % 40, 60) for i in range(60)] + [None, "", "only", "É é", prose(3, 6, 60), prose(3, 6, 60), "a b " * 4000]
    got = L.score_documents(documents(*enumerate(texts)), order).orderBy("doc_id").collect()
    for row, (words, full, total) in zip(got, brute(texts, order), strict=True):
        assert (row.n_words, row.n_full) == (words, full)
        assert row.log_score == pytest.approx(total, abs=1e-7)


def test_repeated_null_numbers_and_clashing_columns(spark, documents):
    from pyspark.sql import functions as F

    docs = documents((1, "a b c"), (1, "a b c"), (None, "a b")).withColumn("chunk", F.lit(0)).withColumn("words", F.lit("x"))
    got = L.score_documents(docs).collect()
    assert sorted((r.doc_id or 0, r.n_words) for r in got) == [(0, 2), (1, 3), (1, 3)]


def test_empty_table(spark, empty):
    assert L.score_documents(empty).count() == 0


def test_packing_round_trip():
    import numpy as np

    for values in ([], [5], [1, 2**63, 0, 7]):
        data = np.array(values, dtype=np.uint64)
        assert (L._unsqueeze(L._squeeze(data), np.uint64) == data).all()


def test_nothing_stays_in_the_catalog(spark, documents):
    before = {t.name for t in spark.catalog.listTables()}
    scored = L.score_documents(documents(*((i, prose(i, 20)) for i in range(30))))
    assert {t.name for t in spark.catalog.listTables()} == before
    assert scored.count() == 30 and scored.filter("n_words = 20").count() == 30  # read again after the table has gone
