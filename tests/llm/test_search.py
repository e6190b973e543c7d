from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from depgraph.llm import search as S
from tests.llm.conftest import prose


def brute(docs, queries, k):
    bags = [(i, Counter((t or "").encode().lower().split())) for i, t in docs]
    lengths = [c.total() for _, c in bags]
    mean = max(sum(lengths), 1) / max(len(bags), 1)
    seen = Counter(w for _, c in bags for w in c)
    out = []
    for q, text in queries:
        terms, found = set((text or "").encode().lower().split()), []
        for (i, bag), length in zip(bags, lengths):
            score = 0
            for w in terms & bag.keys():
                idf = math.log(1 + (len(bags) - seen[w] + 0.5) / (seen[w] + 0.5))
                score += int(S.contributions(np.array(idf), np.array(float(bag[w])), np.array(float(length)), mean))
            if score > 0:
                found.append((-score, i))
        out += [(q, rank, i, -score) for rank, (score, i) in enumerate(sorted(found)[:k], 1)]
    return out


@pytest.mark.parametrize("k, shard, terms, block, frequent", [
    (10, 16 << 20, 2_000_000, 64, 1 / 32), (3, 900, 40, 4, 1 / 32), (500, 2000, 2_000_000, 8, 0.3), (5, 3000, 100, 2, 2),
])
def test_results_match_brute_force(spark, documents, monkeypatch, k, shard, terms, block, frequent):
    monkeypatch.setattr(S, "FREQUENT", frequent)
    monkeypatch.setattr(S, "SHARD_BYTES", shard)
    monkeypatch.setattr(S, "QUERY_TERMS", terms)
    monkeypatch.setattr(S, "BLOCK_DOCS", block)
    docs = [(i, prose(i, 1 + i % 40, 120)) for i in range(150)] + [(150, prose(4, 30, 120)), (151, prose(4, 30, 120)), (152, None), (153, ""), (154, "W1 é"), (155, "w0 " * 5000)]
    queries = [(i, t) for i, t in docs if i % 10 == 0] + [(1000, "w0"), (1001, "unseen words"), (1002, None), (1003, "w0 w1 W1"), (1004, "é")]
    got = S.top_k(documents(*docs), spark.createDataFrame(queries, "query_id long, text string"), k)
    assert sorted(map(tuple, got.select("query_id", "rank", "doc_id", "score").collect())) == sorted(brute(docs, queries, k))


def test_counts_beyond_two_bytes(spark, documents):
    docs = [(1, "w " * 70_000), (2, "w " * 65_535 + "x " * 4_465), *((i, "y " * 20) for i in range(3, 300))]
    got = S.top_k(documents(*docs), spark.createDataFrame([(7, "w")], "query_id long, text string")).collect()
    mean, idf = (140_000 + 20 * 297) / 299, math.log(1 + (299 - 2 + 0.5) / 2.5)
    want = [round(1e6 * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * 70_000 / mean))) for tf in (70_000, 65_535)]
    assert [(r["rank"], r.doc_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1, want[0]), (2, 2, want[1])]
    assert want[0] > want[1]


def test_skipped_blocks_do_not_change_the_answer(spark, documents, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_DOCS", 2)
    monkeypatch.setattr(S, "FREQUENT", 2)
    monkeypatch.setattr(S, "LEAD_BLOCKS", 2)
    docs = [(i, "rare common" if i in (40, 77) else f"common x{i}") for i in range(120)]
    index = S.build_index(documents(*docs).coalesce(1)).first().asDict()
    wanted = np.unique(np.array([S.xxhash.xxh3_64_intdigest(w) for w in (b"rare", b"common")], dtype=np.uint64))
    own = S._Shard(index, wanted, np.array([3.0, 0.1]) if wanted[0] == S.xxhash.xxh3_64_intdigest(b"rare") else np.array([0.1, 3.0]), 2.0)
    scored = []
    plain = own._add
    own._add = lambda entries: scored.append(len(entries)) or plain(entries)
    assert own.top([np.array([0, 1])], 2)[0][0].tolist() == [40, 77]
    assert sum(scored) < len(own.entry_block) / 2


def shard(spark, documents, docs):
    index = S.build_index(documents(*docs).coalesce(1)).first().asDict()
    wanted = np.unique(np.array([S.xxhash.xxh3_64_intdigest(w) for _, t in docs for w in t.encode().split()], dtype=np.uint64))
    number = {w: int(np.searchsorted(wanted, S.xxhash.xxh3_64_intdigest(w))) for _, t in docs for w in t.encode().split()}
    return index, wanted, number


def test_scores_of_earlier_shards_spare_work(spark, documents, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_DOCS", 4)
    monkeypatch.setattr(S, "FREQUENT", 2)
    docs = [(i, prose(i, 30, 60)) for i in range(200)]
    index, wanted, number = shard(spark, documents, docs)
    own = S._Shard(index, wanted, np.full(len(wanted), 2.0), 30.0)
    added, plain = [], own._sums
    own._sums = lambda first, size: added.append(int(size.sum())) or plain(first, size)
    query = np.unique([number[w] for w in docs[7][1].encode().split()])
    ids, scores = own.top([query], 5)[0]
    whole = sum(added)
    added.clear()
    for floor, left in ((scores[4], 5), (scores[1], 2), (scores[0], 1), (scores[0] + 1, 0)):
        got = own.top([query], 5, np.array([float(floor)]))[0]
        assert [x.tolist() for x in got] == [ids[:left].tolist(), scores[:left].tolist()]
    added.clear()
    own.top([query], 5, np.array([float(scores[0]) * 3]))
    assert sum(added) < whole / 4


def test_equal_scores_at_the_threshold_stay(spark, documents, monkeypatch):
    monkeypatch.setattr(S, "SHARD_DOCS", 8)
    docs = [(100 - i, "same words here" if i % 3 else f"other x{i}") for i in range(60)]
    queries = spark.createDataFrame([(1, "same words"), (2, "other")], "query_id long, text string")
    got = S.top_k(documents(*docs).coalesce(1), queries, 4).collect()
    assert sorted(map(tuple, got)) == sorted(brute(docs, [(1, "same words"), (2, "other")], 4))


@pytest.mark.parametrize("product", [0, 1 / 256, 1e9])
def test_products_are_exact(spark, documents, monkeypatch, product):
    monkeypatch.setattr(S, "PRODUCT", product)
    monkeypatch.setattr(S, "FREQUENT", 1 / 64)
    docs = [(i, prose(i, 200, 300)) for i in range(300)]
    index, wanted, number = shard(spark, documents, docs)
    idf = np.linspace(0.01, 30, len(wanted))  # some numbers are beyond single precision
    own = S._Shard(index, wanted, idf, 150.0)
    queries = [np.unique([number[w] for w in t.encode().split()]) for _, t in docs[:40]]
    bags = [Counter(t.split()) for _, t in docs]
    for query, (ids, scores) in zip(queries, own.top(queries, 6)):
        want = []
        for (i, _), bag in zip(docs, bags):
            held = [(number[w.encode()], n) for w, n in bag.items() if number[w.encode()] in query]
            parts = S.contributions(idf[[t for t, _ in held]], np.array([n for _, n in held], dtype=float), np.float64(bag.total()), 150.0)
            want.append((-int(parts.sum()), i))
        assert [(-s, i) for i, s in zip(ids.tolist(), scores.tolist())] == sorted(want)[:6]


def test_queries_that_share_frequent_terms_are_answered_together(monkeypatch):
    monkeypatch.setattr(S, "MERGE_QUERIES", 16)
    random = np.random.default_rng(3)
    kind = random.integers(0, 2, 64)
    kind[np.argsort(kind, kind="stable")] = np.repeat([0, 1], 32)
    which = [np.flatnonzero(random.random(20) < 0.7) + 20 * c for c in kind]
    edges = np.cumsum([0, *map(len, which)])
    order = S._grouped(edges, np.concatenate(which), np.full(40, 30), 100)
    assert sorted(order.tolist()) == list(range(64))
    assert all(len(set(kind[order[a:a + 16]])) == 1 for a in range(0, 64, 16))


def test_null_numbers_repeated_rows_and_clashing_columns(spark, documents):
    from pyspark.sql import functions as F

    docs = documents((None, "a"), (2, "a b"), (2, "a b")).withColumn("terms", F.lit(1))
    queries = spark.createDataFrame([(1, "b"), (None, "a")], "query_id long, text string")
    assert sorted((r.query_id, r["rank"], r.doc_id) for r in S.top_k(docs, queries).collect()) == [(1, 1, 2), (1, 2, 2)]


def test_empty_tables(spark, documents, empty):
    none = spark.createDataFrame([], "query_id long, text string")
    assert S.top_k(documents((1, "a")), none).count() == 0
    assert S.top_k(empty, spark.createDataFrame([(1, "a")], "query_id long, text string")).count() == 0
