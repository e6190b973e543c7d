"""Importance resampling against plain loops."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from depgraph.llm import resampling
from tests.llm.conftest import prose

TARGET = "item_id long, text string"


def features_of(text, max_words):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return words, [" ".join(words[i:i + n]) for n in range(1, max_words + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, max_words=1, buckets=10_000, percent=10, least_words=20):
    bucket = lambda f: crc32(f.encode()) % buckets
    own = [features_of(t, max_words) for _, t in docs]
    s = Counter(bucket(f) for _, fs in own for f in fs)
    t = Counter(bucket(f) for text in target for f in features_of(text, max_words)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)}
    rows = []
    for (number, _), (words, fs) in zip(docs, own):
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if number is None else number}".encode()).hexdigest()[:8], 16)
        rows.append([number, len(words), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    long = sorted((r for r in rows if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for i, row in enumerate(long[:len(long) * percent // 100]):
        row[5] = i + 1
    return sorted(map(tuple, rows), key=str)


def rows_of(found):
    return sorted(((r.doc_id, *r.importance) for r in found.collect()), key=str)


@pytest.mark.parametrize("max_words, buckets", [(1, 10_000), (3, 97)])
def test_against_loops(spark, documents, max_words, buckets):
    docs = [(i, prose(i, 5 + i % 60, 300)) for i in range(200)]
    docs += [(7, docs[7][1]), (7, docs[40][1]), (None, docs[50][1]), (None, prose(9, 30)), (300, None), (301, ""), (302, "!?"), (303, "É é Ünï-x_Y")]
    target = [prose(1000 + i, 40, 120) for i in range(8)] + [None, ""]
    frame = spark.createDataFrame([(1, t) for t in target], TARGET)
    found = resampling.resample(documents(*docs).repartition(4), frame, max_words=max_words, buckets=buckets)
    assert rows_of(found) == brute(docs, target, max_words, buckets)


def test_pieces_of_long_texts_are_stitched(monkeypatch):
    text = prose(4, 400) + " " + "ü" * 300 + " end, of. it"
    whole = resampling.Buckets(3, 1000)(text)
    monkeypatch.setattr(resampling, "PIECE_CHARS", 16)
    cut = resampling.Buckets(3, 1000)(text)
    assert whole[0] == cut[0] == len(features_of(text, 3)[0])
    assert all((a == b).all() for a, b in zip(whole[1:], cut[1:]))
    expected = Counter(crc32(f.encode()) % 1000 for f in features_of(text, 3)[1])
    assert dict(zip(whole[1].tolist(), whole[2].tolist())) == dict(expected)


def test_drawn_documents_lean_to_the_target(spark, documents):
    """Half of the documents use the target's vocabulary; most of those drawn are among them."""
    docs = [(i, " ".join(f"{'t' if i % 2 else 'o'}{(i * j) % 50}" for j in range(1, 40)), "x") for i in range(400)]
    target = spark.createDataFrame([(1, " ".join(f"t{j}" for j in range(50)) + " ") for _ in range(5)], TARGET)
    found = resampling.drawn_documents(documents(*docs), target).collect()
    assert sorted(r.importance["rank"] for r in found) == list(range(1, 41))
    assert sum(r.doc_id % 2 for r in found) >= 30  # half would be without the target
    texts = {d: t for d, t, _ in docs}
    assert all(r.text == texts[r.doc_id] and r.source == "x" for r in found)


def test_gains_round_down_and_smooth():
    found = resampling.gains(np.array([0, 9, 0]), np.array([4, 0, 0]))
    assert found.tolist() == [math.floor(1000 * math.log(x)) for x in (5 * 12 / 7, 12 / 70, 12 / 7)]


def test_empty_sides_and_clashing_columns(spark, documents, empty):
    none = spark.createDataFrame([], TARGET)
    assert resampling.resample(empty, none).collect() == []
    docs = documents((1, "one two"), (None, None)).selectExpr("doc_id", "text", "'x' AS importance", "5 AS _words", "7 AS _row", "8 AS rank")
    found = resampling.resample(docs, none)
    assert found.columns == ["doc_id", "text", "_words", "_row", "rank", "importance"]
    assert {(r.doc_id, r._words, r._row, r["rank"], r.importance.n_features) for r in found.collect()} == {(1, 5, 7, 8, 2), (None, 5, 7, 8, 0)}
