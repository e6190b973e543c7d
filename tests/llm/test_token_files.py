from __future__ import annotations

import os
import random

import numpy as np
import pytest

from depgraph.llm import token_files as T
from tests.llm.conftest import prose


def lengths(stream, ends):
    """(start, length, closed) of the documents of a stream."""
    out, start = [], 0
    for i, token in enumerate(stream):
        if token in ends:
            out.append((start, i - start, True))
            start = i + 1
    if start < len(stream):
        out.append((start, len(stream) - start, False))
    return out


@pytest.mark.parametrize("block_bytes", [2, 6, 64, 1 << 20])
def test_counts_of_flat_files_match_a_plain_scan(spark, tmp_path, block_bytes):
    pick = random.Random(7)
    streams = {"a": [9], "b": [], "c": [9, 9, 1, 2, 9], "d": [1] * 40, "e": [pick.choice([1, 2, 3, 4, 9]) for _ in range(300)], "f": [1] * 90 + [9]}
    for name, stream in streams.items():
        (tmp_path / f"{name}.bin").write_bytes(np.array(stream, dtype="<u2").tobytes() + (b"\x01" if name == "e" else b""))
    blocks = T.read_token_files(spark, str(tmp_path), 2, block_bytes)
    got = {}
    for r in T.token_counts(blocks, (9,), 2).orderBy("file", "document").collect():
        own = got.setdefault(os.path.basename(r.file)[0], [])
        assert r.document == len(own)
        own.append((r.start, r.n_tokens, r.closed))
    assert got == {k: w for k, v in streams.items() if (w := lengths(v, {9}))}


def test_wide_tokens_and_several_ends(spark):
    stream = [5, 70000, 8, 70001, 1, 1]
    data = np.array(stream, dtype="<u4").tobytes()
    blocks = spark.createDataFrame([("x", 0, data[:8]), ("x", 1, None), ("x", 2, data[8:])], "file string, block long, data binary")
    got = T.token_counts(blocks, (70000, 70001), 4).orderBy("document").collect()
    assert [(r.start, r.n_tokens, r.closed) for r in got] == lengths(stream, {70000, 70001})


@pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="no public tokenizer on this machine")
@pytest.mark.parametrize("block_bytes, leave_open", [(8, False), (6, True), (1 << 20, True)])
def test_written_files_give_the_tokenizers_counts(spark, documents, block_bytes, leave_open):
    from pyspark.sql import functions as F

    texts = [prose(i, i % 30) for i in range(50)] + [None, "", "<|endoftext|>", "é ü 你好", "x" * 20_000, "the last"]
    docs = documents(*enumerate(texts)).withColumn("file", F.lit(1)).repartition(3)
    written = T.write_token_files(docs, leave_open=leave_open)
    counts = T.token_counts(T.token_blocks(written.files, block_bytes=block_bytes))
    # an open last document without tokens leaves no trace in its file
    rows = T.document_names(written.names).join(counts, ["file", "document"], "left").collect()
    with open(T.VOCABULARY, "rb") as lines:
        encoder = T._encoder(lines.read(), T.PATTERN)
    wanted = {i: len(encoder.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens or 0 for r in rows} == wanted and len(rows) == len(texts)
    assert sum(not r.closed for r in rows) == (3 if leave_open else 0)


@pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="no public tokenizer on this machine")
def test_files_hold_nothing_but_tokens(spark, documents):
    texts = [prose(i, 20) for i in range(30)]
    written = T.write_token_files(documents(*enumerate(texts)).coalesce(1))
    (file,) = written.files.collect()
    raw = open(file.file.removeprefix("file:"), "rb").read()
    assert len(raw) == file.bytes
    with open(T.VOCABULARY, "rb") as lines:
        encoder = T._encoder(lines.read(), T.PATTERN)
    assert np.frombuffer(raw, "<u2").tolist() == [x for t in texts for x in [*encoder.encode_ordinary(t), T.END]]
    blocks = T.token_blocks(written.files, block_bytes=64)
    assert blocks.rdd.getNumPartitions() > 1 and blocks.count() == -(-len(raw) // 64)  # one file over several tasks


@pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="no public tokenizer on this machine")
def test_repeated_rows_null_numbers_and_empty_table(spark, documents, empty):
    written = T.write_token_files(documents((1, "a"), (1, "a"), (None, "b c")).coalesce(1))
    counts = T.token_counts(T.token_blocks(written.files))
    named = counts.join(T.document_names(written.names), ["file", "document"]).collect()
    assert sorted((r.doc_id or 0) for r in named) == [0, 1, 1]
    assert T.token_counts(T.token_blocks(T.write_token_files(empty).files)).count() == 0


@pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="no public tokenizer on this machine")
def test_rows_of_documents_are_never_broadcast(spark, documents, tmp_path):
    """Tables of arrays look small; their rows, one a document, do not fit the driver of a large corpus."""
    from depgraph.llm.queries import op9_separator_scan

    documents((1, "a"), (2, None), (3, "b c"), (3, "b c")).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    found = op9_separator_scan(spark, str(tmp_path))
    assert sorted((r.doc_id, r.n_tokens) for r in found.collect()) == [(1, 1), (2, 0), (3, 2), (3, 2)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
