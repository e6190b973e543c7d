from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from depgraph.llm import chat as C
from tests.llm.conftest import prose

SCHEMA = "conv_id long, turn long, role string, text string"


def talk(conv, n, system=False):
    roles = (["system"] if system else []) + ["user", "assistant"] * n
    return [(conv, i, r, "\n".join(prose(97 * conv + i + k, 6 + 5 * (r == "assistant"), 50) for k in range(1 + (conv + i) % 3)) + ("?" if r == "user" else "."))
            for i, r in enumerate(roles[:n])]


@pytest.fixture
def conversations(spark):
    return lambda rows: spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def model(conversations):
    data = [r for c in range(80) for r in talk(c, 2 + c % 7, c % 4 == 0)]
    return C.fit(C.transcript_lines(C.as_transcripts(conversations(data))))


def test_held_out_roles(conversations, model):
    data = [r for c in range(1000, 1060) for r in talk(c, 2 + c % 7, c % 4 == 0)]
    found = C.recover_roles(C.transcript_lines(C.as_transcripts(conversations(data))), model).collect()
    right = sum(r.role == r.found_role for r in found)
    assert right >= 0.9 * len(found)


def test_plain_markers_give_the_turns_back(conversations, model):
    text = "System: be kind\nUser: hi\nwhat is it?\n\nAssistant: a thing\nUser: ok\nAssistant: bye"
    found = C.canonical(C.recover_roles(C.transcript_lines(conversations([(1, 0, None, text)])), model)).orderBy("at").collect()
    assert "\n".join(r.piece for r in found) == (
        "<|system|>\nbe kind<|end|>\n<|user|>\nhi\nwhat is it?\n<|end|>\n<|assistant|>\na thing<|end|>\n<|user|>\nok<|end|>\n<|assistant|>\nbye"
        .replace("kind<", "kind\n<").replace("?\n<", "?\n\n<").replace("thing<", "thing\n<").replace("ok<", "ok\n<")
    )
    assert [r.message for r in found] == [0, 1, 1, 1, 2, 3, 4]


def brute_score(model, scores, path):
    total = model.start[path[0]] + scores[0][path[0]]
    for i in range(1, len(path)):
        total += model.move[path[i - 1], path[i]] + scores[i][path[i]]
    return total


def test_pieces_of_a_long_conversation_decode_as_one(spark, conversations, model, monkeypatch):
    data = talk(5, 200, True) + [r for c in range(10, 14) for r in talk(c, 5)]
    lines = C.transcript_lines(C.as_transcripts(conversations(data)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = C.recover_roles(lines, model).orderBy("conv", "turn", "at").toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    whole = lines.orderBy("conv", "turn", "at").toPandas()
    for conv, own in found.groupby("conv"):
        scores = model.scores(whole[whole["conv"] == conv])
        best = C.decode(model, scores)
        path = own["state"].to_numpy()
        assert brute_score(model, scores, path) == pytest.approx(brute_score(model, scores, best))
        assert own["message"].tolist() == (np.cumsum(path % 2 == 0) - 1).tolist()


def test_viterbi_against_all_paths(model):
    from itertools import product

    lines = pd.DataFrame({"marker": [4, 0, 0, 3], "blank": [0, 1, 0, 0], "length": [1, 0, 2, 3], "ending": [0, 0, 1, 0]})
    scores = model.scores(lines)
    best = max((brute_score(model, scores, p) for p in product(range(6), repeat=4)))
    assert brute_score(model, scores, C.decode(model, scores)) == pytest.approx(best)
    a, b = C.piece_matrix(model, scores[:2], True), C.piece_matrix(model, scores[2:], False)
    assert (a[0][:, None] + b).max() == pytest.approx(best)


def test_nulls_repeats_long_text_and_empty_table(spark, conversations, model):
    data = [(None, 0, "user", "a"), (None, None, None, None), (1, 0, "user", ""), (1, 1, "user", "x\n" * 5000), (2, 0, "robot", "b"), (2, 0, "robot", "b")]
    table = conversations(data).withColumn("state", F.lit(1)).withColumn("line", F.lit("clash"))
    lines = C.transcript_lines(table)
    found = C.canonical(C.recover_roles(lines, C.fit(lines))).collect()
    assert len(found) == 1 + 1 + 1 + 5001 + 2
    assert {r.found_role for r in found} <= set(C.ROLES)
    empty = C.transcript_lines(conversations([]))
    assert C.recover_roles(empty, C.fit(empty)).count() == 0
