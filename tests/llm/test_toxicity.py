"""Weak supervision of toxicity: voters, label model, classifier, and held-out accuracy."""

from __future__ import annotations

import itertools
import math
import os
import random
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from depgraph.llm import toxicity as T
from depgraph.llm.queries import QUERIES

LABELS = "doc_id long, toxic int"


def invented(count: int, seed: int = 3):
    """(doc_id, text, toxic): prose of a few hundred words; a sixth has some of six bad words, or words that
    begin with one of two bad beginnings."""
    draw = random.Random(seed)
    bad = ["zorg", "blarg", "Quux", "frobbed", "SNARK", "wibble"]
    rows = []
    for i in range(count):
        words = [f"{draw.choice('abcdefgh')}{draw.choice('mnopqrs')}{int(300 * draw.random() ** 2)}" for _ in range(draw.randrange(15, 120))]
        toxic = draw.random() < 1 / 6
        for _ in range(draw.randrange(2, 6) if toxic else 0):
            word = draw.choice(bad) if draw.random() < 0.6 else f"{draw.choice(['grükl', 'plomf'])}{draw.randrange(5000)}"
            words.insert(draw.randrange(len(words)), word + draw.choice(["", ",", "!"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def learned(spark):
    rows = invented(1500)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], LABELS)
    detector = T.train(docs, labels.filter(~T.is_held_out(F.col("doc_id"))))
    return rows, docs, detector


def test_held_out_documents_are_told_apart(learned):
    rows, docs, detector = learned
    scores = {r.doc_id: r.toxicity for r in T.score(docs, detector, carry=["doc_id"]).collect()}
    held = [(i, x) for i, _, x in rows if crc32(str(i).encode()) % 3 == 1]
    assert 400 < len(held) < 600
    right = sum((scores[i] >= 0.7) == bool(x) for i, x in held)
    assert right >= 0.97 * len(held)
    assert not any(scores[i] >= 0.7 for i, x in held if not x)
    fresh = "some plain words then PLOMF99123, and grükl777777 at last"
    assert detector.classifier.score(fresh) > 0.5 > detector.classifier.score("some plain words at last")
    assert detector.classifier.score(None) == detector.classifier.score("") < 0.1


def test_voters_and_their_accuracies(learned):
    rows, _, detector = learned
    votes = np.array([[detector.voters.votes(t) >> j & 1 for j in range(len(detector.voters.names))] for _, t, _ in rows])
    toxic = np.array([x for _, _, x in rows])
    for j, (sensitivity, specificity) in enumerate(detector.accuracies):
        assert abs(sensitivity - votes[toxic == 1, j].mean()) < 0.08
        assert abs(specificity - (1 - votes[toxic == 0, j].mean())) < 0.03
    assert (detector.label_model.parents >= 0).any()  # lists that share words are tied
    assert {b"zorg", b"quux", b"snark"} <= detector.voters.words.keys()
    assert detector.voters.votes("") == detector.voters.votes(None) == 0
    shown = {n for j, n in enumerate(detector.voters.names) if detector.voters.votes("ZORG ALL QUUX!! 12 34") >> j & 1}
    assert {"many_words", "shouting", "sign_runs", "digits"} <= shown and "repeats" not in shown


def _sampled_model(rows, seed=1):
    """Votes drawn from a known model: voter 2 copies voter 1 in most rows of either class."""
    draw = np.random.default_rng(seed)
    toxic = (draw.random(rows) < 0.3).astype(int)
    rates = np.array([[0.05, 0.8], [0.1, 0.7], [0.1, 0.7], [0.02, 0.6], [0.2, 0.75], [0.5, 0.5]])
    votes = (draw.random((rows, 6)) < rates[:, toxic].T).astype(int)
    copy = draw.random(rows) < 0.9
    votes[copy, 2] = votes[copy, 1]
    given = np.where(draw.random(rows) < 0.1, toxic, -1)
    return votes, given, toxic, rates


def test_label_model_finds_accuracies_and_the_tie(spark, monkeypatch):
    votes, given, toxic, rates = _sampled_model(20_000)
    bits = votes @ (1 << np.arange(6))
    monkeypatch.setattr(T, "LEXICONS", 3)
    monkeypatch.setattr(T, "PATTERNS", 3)
    patterns = spark.createDataFrame(list(zip(bits.tolist(), given.tolist())), "bits long, given long").groupBy("bits", "given").agg(F.count("*").alias("n"))
    model, sums = T.fit_label_model(patterns.repartition(5), 6, rounds=25)
    assert abs(model.share[1] - 0.3) < 0.02
    found = np.array(model.accuracies(sums))
    assert np.abs(found[:, 0] - rates[:, 1]).max() < 0.05 and np.abs(found[:, 1] - (1 - rates[:, 0])).max() < 0.03
    assert model.parents[2] == 1 or model.parents[1] == 2
    strength = T.ties(sums)
    assert strength[1, 2] > 10 * max(strength[i, j] for i, j in itertools.combinations(range(6), 2) if (i, j) != (1, 2))
    hidden = model.posterior(votes, np.full(len(votes), -1))
    assert ((hidden > 0.5) == toxic).mean() > 0.93


def test_posterior_is_bayes_rule():
    draw = np.random.default_rng(2)
    model = T.LabelModel(np.array([0.6, 0.4]), np.array([0.1, 0.9]), np.array([-1, 0, 1, -1]), draw.uniform(0.1, 0.9, (4, 2, 2)))
    votes = np.array(list(itertools.product((0, 1), repeat=4)))
    for told in (-1, 0, 1):
        for row, p in zip(votes, model.posterior(votes, np.full(16, told))):
            joint = []
            for c in (0, 1):
                x = model.share[c]
                for j, v in enumerate(row):
                    a = row[model.parents[j]] if model.parents[j] >= 0 else 0
                    x *= model.rates[j, a, c] if v else 1 - model.rates[j, a, c]
                joint.append(x if told < 0 else x * (model.given[c] if told else 1 - model.given[c]))
            assert math.isclose(p, joint[1] / sum(joint), rel_tol=1e-9)


def test_rounds_never_lower_the_likelihood():
    votes, given, _, _ = _sampled_model(2000, 5)
    n = np.ones(len(votes))
    toxic = np.where(votes.sum(axis=1) > 2, 0.8, 0.1)
    parents, values = np.array([-1, -1, 1, -1, -1, -1]), []
    for _ in range(15):
        model = T.maximise(T.Sums.of(votes, given, n, toxic), parents)
        toxic = model.posterior(votes, given)
        score = 0.0
        for c in (0, 1):
            before = np.where(parents >= 0, votes[:, parents], 0)
            rate = model.rates[np.arange(6)[None, :], before, c]
            told = np.where(given == 1, model.given[c], np.where(given == 0, 1 - model.given[c], 1.0))
            score = score + model.share[c] * np.where(votes == 1, rate, 1 - rate).prod(axis=1) * told
        values.append(np.log(score).sum())
    assert all(b >= a - 0.5 for a, b in zip(values, values[1:])) and values[-1] > values[0]


def test_sums_survive_their_flat_form():
    votes, given, toxic, _ = _sampled_model(50)
    sums = T.Sums.of(votes, given, np.ones(50), toxic * 0.7)
    back = T.Sums.unflat(sums.flat(), 6)
    assert all((getattr(sums, k) == getattr(back, k)).all() for k in ("total", "ones", "pairs", "told"))


def test_classifier_is_at_the_minimum_of_its_loss():
    draw = np.random.default_rng(4)
    keys = [b"k%d " % i for i in range(6)]
    rows = [np.flatnonzero(draw.random(6) < 0.4) for _ in range(600)]
    logit = np.array([(2 * (0 in r)) - 1.5 * (1 in r) - 0.5 for r in rows])
    toxic, weight = 1 / (1 + np.exp(-logit)), draw.uniform(0.5, 2, 600)
    model = T.fit_classifier(keys, rows, toxic, weight, steps=3000, sparsity=1e-3)
    assert model.words.keys() == {b"k0", b"k1"} and not model.beginnings

    def loss(intercept, w):
        s = np.array([intercept + sum(w.get(keys[k][:-1], 0.0) for k in r) for r in rows])
        p = 1 / (1 + np.exp(-s))
        return (weight / weight.sum()) @ -(toxic * np.log(p) + (1 - toxic) * np.log(1 - p)) + 1e-3 * sum(map(abs, w.values()))

    least = loss(model.intercept, model.words)
    for step in (0.01, -0.01):
        assert loss(model.intercept + step, model.words) > least
        for key in (b"k0", b"k1"):
            assert loss(model.intercept, {**model.words, key: model.words[key] + step}) > least


def test_copies_of_one_text_count_once(spark, documents):
    """Three hundred copies of a toxic text do not make its odd words bad ones."""
    rows = invented(600, 9)
    copied = " ".join(f"odd{i}" for i in range(60)) + " zorg blarg"
    rows += [(10_000 + i, copied + (" x" if i % 7 == 0 else ""), 1) for i in range(300)]
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], LABELS)
    detector = T.train(documents(*((i, t) for i, t, _ in rows)), labels)
    assert detector.classifier.score("plain words and odd1 odd2 odd3 odd40") < 0.2
    assert detector.classifier.score("plain words, zorg and blarg") > 0.7  # toxic texts have two bad words at least


def test_labels_that_cannot_be_learned_from(spark, documents, empty):
    docs = documents((1, "one two"), (2, None), (None, "zorg"))
    for labels in ([], [(1, 0)], [(1, 1)], [(None, 1), (2, None), (99, 1)], [(1, 1), (2, 0)]):
        detector = T.train(docs, spark.createDataFrame(labels, LABELS))
        assert [r.toxicity for r in T.score(docs, detector).collect()] == [0.0] * 3
    assert T.score(empty, T.train(empty, spark.createDataFrame([], LABELS))).collect() == []


def test_other_columns_stay(learned):
    _, docs, detector = learned
    odd = docs.limit(3).withColumnsRenamed({"lang": "toxicity", "source": "bits"})
    scored = T.score(odd, detector)
    assert scored.columns == ["doc_id", "text", "bits", "n_chars", "toxicity"]
    assert scored.schema["toxicity"].dataType.simpleString() == "double" and scored.count() == 3


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="test tables are not mounted")
def test_query_on_held_out_documents(spark):
    folder = os.path.join(os.path.dirname(entry_points.SMOKE_DIR), "sf0.1")
    result = QUERIES["op11_weak_toxicity"](spark, folder)
    assert result.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = result.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id", "left").collect()
    assert len(rows) == 10_000 and all(r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out and r.toxic is not None]
    caught = [r for r in held if r.predicted and r.toxic]
    assert len(caught) >= 0.8 * sum(r.toxic for r in held)
    assert sum(r.predicted and not r.toxic for r in held) <= 0.01 * len(held)
