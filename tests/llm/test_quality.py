from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from depgraph.llm import quality as Q
from tests.llm.conftest import prose


def rated(n, first=0):
    """(doc_id, text, grade): insults make grade 0, junk grade 1, the rest grade 2."""
    pick = random.Random(first)
    out = []
    for i in range(first, first + n):
        words, grade = prose(i, 60 + i % 80).split(), pick.choice([0, 1, 2, 2, 2])
        if grade == 0:
            for _ in range(4):
                words.insert(pick.randrange(len(words)), pick.choice(["vile", "awful", "nasty"]))
        if grade == 1:
            words = [w + "!!" for w in words] if i % 2 else [words[0]] * len(words)
        out.append((i, " ".join(words), grade))
    return out


def test_held_out_grades(spark, documents):
    train, held = rated(900), rated(300, 2000)
    model = Q.train(documents(*(r[:2] for r in train)), spark.createDataFrame([(i, g) for i, _, g in train], "doc_id long, grade int"), 3)
    assert model.thresholds[0] < model.thresholds[1]
    rows = {r.doc_id: r.quality for r in Q.grade(documents(*(r[:2] for r in held)), model, ["doc_id"]).collect()}
    right = sum((rows[i].tails[1] >= 0.5) == (g == 2) for i, _, g in held)
    assert right >= 0.97 * len(held)
    means = [np.mean([rows[i].expected_grade for i, _, g in held if g == k]) for k in range(3)]
    assert means == sorted(means)
    for r in rows.values():
        assert 1 >= r.tails[0] >= r.tails[1] >= 0 and abs(sum(r.tails) - r.expected_grade) < 1e-12


def test_fit_is_a_minimum_of_the_penalised_likelihood():
    pick = np.random.default_rng(2)
    grades = pick.integers(0, 3, 120)
    rows = [(np.array([g, 3 + i % 4]), np.ones(2)) for i, g in enumerate(grades)]
    model = Q.fit(rows, grades, 3)
    scores = np.array([model.weights[s] @ v for s, v in rows])
    tails = np.column_stack([np.ones(len(rows)), model.tails(scores), np.zeros(len(rows))])
    chance = (tails[:, :-1] - tails[:, 1:])[np.arange(len(rows)), grades]
    assert chance.mean() > 0.8


def _likelihood(levels, seed, penalty=1e-2):
    draw = np.random.default_rng(seed)
    rows = 80
    owner = np.repeat(np.arange(rows), 4)
    slots = draw.integers(0, 9, len(owner))
    return Q.Likelihood(slots, draw.uniform(0.2, 2, len(owner)), owner, draw.integers(0, levels, rows), levels, penalty), draw


@pytest.mark.parametrize("levels", [2, 3, 5])
def test_gradient_by_finite_differences(levels):
    likelihood, draw = _likelihood(levels, levels)
    w, gaps = draw.normal(0, 0.5, 9), draw.normal(0, 0.5, levels - 1)
    g_w, g_g = likelihood.gradient(w, gaps)
    for x, g in ((w, g_w), (gaps, g_g)):
        for i in range(len(x)):
            old, values = x[i], []
            for moved in (old + 1e-6, old - 1e-6):
                x[i] = moved
                values.append(likelihood.value(w, gaps))
            x[i] = old
            assert abs((values[0] - values[1]) / 2e-6 - g[i]) < 1e-6


def test_likelihood_by_hand():
    """Two rows: P(grade 0) = 1 - sigmoid(s - t0), P(grade 1) = sigmoid(s - t0) - sigmoid(s - t1)."""
    likelihood = Q.Likelihood(np.array([0, 0]), np.array([1.0, 2.0]), np.array([0, 1]), np.array([0, 1]), 3, 0.5)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    w, gaps = np.array([0.7]), np.array([0.2, np.log(1.5)])
    assert np.allclose(Q.thresholds_of(gaps), [0.2, 1.7])
    p = np.array([1 - sigmoid(0.7 - 0.2), sigmoid(1.4 - 0.2) - sigmoid(1.4 - 1.7)])
    weight = np.sqrt(5 / 3 / np.array([2, 2]))
    assert np.isclose(likelihood.value(w, gaps), -(weight * np.log(p)).sum() / 2 + 0.25 * 0.49)


@pytest.mark.parametrize("one_sided", [True, False])
def test_fit_ends_at_the_minimum(one_sided):
    """No step in any allowed direction lowers the loss; a word that only good texts have counts if signs are free."""
    draw = np.random.default_rng(3)
    grades = draw.integers(0, 3, 400)
    bad, good = Q._SHAPES + 5, Q._SHAPES + 9
    rows = []
    for g in grades:
        slots = [0] + [bad] * (draw.random() < (0.8, 0.4, 0.1)[g]) + [good] * (draw.random() < (0.1, 0.4, 0.8)[g])
        rows.append((np.array(slots), np.ones(len(slots))))
    model = Q.fit(rows, grades, 3, one_sided, steps=3000)
    assert model.weights[bad] < -0.5 and (model.weights[good] > 0.5) == (not one_sided)
    assert one_sided <= (model.weights[good] == 0)
    entries = np.concatenate([s for s, _ in rows])
    places = {bad: 0, good: 1}
    kept = np.isin(entries, [bad, good])
    owner = np.repeat(np.arange(len(rows)), [len(s) for s, _ in rows])[kept]
    likelihood = Q.Likelihood(np.array([places[e] for e in entries[kept]]), np.ones(kept.sum()), owner, grades, 3)
    w, t = model.weights[[bad, good]], model.thresholds
    gaps = np.array([t[0], np.log(t[1] - t[0])])
    least = likelihood.value(w, gaps)
    for i in range(4):
        for move in (1e-2, -1e-2):
            x = np.concatenate([w, gaps])
            x[i] += move
            if not (one_sided and x[:2].max() > 0):
                assert likelihood.value(x[:2], x[2:]) > least - 1e-7


def test_sample_bound_and_strange_ratings(spark, documents):
    train = rated(60)
    ratings = [(i, g) for i, _, g in train] + [(None, 1), (3, None), (5, 9), (999, 2), (4, 0), (4, 0)]
    model = Q.train(documents(*(r[:2] for r in train)), spark.createDataFrame(ratings, "doc_id long, grade int"), 3, sample_rows=20)
    assert np.isfinite(model.weights).all() and np.isfinite(model.thresholds).all()


def test_nulls_long_texts_repeated_rows_and_clashing_columns(spark, documents):
    model = Q.fit([], np.zeros(0, dtype=np.int64), 3)
    docs = documents((1, None), (2, ""), (3, "a " * 60_000), (3, "a " * 60_000)).withColumn("quality", F.lit(5))
    got = Q.grade(docs, model).collect()
    assert len(got) == 4 and all(0 <= r.quality.expected_grade <= 2 for r in got)


def test_ratings_of_other_tables_do_not_fill_the_sample(spark, documents):
    train = rated(200)
    ratings = [(i, g) for i, _, g in train] + [(i, 2) for i in range(10_000, 14_000)]
    docs, rates = documents(*(r[:2] for r in train)), spark.createDataFrame(ratings, "doc_id long, grade int")
    own = Q.train(docs, rates.filter("doc_id < 10000"), 3, sample_rows=200)
    model = Q.train(docs, rates, 3, sample_rows=200)
    assert model.separates and np.array_equal(model.weights, own.weights) and np.array_equal(model.thresholds, own.thresholds)


def test_repeated_rows_do_not_displace_the_highest_grade(spark, documents):
    train = rated(200)
    docs = documents(*(r[:2] for r in train))
    bad = [r[:2] for r in train if r[2] == 0]
    more = documents(*(r[:2] for r in train), *(bad[:1] * 500), *bad * 5)
    ratings = spark.createDataFrame([(i, g) for i, _, g in train], "doc_id long, grade int")
    once, often = Q.train(docs, ratings, 3, sample_rows=200), Q.train(more, ratings, 3, sample_rows=200)
    assert often.separates and np.array_equal(once.weights, often.weights) and np.array_equal(once.thresholds, often.thresholds)


def test_without_good_and_worse_rows_nothing_is_rejected(spark, documents):
    docs = documents((1, "a b"), (2, None), (3, "c"))
    for ratings in ([], [(9, 0), (8, 2)], [(1, 0)], [(1, 0), (3, 1)], [(1, 2)]):
        model = Q.train(docs, spark.createDataFrame(ratings, "doc_id long, grade int"), 3)
        assert not model.separates
        assert Q.grade(docs, model).filter(Q.good(model, F.col("quality.tails"), 0.5)).count() == 3


def test_empty_tables(spark, empty):
    none = spark.createDataFrame([], "doc_id long, grade int")
    model = Q.train(empty, none, 3)
    assert Q.grade(empty, model).count() == 0


def test_ratings_of_labels(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (4, None, None), (5, 0, 1)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, Q.ratings_of(labels).collect())) == [(1, 2), (2, 1), (3, 0), (4, 2), (5, 0)]
