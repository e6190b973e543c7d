from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from depgraph.llm import mixing
from tests.llm.conftest import prose


def targets(sizes: dict, factor=3):
    """Shares by weight; what exceeds factor x size goes to the others, until none is above."""
    names = sorted((n for n in sizes if n is not None)) + [n for n in sizes if n is None]
    weight = {n: i % 3 + 1 for i, n in enumerate(names)}
    capped: dict = {}
    while True:
        free = sum(sizes.values()) - sum(capped.values())
        rest = [n for n in names if n not in capped]
        out = {n: weight[n] * free / sum(weight[m] for m in rest) for n in rest}
        over = [n for n in rest if out[n] >= factor * sizes[n]]
        if not over:
            return {**capped, **out}
        capped.update({n: factor * sizes[n] for n in over})


def corpus(documents, counts: dict, words=120):
    rows, i = [], 0
    for source, n in counts.items():
        for _ in range(n):
            rows.append((i, prose(i, words + i % 50), source))
            i += 1
    return documents(*rows), rows


@pytest.mark.parametrize("counts", [
    {"a": 40, "b": 10, "c": 25, None: 6}, {"one": 20}, {"Z": 200, "a": 3, "é": 9, "b": 1},
])
def test_targets_and_taken_words(spark, documents, counts):
    docs, rows = corpus(documents, counts)
    mix = mixing.mix_sources(docs)
    taken = {r.doc_id: r for r in mixing.taken_words(mix).collect()}
    assert len(taken) == len(rows)
    sizes, got = defaultdict(int), defaultdict(int)
    for i, text, source in rows:
        assert taken[i]["size"] == len(text.split())
        assert 0 <= taken[i].taken <= 3 * taken[i]["size"]
        sizes[source] += taken[i]["size"]
        got[source] += taken[i].taken
    want = targets(dict(sizes))
    for i, _, source in rows:
        assert taken[i].source_size == sizes[source]
        assert taken[i].target == pytest.approx(want[source])
    for source, target in want.items():
        assert abs(got[source] - target) <= 1


def test_slots_fill_shards_and_blocks_follow_permutations(spark, documents):
    docs, rows = corpus(documents, {"a": 300, "b": 40, "c": 60})
    mix = mixing.mix_sources(docs, block_words=16, shard_blocks=64)
    slots = mix.slots.collect()
    per_shard, uses = defaultdict(int), defaultdict(list)
    for s in slots:
        per_shard[s.shard] += 1
        uses[s.src, s.epoch].append(s.block)
    last = max(per_shard)
    assert all(n == 64 for shard, n in per_shard.items() if shard < last)
    assert all(len(set(b)) == len(b) for b in uses.values())  # an epoch takes no block twice
    assert any(b != sorted(b) for b in uses.values())
    counts = {tuple(sorted((src, sum(s.src == src for s in slots if s.shard == k)) for src in range(3))) for k in range(5)}
    assert len(counts) > 1  # source counts vary from shard to shard


def test_blocks_hold_the_words_of_their_source_in_order(spark, documents):
    docs, rows = corpus(documents, {"a": 7, "b": 4})
    mix = mixing.mix_sources(docs, block_words=32)
    stream = {0: [], 1: []}
    for _, text, source in rows:
        stream["ab".index(source)] += text.split()
    for r in mixing.mixed_blocks(mix, docs).collect():
        block = stream[r.src][32 * r.block:32 * r.block + 32]
        assert r.text.split() == block[:r.words] and r.full == (r.words == len(block))


@pytest.mark.parametrize("words, block_words", [(40, 64), (1, 64), (7, 3), (200, 64)])
def test_small_sources_meet_their_targets(spark, documents, words, block_words):
    """Twelve sources of a few words each: a whole block more or less would miss the target by far."""
    rows = [(i, " ".join(f"w{j}" for j in range(words)), f"s{i:02d}") for i in range(12)] + [(99, None, "zz"), (100, "one", None)]
    mix = mixing.mix_sources(documents(*rows), block_words=block_words)
    got = defaultdict(int)
    for r in mixing.taken_words(mix).collect():
        assert r.taken <= 3 * r["size"]
        got[r.doc_id] += r.taken
    want = targets({**{s: words for _, _, s in rows[:12]}, "zz": 0, None: 1})
    for i, _, source in rows:
        assert abs(got[i] - want[source]) <= 0.5 + 1e-9


def test_taken_words_against_slots_and_spans(spark, documents):
    """Word by word: every slot takes the first words of its block; a document's are those that lie in it."""
    docs, rows = corpus(documents, {"a": 30, "b": 6, "c": 90, None: 2}, words=25)
    mix = mixing.mix_sources(docs, block_words=16, shard_blocks=32)
    owner = {}  # (source, place in the source's stream) -> document
    start = defaultdict(int)
    for d in sorted(mix.documents.collect(), key=lambda r: (r.src, r.first)):
        assert d.first == start[d.src]
        for k in range(d["size"]):
            owner[d.src, d.first + k] = d.doc_id
        start[d.src] += d["size"]
    taken, cut = defaultdict(int), defaultdict(int)
    for s in mix.slots.collect():
        own = [owner[s.src, k] for k in range(16 * s.block, min(16 * s.block + 16, start[s.src]))]
        assert 0 <= s.words <= len(own) and s.full == (s.words == len(own))
        cut[s.src] += not s.full
        for doc in own[:s.words]:
            taken[doc] += 1
    assert max(cut.values()) <= 2
    assert {r.doc_id: r.taken for r in mixing.taken_words(mix).collect()} == {i: taken[i] for i, _, _ in rows}


def test_the_way_back_through_the_permutation(spark):
    from pyspark.sql import functions as F

    frame = spark.range(50).withColumn("size", F.lit(50))
    there = frame.withColumn("to", mixing._shuffled(F.col("id"), F.col("size"), 5, F.lit(3)))
    back = there.withColumn("back", mixing._shuffled(F.col("to"), F.col("size"), 5, F.lit(3), back=True)).collect()
    assert all(r.back == r.id for r in back) and sorted(r.to for r in back) == list(range(50))


def test_same_mix_in_every_run(spark, documents):
    docs, _ = corpus(documents, {"a": 30, "b": 10})
    first, second = (sorted(map(tuple, mixing.taken_words(mixing.mix_sources(d)).select("doc_id", "taken").collect())) for d in (docs, docs.repartition(7)))
    assert first == second


def test_nulls_repeated_rows_and_long_text(spark, documents):
    docs = documents((1, None, "a"), (2, "", None), (3, "x y", "a"), (3, "x y", "a"), (None, "z " * 30_000, "b")).withColumn("src", F.lit("clash"))
    got = mixing.taken_words(mixing.mix_sources(docs)).collect()
    assert sorted((r.doc_id or 0, r["size"]) for r in got) == [(0, 30_000), (1, 0), (2, 0), (3, 2), (3, 2)]
    assert all(r.taken <= 3 * r["size"] for r in got)


def test_empty_table(spark, empty):
    mix = mixing.mix_sources(empty)
    assert mixing.taken_words(mix).count() == 0 and mix.slots.count() == 0
