from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from depgraph.llm import quality
from tests.llm.conftest import DOCUMENTS, prose
from tests.llm.test_mixing import targets
from tests.llm.test_quality import rated
from tests.llm.test_shingle_join import brute, copies

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture
def tables(spark, tmp_path):
    """A folder with documents, labels and benchmark; the rows of documents."""
    pick = random.Random(1)
    item = prose(4242, 14, 5000)
    texts = [t for _, t, _ in rated(300)] + copies(1, 20, 80, 2) + copies(2, 8, 60, 1)
    texts += [f"{prose(900 + i, 30, 5000)} {item} {prose(950 + i, 30, 5000)}" for i in range(4)] + [None, "", "short"]
    rows = [(i, t, "en", pick.choice(["a", "a", "a", "b", "c", None]), len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(g != 1), int(g == 0)) for i, _, g in rated(300) if i % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_every_stage_against_plain_python(spark, tables):
    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    model = quality.train(docs, quality.ratings_of(spark.read.parquet(f"{folder}/labels.parquet")), 3)
    good = P.keep_good(spark, docs, folder)
    want = [r for r in rows if model.tails(quality.np.array([model.score(r[1])]))[0, 1] >= 0.5]
    assert good.columns == COLUMNS and ids(good) == [r[0] for r in want]

    first = P.keep_first_of_similar(spark, good, folder)
    groups = brute([r[1] for r in want], 5, 80)
    want = [want[i] for i, _, least, _ in groups if i == least]
    assert first.columns == COLUMNS and ids(first) == [r[0] for r in want]

    clean = P.drop_contaminated(spark, first, folder)
    item = " ".join(prose(4242, 14, 5000).split()[:10])
    want = [r for r in want if item not in (r[1] or "")]
    assert clean.columns == COLUMNS and ids(clean) == [r[0] for r in want]

    mixed = P.mix_to_targets(spark, clean, folder)
    assert mixed.columns == COLUMNS
    times = Counter(ids(mixed))
    assert max(times.values()) <= 3 and set(times) <= {r[0] for r in want}
    sizes, got = Counter(), Counter()
    for r in want:
        sizes[r[3]] += len((r[1] or "").split())
        got[r[3]] += times[r[0]] * len((r[1] or "").split())
    for source, target in targets(dict(sizes)).items():
        assert got[source] == pytest.approx(target, rel=0.2, abs=300)

    shards = P.assign_shards(spark, mixed, folder).collect()
    assert Counter(r.doc_id for r in shards) == times
    assert {r.doc_id: r.text for r in shards} == {r[0]: r[1] for r in want if r[0] in times}
    for k in range(P.SHARDS):
        slots = sorted(r.slot for r in shards if r.shard == k)
        assert slots == list(range(len(slots)))


def test_run_writes_and_rereads_every_stage(spark, tables):
    folder, _ = tables
    rows = P.run(spark, folder)
    assert rows.columns == [*COLUMNS, "shard", "slot"] and rows.count() > 0
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in P.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), schema=stage(spark, docs, folder).schema)
    assert sorted(map(str, rows.collect())) == sorted(map(str, docs.collect()))


def test_repeated_rows_null_numbers_and_extra_columns(spark, documents):
    text = prose(1, 40)
    docs = documents((1, text), (1, text), (2, text), (None, None), (None, None), (3, "x " * 30_000)).withColumn("kept", F.lit(1))
    first = P.keep_first_of_similar(spark, docs, "")
    assert first.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in first.collect()) == [0, 1, 3]
    placed = P.assign_shards(spark, docs, "").collect()
    assert sorted((r.doc_id or 0) for r in placed) == [0, 0, 1, 1, 2, 3]


def test_empty_documents(spark, empty, tables):
    folder, _ = tables
    docs = empty
    for _, stage in P.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.columns == [*COLUMNS, "shard", "slot"] and docs.count() == 0


def test_empty_labels_reject_no_document(spark, tables):
    from depgraph.llm.queries import op2_ordinal_quality

    folder, rows = tables
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    assert ids(P.keep_good(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)) == [r[0] for r in rows]
    assert op2_ordinal_quality(spark, folder).filter("keep").count() == len(rows)


def test_rows_without_or_with_one_number_are_mixed_one_by_one(spark, documents):
    rows = [(i if i % 3 else None, prose(i, 50 + i % 30), "abc"[i % 7 % 3]) for i in range(300)]
    rows += [(7, prose(1000 + i, 60), "c") for i in range(100)] + [(8, prose(3, 40), "b")] * 60 + [(None, None, "a")]
    mixed = P.mix_to_targets(spark, documents(*rows), "").collect()
    sizes, got = Counter(), Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    for r in mixed:
        got[r.source] += len((r.text or "").split())
    for source, target in targets(dict(sizes)).items():
        assert got[source] == pytest.approx(target, abs=64 + 2 * 80)
    texts = Counter(r.text for r in mixed if r.doc_id is None and r.source == "a")
    share = targets(dict(sizes))["a"] / sizes["a"]
    singles = [t for i, t, s in rows if i is None and s == "a" and t]
    assert texts[None] == 1 and 0 < share < 1 and 0 < sum(texts[t] > 0 for t in singles) < len(singles)


def test_near_copies_without_or_with_one_number_go(spark, documents):
    text, other, third = prose(1, 200, 5000), prose(2, 200, 5000), prose(3, 200, 5000)
    docs = documents(
        (3, text), (None, text + " end"), (None, text + " stop"), (None, other), (None, None), (None, ""),
        (None, third), (None, third + " end"), (5, prose(4, 200, 5000)), (5, text + " five"),
    )
    first = sorted(((r.doc_id, r.text) for r in P.keep_first_of_similar(spark, docs, "").collect()), key=str)
    left = [t for i, t in first if i is None and t and t.startswith(third)]
    want = [(3, text), (None, other), (None, None), (None, ""), (5, prose(4, 200, 5000)), *((None, t) for t in left)]
    assert len(left) == 1 and first == sorted(want, key=str)


def test_texts_of_one_checksum_and_rows_of_one_number_keep_their_columns(spark, documents):
    """plumless and buckeroo share their CRC-32 and length; rows may share number and text and differ in language."""
    import zlib

    assert zlib.crc32(b"plumless") == zlib.crc32(b"buckeroo")
    docs = documents((None, "plumless", "a"), (None, "buckeroo", "b"), (1, "same text", "a"), (1, "same text", "b"))
    docs = docs.withColumn("lang", F.when(F.col("source") == "a", "en").otherwise("fr"))
    placed = P.assign_shards(spark, docs, "").collect()
    assert sorted(((r.doc_id, r.text, r.lang, r.source) for r in placed), key=str) == [
        (1, "same text", "en", "a"), (1, "same text", "fr", "b"), (None, "buckeroo", "fr", "b"), (None, "plumless", "en", "a"),
    ]


def test_columns_with_names_of_intermediate_ones_come_back_as_they_were(spark, tables):
    folder, _ = tables
    names = ["_row", "_copy", "_copies", "_id", "_crc", "_bytes", "_grade", "_graded", "row", "number", "copies", "mark", "key", "slot_"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id > 250 OR doc_id % 10 = 0")
    odd = docs.select("*", *(F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")).alias(n) for n in names))
    for number, (_, stage) in enumerate(P.STAGES):
        odd = stage(spark, odd, folder)
        rows = odd.collect()
        assert odd.columns == [*COLUMNS, *names, *(["shard", "slot"] if number == 4 else [])]
        assert rows and all(r[n] == f"{n} of {r.doc_id}" for r in rows for n in names)
