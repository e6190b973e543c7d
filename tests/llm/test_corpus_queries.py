"""The registered corpus queries: against their SQL, and their contracts on the smallest tables."""

from __future__ import annotations

import os
import zlib
from collections import defaultdict

import duckdb
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from depgraph.llm.queries import ORACLES, QUERIES

SF_DIR = entry_points.SMOKE_DIR
mounted = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not mounted")

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long, shard int, quality string, copies string",
    "labels": "doc_id long, quality int, toxic int, grade string",
    "benchmark": "item_id long, text string, window int",
    "pages": "page_id long, url string, html string, host int, verdict string",
    "conversations": "conv_id long, turn long, role string, text string, line string, state int",
}
LONG = "long words " * 20_000
ODD = {
    "documents": [
        (None, None, None, None, None, None, None, None), (1, None, None, "a", None, 1, "x", "k"), (2, "", "en", None, 0, 1, "x", "k"),
        (3, "same text", "en", "a", 9, 1, "x", "k"), (3, "same text", "en", "a", 9, 1, "x", "k"), (4, "same text", "en", "b", 9, 1, "x", "k"),
        (50, LONG, "en", "b", len(LONG), 1, "x", "k"), (100, "é ü\n|", "fr", "é", 5, 1, "x", "k"), (None, "no number", "en", "a", 9, 1, "x", "k"),
    ],
    "labels": [(None, 1, 0, "g"), (3, None, None, "g"), (3, 1, 1, "g"), (50, 1, 0, "g"), (999, 0, 0, "g")],
    "benchmark": [(None, "same text", 1), (1, None, 1), (2, "", 1), (2, "é ü", 1), (3, "...", 1)],
    "pages": [(None, None, None, 1, "v"), (1, "http://a.com/x", None, 1, "v"), (1, "http://a.com/x", None, 1, "v"), (2, "", "", 1, "v")],
    "conversations": [
        (None, None, None, None, "l", 1), (None, 0, "user", "hi", "l", 1), (1, 0, "user", "", "l", 1), (1, 0, "user", "", "l", 1),
        (1, 1, "assistant", LONG, "l", 1), (2, None, "robot", "x\ny", "l", 1),
    ],
}


def _write(spark, folder, rows):
    for table, schema in SCHEMAS.items():
        spark.createDataFrame(rows.get(table, []), schema).write.parquet(f"{folder}/{table}.parquet")
    return str(folder)


@pytest.mark.parametrize("key", [*sorted(QUERIES), "pipeline"])
def test_odd_and_empty_tables(spark, tmp_path, key):
    """Nulls in every column, empty and long texts, repeated rows and clashing columns; then no rows at all."""
    run = {**QUERIES, "pipeline": corpus_pipeline.run}[key]
    odd = run(spark, _write(spark, tmp_path / "odd", ODD)).collect()
    empty = run(spark, _write(spark, tmp_path / "empty", {})).collect()
    assert empty == []
    whole = {"op4": None, "op7": 4, "op10": None, "op12": None, "pipeline": None}
    size = whole.get(key.split("_")[0], len(ODD["documents"]))
    assert size is None or len(odd) == size


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(row[i]) for i in order) for row in rows)


@mounted
@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_its_sql(spark, duck, key):
    result, oracle = QUERIES[key](spark, SF_DIR), duck.execute(ORACLES[key])
    names = [c[0] for c in oracle.description]
    assert sorted(names) == sorted(result.columns)
    assert _rows(result.columns, result.collect()) == _rows(names, oracle.fetchall())


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry_points.queries())


@mounted
def test_sharding_contract(spark, duck):
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    rows = QUERIES["op1_vector_bin_packing"](spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    bytes_of, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        bytes_of[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert sorted(bytes_of) == list(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(bytes_of.values()) < 1.02 * min(bytes_of.values())


@mounted
def test_token_counts_contract(spark, duck):
    rows = QUERIES["op9_separator_scan"](spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in rows) == [i for i, in duck.execute("SELECT doc_id FROM documents ORDER BY 1").fetchall()]
    assert all(r.n_tokens > 0 for r in rows)
    assert 0 < sum(not r.closed for r in rows) <= spark.sparkContext.defaultParallelism  # the last one of each file


@mounted
def test_roles_contract(spark, duck):
    rows = QUERIES["op4_transcript_roles"](spark, SF_DIR).collect()
    turns = {(r.conv_id, r.turn) for r in rows}
    assert turns == set(duck.execute("SELECT conv_id, turn FROM conversations").fetchall())
    assert sum(r.given_role == r.found_role for r in rows) > 0.9 * len(rows)
