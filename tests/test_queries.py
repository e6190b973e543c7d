"""Every registered query against its DuckDB oracle on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from depgraph.plans.catalog import ORACLES, QUERIES

SF_DIR = entry_points.SMOKE_DIR
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not mounted")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def _cell(value):
    if value is None or value != value:
        return ""
    return repr(float(value)) if isinstance(value, float) else str(value)


def _rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in data)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_its_oracle(spark, duck, key):
    result = QUERIES[key](spark, SF_DIR)
    oracle = duck.execute(ORACLES[key])
    names = [column[0] for column in oracle.description]
    assert sorted(names) == sorted(result.columns)
    assert _rows(result.columns, result.collect()) == _rows(names, oracle.fetchall())


LARGE_DIR = "/root/testdata/sf0.1"
LARGE_KEYS = [
    "E1_explode_declarations", "E2_explode_imports", "S2_read_modules", "S3_read_modules_strict",
    "T1_parse_module_meta", "T2_parse_imports", "T3_parse_declarations", "T4_decl_warnings", "T5_module_name",
    "T6_namespaces_seen", "T7_assemble_module",
]


@pytest.mark.skipif(not os.path.isdir(LARGE_DIR), reason="test tables are not mounted")
def test_feeds_and_sources_match_their_oracles_at_size(spark):
    connection = duckdb.connect()
    for table in ("part", "lineitem"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{LARGE_DIR}/{table}.parquet'")
    for key in LARGE_KEYS:
        result, oracle = QUERIES[key](spark, LARGE_DIR), connection.execute(ORACLES[key])
        names = [column[0] for column in oracle.description]
        assert _rows(result.columns, result.collect()) == _rows(names, oracle.fetchall()), key


def test_every_query_is_registered(spark):
    assert set(QUERIES) <= set(entry_points.queries()) and set(QUERIES) == set(ORACLES)


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() > 0
