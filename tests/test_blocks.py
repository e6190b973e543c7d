from __future__ import annotations

import json

import pytest

from depgraph.functions import columns as C
from depgraph.operators import blocks as B
from depgraph.operators import build
from depgraph.operators import structure as X
from depgraph.sources import store
from tests.conftest import declaration, module, record, rows


@pytest.fixture
def feeds(make_feeds):
    modules = [module("Root.A", declarations=[declaration("b", "theorem")])]
    records = [
        record("b", 1, ["a", "b", "far"]),
        record("a", 2, constructors=[{"name": "a.mk", "position": 0}]),
        record("b", 3, ["c"]),
        record("far", 4, ["a"], module="Root.B"),
        record("c", 5, ["d"]), record("d", 6, ["c"]), record("e", 7, ["c", "a"]),
        record("dead", 8, ["a"], module="Root.Dead"),
    ]
    return make_feeds(modules, records)


@pytest.fixture
def alive(spark):
    return spark.createDataFrame([("Root.A",), ("Root.B",)], "name string")


def test_blocks_keep_first_records_inner_edges_and_depth(feeds, alive):
    blocks = B.module_blocks(feeds, alive)
    assert rows(blocks.decls, "module", "idx", "name", "k", "x", "y", "s") == [
        ("Root.A", 0, "b", "theorem", 1.0, 0.0, 2.5),
        ("Root.A", 1, "a", "inductive", 0.0, 0.0, 2.91),
        ("Root.A", 2, "c", "def", 2.0, 0.0, 3.23),
        ("Root.A", 3, "d", "def", 2.0, 1.5, 2.91),
        ("Root.A", 4, "e", "def", 2.0, -1.5, 2.91),
        ("Root.B", 0, "far", "def", 0.0, 0.0, 1.5),
    ]
    assert rows(blocks.edges) == [
        ("Root.A", 0, 1), ("Root.A", 2, 3), ("Root.A", 3, 2), ("Root.A", 4, 1), ("Root.A", 4, 2),
    ]
    repeats = B.duplicate_declarations(B.alive_records(feeds.extract, alive))
    assert rows(B.block_stats(blocks, repeats)) == [(2, 6, 5, 5, 1)]


def test_pieces_concatenate_and_read_back(spark, feeds, alive, tmp_path):
    pieces = B.block_pieces(B.module_blocks(feeds, alive))
    index = B.block_index(pieces).orderBy("o").collect()
    assert [r["o"] for r in index] == [sum(r["l"] for r in index[:i]) for i in range(len(index))]
    assert rows(B.module_index(B.block_index(pieces)), "module", "o")[0] == ("Root.A", 0)
    store.write_blocks(pieces, str(tmp_path / "blocks"))
    first, second = store.read_block(spark, str(tmp_path / "blocks"), "Root.A").collect()
    assert [d["name"] for d in json.loads(first["payload"])] == ["b", "a", "c", "d", "e"]
    assert json.loads(second["payload"]) == [[0, 1], [2, 3], [3, 2], [4, 1], [4, 2]]
    assert store.read_block(spark, str(tmp_path / "blocks"), "Root.X").count() == 0


def test_live_blocks_use_name_order(feeds, alive):
    graph = build.build_graph(feeds)
    live = B.live_blocks(graph, alive)
    assert rows(live.decls.filter("module = 'Root.A'"), "idx", "name") == [
        (0, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "e"),
    ]
    # the live graph holds the edges of every record, so the repeat's edge b -> c is there too
    assert ("Root.A", 1, 2) in rows(live.edges)


def test_node_size(spark):
    df = spark.createDataFrame([(0,), (4,), (999,)], "d long")
    assert [r[0] for r in df.select(C.node_size(df.d)).collect()] == [1.5, 3.5, 4.5]


def test_structure_edges_resolve_and_fall_back_only_for_fields(make_feeds, spark):
    records = [
        record("Child", 1, module="Root.C", extends=[{"parent": "Par", "position": 0}, {"parent": "Own.x", "position": 1}],
               fields=[{"name": "Own.x", "position": 0}, {"name": "nodot", "position": 1}]),
        record("Par", 2, module="Root.P"),
        record("Own", 3, module="Root.O"),
        record("inst", 4, module="Root.C", instantiates="Par"),
        record("self", 5, module="Root.P", instantiates="Par"),
        record("dead", 6, module="Root.D", instantiates="Par"),
    ]
    alive = spark.createDataFrame([("Root.C",), ("Root.P",), ("Root.O",)], "name string")
    assert rows(X.structure_edges(make_feeds([], records), alive)) == [
        ("extends", "Root.C", "Root.P"), ("fields", "Root.C", "Root.O"), ("instantiates", "Root.C", "Root.P"),
    ]


def test_one_deep_module_does_not_set_the_rounds_of_all(spark, monkeypatch):
    """A module whose declarations form one chain of 5,000, among 3,000 shallow ones, one of them with a circle."""
    from pyspark.sql import functions as F

    from depgraph import session
    from depgraph.operators import module_graph as G

    written = []
    monkeypatch.setattr(session, "materialize", lambda *a, f=session.materialize, **k: written.append(a[1:2]) or f(*a, **k))
    for place in (G, B):
        monkeypatch.setattr(place, "materialize", session.materialize)
    deep = spark.range(5000).select(F.lit("Deep").alias("module"), F.col("id").alias("idx"))
    shallow = spark.range(9000).select(F.format_string("M%04d", F.expr("id div 3")).alias("module"), (F.col("id") % 3).alias("idx"))
    chain = spark.range(1, 5000).select(F.lit("Deep").alias("module"), F.col("id").alias("src_idx"), (F.col("id") - 1).alias("dst_idx"))
    pairs = spark.range(3000).select(F.format_string("M%04d", "id").alias("module"), F.lit(2).cast("bigint").alias("src_idx"), F.lit(0).cast("bigint").alias("dst_idx"))
    circle = spark.createDataFrame([("M0007", 0, 1), ("M0007", 1, 0)], "module string, src_idx bigint, dst_idx bigint")
    columns = B.depth_columns(deep.unionByName(shallow), chain.unionByName(pairs).unionByName(circle))
    found = {(r["module"], r["idx"]): r["column"] for r in columns.collect()}
    assert len(written) < 30
    want = {("Deep", i): i for i in range(5000)}
    want |= {(f"M{m:04d}", i): int(i == 2) for m in range(3000) for i in range(3)}
    assert found == want | {("M0007", i): 1 for i in range(3)}


def test_inner_edges_are_joined_before_repeats_are_dropped(spark):
    """The dependencies of all modules are dealt out once, for the join on the target, and not once more by all columns."""
    decls = spark.createDataFrame([("A", 0, "a.x", 1), ("A", 1, "a.y", 2)], "module string, idx bigint, name string, seq bigint")
    homes = spark.createDataFrame([("a.x", "A"), ("a.y", "A")], "name string, module string")
    deps = spark.createDataFrame(
        [(2, "a.y", "A", "a.x"), (2, "a.y", "A", "a.x"), (2, "a.y", "A", "b.z"), (2, "a.y", "A", "a.y")],
        "seq bigint, src string, module string, dst string",
    )
    edges = B.intra_edges(deps, decls, homes)
    assert [tuple(r) for r in edges.collect()] == [("A", 1, 0)]
    assert edges._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
