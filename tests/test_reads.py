from __future__ import annotations

import pytest

from depgraph.functions import checks
from depgraph.operators import build, traversal as V
from depgraph.operators import reads as R
from depgraph.operators import search as S
from tests.conftest import declaration, module, record, rows


@pytest.fixture
def graph(make_feeds):
    modules = [
        module("Root.A", declarations=[declaration("a1", "theorem", line=7, docstring="first"), declaration("a2")]),
        module("Root.B", declarations=[declaration("b1", "lemma")]),
    ]
    records = [
        record("a1", 1, ["a2", "b1", "ext"]), record("a2", 2, ["b1"]), record("b1", 3, module="Root.B"),
        record("a1", 4, ["b1"]),
    ]
    return build.build_graph(make_feeds(modules, records))


def test_dependencies_leave_the_module(graph):
    out = R.decl_deps(graph, "a1", "out")
    assert rows(out, "other", "otherModule", "selfKind") == [
        ("b1", "Root.B", "theorem"), ("ext", "(external)", "theorem"),
    ]
    into = R.decl_deps(graph, "b1", "in")
    assert rows(R.deps_grouped(into)) == [
        ("b1", "Root.A", "a1", "theorem", "b1", "lemma", 2, 2), ("b1", "Root.A", "a2", "def", "b1", "lemma", 2, 2),
    ]
    assert rows(into, "other", "cut") == [("a1", False), ("a2", False)]
    assert rows(R.decl_deps(graph, "b1", "in", limit=1), "other", "cut") == [("a1", True)]
    every = R.deps_cross(graph, R.names_frame(graph, ["b1"]), "in")
    assert rows(every, "from", "to") == [("a1", "b1"), ("a2", "b1")]
    assert rows(R.decl_deps(graph, "ext", "in"), "other") == [("a1",)]
    with pytest.raises(checks.UnknownName):
        R.decl_deps(graph, "nobody")
    with pytest.raises(checks.QueryError):
        R.decl_deps(graph, "a1", "sideways")


def test_strip_batch_detail_and_health(graph):
    strip = R.dep_strip(graph, "Root.A", "Root.B")
    assert [tuple(r) for r in strip.collect()] == [("a1", "theorem", "b1", "lemma", False), ("a2", "def", "b1", "lemma", False)]
    assert [tuple(r) for r in R.dep_strip(graph, "Root.A", "Root.B", limit=1).collect()] == [("a1", "theorem", "b1", "lemma", True)]
    assert rows(R.strip_grouped(R.strip_edges(graph, "Root.A", "Root.B"))) == [
        ("a1", "theorem", "b1", "lemma", 1, 2), ("a2", "def", "b1", "lemma", 1, 2),
    ]
    with pytest.raises(checks.QueryError):
        R.dep_strip(graph, "Root.A", "Root.A")
    batch = R.decls_batch(graph, ["a1", "zz", "b1", "a1"], ["name", "sourceUrl"])
    assert rows(batch, "place", "name") == [(0, "a1"), (2, "b1"), (3, "a1")]
    with pytest.raises(checks.QueryError):
        R.decls_batch(graph, ["a1"], ["secret"])
    detail = R.decl_detail(graph, "a1").first()
    assert detail["sourceUrl"].endswith("Root/A.src#L7") and detail["docstring"] == "first"
    assert R.health_counts(graph, 5, True).first().asDict() == {
        "decls": 3, "modules": 2, "kgVersion": 5, "layoutPresent": True,
    }
    assert R.duplicate_keys(graph).count() == 0


def test_sql_views(graph, spark):
    assert "t_depends_on" in R.create_views(graph, "t_")
    assert spark.sql("SELECT count(*) FROM t_depends_on").first()[0] == 4


def test_argument_checks():
    assert (checks.clamp(0, 10), checks.clamp(99, 10)) == (1, 10)
    assert checks.relations_from_mask(5) == ["extends", "fields"]
    with pytest.raises(checks.QueryError):
        checks.query_text("x" * 257)
    with pytest.raises(checks.QueryError):
        checks.batch_names([])


def test_traversal_uses_import_edges_only(spark):
    edges = spark.createDataFrame(
        [("import", "a", "b"), ("import", "b", "c"), ("import", "x", "c"), ("extends", "z", "b")],
        "rel string, dep string, importer string",
    )
    b = spark.createDataFrame([("b",)], "name string")
    assert rows(V.neighbors(edges, b)) == [("b", "dep", "a"), ("b", "dependent", "c")]
    assert rows(V.node_closure(edges, b)) == [("b", "dep", "a"), ("b", "dependent", "c")]
    c = spark.createDataFrame([("c",)], "name string")
    selected = V.selection(edges, c)
    assert rows(selected, "node", "role") == [
        ("a", "closure"), ("b", "neighbor"), ("c", "focus"), ("x", "neighbor"),
    ]
    assert rows(V.induced_edges(edges, selected), "rel", "dep") == [("import", "a"), ("import", "b"), ("import", "x")]
    nodes = spark.createDataFrame([("a", "T"), ("b", "T"), ("z", "T"), ("w", "U")], "name string, topic string")
    assert rows(V.highlight_tiers(nodes, selected, "T"), "name", "tier") == [
        ("a", "closure"), ("b", "full"), ("w", "faded"), ("z", "topic"),
    ]
    assert {r["tier"] for r in V.highlight_tiers(nodes, None, None).collect()} == {"full"}


def test_k_hop_counts_distinct_nodes_on_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    a = spark.createDataFrame([("a",)], "name string")
    assert rows(V.k_hop(edges, a, 2), "node") == [("b",), ("c",)]
    assert rows(V.distinct_reach(V.k_hop(edges, a, 4))) == [("a", 4)]
    assert rows(V.k_hop(edges, a, 1, backwards=True), "node") == [("c",)]


def test_module_search_order_and_scores(spark):
    modules = spark.createDataFrame(
        [("R.T.FundamentalTheorem", None, None), ("R.A.FundamentalGroup", "T", None),
         ("R.B.Other", "Fundamentals", None), ("R.C.Doc", None, "On zoology\nfund")],
        "name string, title string, docstring string",
    )
    hits = S.module_search(modules, " FUND ").collect()
    assert [(r["lastSegment"], r["score"]) for r in hits] == [
        ("FundamentalGroup", 90), ("FundamentalTheorem", 90), ("Other", 50),
    ]
    assert [r["score"] for r in S.module_search(modules, "zoo").collect()] == [10]
    assert S.module_search(modules, "  ").count() == 0


def test_decl_search_and_text_index(graph):
    assert [r["name"] for r in S.decl_search(graph.declarations, "a1 b").collect()] == ["a1", "b1"]
    assert S.decl_search(graph.declarations, "!!").count() == 0
    index = S.text_index(graph.declarations)
    assert ("first", "a1", 1) in rows(index)


def test_a_hub_keeps_its_limit_and_order(spark, make_feeds):
    hub = "hub"
    modules = [module("Root.H", declarations=[declaration(hub)])]
    records = [record(hub, 0, module="Root.H")]
    records += [record(f"d{i:05d}", i + 1, [hub], module=f"Root.M{i % 7}") for i in range(3000)]
    graph = build.build_graph(make_feeds(modules, records))
    expected = sorted((f"Root.M{i % 7}", f"d{i:05d}") for i in range(3000))[:50]
    found = R.decl_deps(graph, hub, "in", limit=50).orderBy("place").collect()
    assert [(r["otherModule"], r["other"]) for r in found] == expected
    everyone = spark.createDataFrame([(hub,)], "name string")
    assert R.deps_cross(graph, everyone, "in").count() == 3000
    page = R.decl_deps(graph, hub, "in", 5000)
    assert page.count() == 1000 and page.filter("cut").count() == 1000
