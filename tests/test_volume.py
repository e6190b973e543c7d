"""What steps over all dependency edges move and hold at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from depgraph.operators import blocks as B
from depgraph.operators import build, traversal as V
from depgraph.operators import reads as R
from depgraph.plans import catalog
from depgraph.session import Rounds, materialize
from depgraph.sources import store
from tests.conftest import declaration, module, record, rows


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def _graph(make_feeds):
    modules = [
        module("Root.A", declarations=[declaration("a1"), declaration("a2")]),
        module("Root.B", declarations=[declaration("b1", module="Root.B")]),
    ]
    records = [
        record("a1", 1, ["a2", "b1", "ext"]), record("a2", 2, ["b1", "a2"]), record("b1", 3, ["a1"], module="Root.B"),
        record("a1", 4, ["b1", "a2"], typeSignature="again"),
    ]
    return build.build_graph(make_feeds(modules, records))


def test_dependencies_are_dealt_out_once_and_come_in_order(spark):
    pairs = [(f"s{i % 90:02d}", f"t{i % 40:02d}", i % 2 == 0, True) for i in range(3000)]
    deps = spark.createDataFrame(pairs, "src string, dst string, inType boolean, inValue boolean").repartition(6)
    out = build.dependency_rows(deps)
    assert len(rows(out)) == len(set(pairs))
    parts = [[(r["src"], r["dst"]) for r in part] for part in out.rdd.glom().collect() if part]
    assert all(part == sorted(part) for part in parts)
    bounds = sorted((part[0], part[-1]) for part in parts)
    assert all(last < first for (_, last), (first, _) in zip(bounds, bounds[1:]))
    # nothing is hashed before it is dealt out
    plan = _plan(out)
    assert plan.index("Aggregate") < plan.index("RepartitionByExpression")


def test_module_edges_are_made_distinct_after_the_joins(make_feeds):
    edges = R.module_edges(_graph(make_feeds))
    top = _plan(edges).split("Join", 1)[0]
    assert "Aggregate" in top and "RepartitionByExpression" in top
    assert rows(edges, "srcModule", "dstModule", "src", "dst") == [
        ("Root.A", "Root.A", "a1", "a2"), ("Root.A", "Root.A", "a2", "a2"), ("Root.A", "Root.B", "a1", "b1"),
        ("Root.A", "Root.B", "a2", "b1"), ("Root.B", "Root.A", "b1", "a1"),
    ]


def test_module_strips_deal_the_edges_out_once(spark):
    edges = spark.createDataFrame(
        [("A", "B", "a1", "b1"), ("A", "B", "a1", "b2"), ("A", "B", "a2", "b1"), ("B", "A", "b1", "a1"), ("A", "A", "a1", "a2")],
        "srcModule string, dstModule string, src string, dst string",
    )
    strips = R.module_strips(edges)
    assert _exchanges(strips) == 1
    assert rows(strips, "srcModule", "dstModule", "edges", "sources") == [("A", "B", 3, 2), ("B", "A", 1, 1)]


def test_live_edges_are_joined_before_repeats_are_dropped(spark, make_feeds, monkeypatch):
    kept = {}

    def keep(df, label="stage", path=None):
        kept[label] = _plan(df)
        return materialize(df, label, path)

    graph = build.build_graph(make_feeds(
        [module("Root.A", declarations=[declaration("a1"), declaration("a2")])],
        [record("a1", 1, ["a2", "a1"]), {**record("a1", 2), "deps": [{"name": "a2", "inType": True, "inValue": False}]}, record("a2", 3)],
    ), lambda tables: {name: materialize(table, name) for name, table in tables.items()})
    monkeypatch.setattr(B, "materialize", keep)
    live = B.live_blocks(graph, spark.createDataFrame([("Root.A",)], "name string"))
    assert graph.depends_on.filter("src <> dst").count() == 2
    assert rows(live.edges) == [("Root.A", 0, 1)]
    assert "Aggregate" not in kept["live_edges"].split("Join", 1)[1]


def test_a_walk_moves_sets_of_origins(spark, monkeypatch):
    sizes = []

    class Counted(Rounds):
        def add(self, df, **metrics):
            table, counts = super().add(df, **metrics)
            sizes.append(table.count())
            return table, counts

    monkeypatch.setattr(V, "Rounds", Counted)
    origins = [f"o{i:03d}" for i in range(130)]
    edges = [(o, "hub") for o in origins] + [("hub", "x"), ("x", "y"), ("y", "hub"), ("y", "o007")] + [("hub", "x")]
    names = spark.createDataFrame([(o,) for o in origins], "name string")
    reached = V.k_hop(spark.createDataFrame(edges, "src string, dst string"), names, 4)
    expected = sorted((o, node) for o in origins for node in ("hub", "o007", "x", "y"))
    assert rows(reached, "origin", "node") == expected
    assert rows(V.distinct_reach(reached)) == [(o, 4) for o in origins]
    # a row for each node and each word of 64 origins, not for each origin
    assert sizes == [3, 3, 3, 3]


def test_a_large_frontier_is_hashed(spark, monkeypatch):
    monkeypatch.setattr(V, "_FEW", 0)
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    names = spark.createDataFrame([("a",), ("d",)], "name string")
    assert rows(V.k_hop(edges, names, 3)) == [("a", "a"), ("a", "b"), ("a", "c"), ("a", "d")]


def test_stored_dependencies_are_not_dealt_out_again(spark, make_feeds, tmp_path):
    graph = _graph(make_feeds)
    store.write_graph(graph, str(tmp_path / "g"))
    back = store.read_graph(spark, str(tmp_path / "g"))
    assert rows(back.depends_on) == rows(graph.depends_on)
    strip = store.lookup_strip(spark, str(tmp_path / "g"), "Root.A", "Root.B")
    assert rows(strip, "src", "dst") == [("a1", "b1"), ("a2", "b1")]
    between = store.stored_module_edges(spark, str(tmp_path / "g"))
    assert rows(between.select("src", "dst")) == rows(R.module_edges(graph).select("src", "dst"))


class _Stored:
    """A workspace of a stored graph only."""

    def __init__(self, spark, stored_graph):
        self.spark, self.stored_graph = spark, stored_graph


def test_key_content_is_dealt_out_by_source(spark, make_feeds, tmp_path, monkeypatch):
    store.write_graph(_graph(make_feeds), str(tmp_path / "g"))
    monkeypatch.setattr(catalog, "workspace", lambda *_: _Stored(spark, str(tmp_path / "g")))
    content = catalog.QUERIES["S8_write_graph"](spark, "")
    parts = _plan(content).split("RepartitionByExpression")
    assert len(parts) == 15 and content.count() == content.distinct().count()
    assert content.filter(F.col("part") == "depends_on").count() == 6
