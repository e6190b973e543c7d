from __future__ import annotations

import datetime

import pytest

from depgraph.operators import build
from tests.conftest import declaration, module, record, rows


@pytest.fixture
def feeds(make_feeds):
    modules = [
        module("Root.A", ["Root.B", "Ext.Core", "Root.B"], [
            declaration("t", "theorem"), declaration("S", "structure", line=3), declaration("", "instance", line=9),
            declaration("old", "def", line=5, deprecatedSince=datetime.date(2024, 1, 2), isDeprecated=True),
        ], namespaces=["N.M"]),
        module("Root.B"),
    ]
    records = [
        record("t", 1, ["u", "lib"]),
        record("t", 2, ["u"], typeSignature="second"),
        record("auto", 3, constructors=[{"name": "auto.mk", "position": 0}]),
        record("S", 4, fields=[{"name": "S.x", "position": 0}, {"name": "S.y", "position": 1}],
               constructors=[{"name": "S.mk", "position": 0}]),
        record("S.x", 5, typeSignature="field sig"),
        record("u", 6, module=None, typeSignature="legacy u"),
        record("nowhere", 7, ["u"], module=None),
        record("i", 8, instantiates="Cls", instancePriority=100, extends=[{"parent": "P", "position": 0}]),
        record("old", 9, deprecatedBy={"replacement": "t", "message": "use t", "since": "2024"}),
        record("gone", 10, deprecatedBy={"replacement": None, "message": None, "since": None},
               additiveVersion="add"),
    ]
    return make_feeds(modules, records)


def test_node_table_resolves_every_mention_by_precedence(feeds):
    nodes = {r["name"]: r for r in build.declaration_nodes(feeds).collect()}
    assert (nodes["t"]["kind"], nodes["t"]["isExternal"], nodes["t"]["typeSignature"]) == ("theorem", False, "second")
    assert (nodes["auto"]["kind"], nodes["auto"]["isExternal"]) == ("inductive", True)
    assert (nodes["lib"]["kind"], nodes["lib"]["module"], nodes["lib"]["isExternal"]) == (None, None, True)
    assert nodes["u"]["typeSignature"] == "legacy u"
    assert "nowhere" not in nodes and "" not in nodes
    assert (nodes["S.x"]["kind"], nodes["S.x"]["typeSignature"], nodes["S.x"]["isExternal"]) == ("field", "field sig", False)
    assert (nodes["S.y"]["typeSignature"], nodes["S.mk"]["kind"]) == ("", "constructor")
    assert "auto.mk" not in nodes
    assert (nodes["i"]["kind"], nodes["Cls"]["isExternal"], nodes["P"]["isExternal"]) == ("instance", True, True)
    assert (nodes["t"]["label"], nodes["S.x"]["label"], nodes["auto"]["label"]) == ("Theorem", "Field", None)
    assert nodes["old"]["deprecatedSince"] == "2024-01-02"


def test_single_pass_equals_the_chain_of_joins(feeds):
    parsed = build.parsed_nodes(feeds.declarations)
    chain = build.legacy_signature(build.attribute_modules(parsed, feeds.extract), feeds.extract)
    members = build.promoted_members(feeds, build.type_names(feeds.declarations))
    targets = build.dependency_names(feeds.deps).unionByName(build.relation_targets(feeds))
    known = chain.select("name").unionByName(members.select("name"))
    names = known.unionByName(build.placeholder_nodes(targets, known).select("name")).distinct()
    nodes = build.declaration_nodes(feeds)
    assert rows(nodes, "name") == rows(names)
    plain = nodes.join(members.select("name"), "name", "leftanti").join(chain.select("name"), "name", "leftsemi")
    expected = chain.join(members.select("name"), "name", "leftanti")
    assert rows(plain, "name", "kind", "module", "isExternal") == rows(expected, "name", "kind", "module", "isExternal")


def test_edges(feeds):
    graph = build.build_graph(feeds)
    assert rows(graph.depends_on) == [("t", "lib", "value"), ("t", "u", "value")]
    assert rows(graph.imports, "src", "dst") == [("Root.A", "Ext.Core"), ("Root.A", "Root.B")]
    assert rows(graph.modules, "name") == [("Ext.Core",), ("Root.A",), ("Root.B",)]
    assert rows(graph.instantiates) == [("i", "Cls", 100)]
    assert rows(graph.deprecated_by) == [("old", "t", "use t", "2024")]
    assert rows(graph.has_additive_version) == [("gone", "add")]
    assert rows(graph.has_field) == [("S", "S.x", 0), ("S", "S.y", 1)]
    assert rows(graph.has_constructor) == [("S", "S.mk", 0)]
    assert rows(graph.namespaces) == [("N", 1), ("N.M", 2)]
    assert rows(graph.subnamespace_of) == [("N.M", "N")]
    assert rows(graph.defined_in, "name") == [("S",), ("old",), ("t",)]


def test_context_of_a_dependency(spark):
    deps = spark.createDataFrame(
        [("a", "b", True, True), ("a", "c", True, False), ("a", "d", False, False)],
        "src string, dst string, inType boolean, inValue boolean",
    )
    assert rows(build.dependency_rows(deps)) == [("a", "b", "both"), ("a", "c", "type"), ("a", "d", "value")]
