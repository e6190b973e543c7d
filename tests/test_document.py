from __future__ import annotations

import hashlib
import json

import pytest

from depgraph.operators import map_layout as M
from depgraph.plans import fixture
from depgraph.sources import byte_files, document, files
from tests.conftest import module, record


@pytest.fixture(scope="module")
def map_doc(spark):
    from depgraph import schemas
    from depgraph.sources import feeds

    names = [f"Root.{topic}.M{i:02d}" for i in range(12) for topic in ("Alpha", "Zeta")]
    modules = [module(n, names[max(0, i - 3):i], docstring='quo"te\n\\ é' if i % 5 == 0 else None) for i, n in enumerate(names)]
    records = [record("p", 1, module=names[0])] + [
        record(f"c{i}", 2 + i, module=n, extends=[{"parent": "p", "position": 0}]) for i, n in enumerate(names[5:9])
    ]
    built = feeds.flatten(spark.createDataFrame(modules, schemas.MODULE_FEED), spark.createDataFrame(records, schemas.EXTRACT_FEED))
    return M.module_map(built, files.topic_dim(spark, fixture.TOPICS), "Root", bad_lines=3)


def test_document_holds_the_map_in_order(spark, tmp_path, map_doc):
    path = tmp_path / "data.json"
    digest = document.write_document(map_doc, str(path), "v", "t0", "root")
    raw = path.read_bytes()
    assert digest == hashlib.sha256(raw).hexdigest() == byte_files.stored_digest(str(path))
    doc = json.loads(raw)
    assert list(doc) == ["schemaVersion", "meta", "topics", "nodes", "edges", "structureEdges"] and doc["schemaVersion"] == 2
    assert {k: doc["meta"][k] for k in ("version", "generatedAt", "scope")} == {"version": "v", "generatedAt": "t0", "scope": "root"}
    assert doc["meta"]["stats"] == map_doc.stats.first().asDict()
    nodes = map_doc.nodes.orderBy("topo").collect()
    assert [n["name"] for n in doc["nodes"]] == [r["name"] for r in nodes]
    for shown, row in zip(doc["nodes"], nodes):
        assert all(shown[k] == pytest.approx(row[k], abs=1e-8) if k in "xyr" else shown[k] == row[k] for k in shown)
    assert doc["nodes"][0]["title"] is None and any(n["docstring"] for n in doc["nodes"])
    place = {r["name"]: r["topo"] for r in nodes}
    edges = sorted((r["importer"], r["dep"]) for r in map_doc.edges.collect())
    assert doc["edges"] == [[place[d], place[i]] for i, d in edges] and edges
    found = {rel: sorted([place[r["src"]], place[r["dst"]]] for r in map_doc.structure.filter(f"rel = '{rel}'").collect()) for rel in doc["structureEdges"]}
    assert doc["structureEdges"] == found and len(found["extends"]) == 4
    assert [t["id"] for t in doc["topics"]][-1] == "_default"
    assert sorted(p.name for p in tmp_path.iterdir()) == ["data.json", "data.json.sha256"]


def test_partitions_do_not_change_a_byte(spark, tmp_path, map_doc):
    first = document.write_document(map_doc, str(tmp_path / "a"), "v", "t", "s")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        dealt = M.ModuleMap(*(getattr(map_doc, t).repartition(5) for t in ("nodes", "edges", "structure", "topics", "stats")))
        second = document.write_document(dealt, str(tmp_path / "b"), "v", "t", "s")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert first == second and (tmp_path / "a").read_bytes() == (tmp_path / "b").read_bytes()


def test_a_document_is_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "x")
    rows = spark.createDataFrame([(i, f"line {i}\n") for i in range(500)], "i long, text string").repartition(7)
    byte_files.write_one_file(rows, ["i"], path)
    assert open(path).read() == "".join(f"line {i}\n" for i in range(500))
    byte_files.write_one_file(rows.filter("i < 2"), ["i"], path)
    assert open(path).read() == "line 0\nline 1\n"
