from __future__ import annotations

import json
import struct

import pytest
from pyspark.sql import functions as F

from depgraph.operators import blocks as B
from depgraph.sources import byte_files, pack
from tests.conftest import rows

STATS = {"modules": 3, "decls": 0, "edges": 0, "kindsInferred": 0, "duplicateNames": 0}


@pytest.fixture
def blocks(spark):
    """Three modules: an empty set of edges, odd characters in names, and one of 600 declarations."""
    decls = [("Root.B", i, f"d{i}", "def", float(i % 7), 1.5 * (i % 3), 1.5) for i in range(600)]
    decls += [("Root.A", 0, 'q"uote\\ é', "theorem", 0.0, 0.0, 1.5), ("Root.\"ü", 0, "x", "def", 0.0, -1.5, 2.5), ("Root.\"ü", 1, "y", "def", 1.0, 0.0, 2.5)]
    edges = [("Root.B", i, j) for i in range(0, 600, 7) for j in range(0, i, 50)] + [("Root.\"ü", 1, 0)]
    return B.Blocks(
        spark.createDataFrame(decls, "module string, idx long, name string, k string, x double, y double, s double").repartition(5),
        spark.createDataFrame(edges, "module string, src_idx long, dst_idx long").repartition(3),
    )


def _expected(blocks):
    out = {}
    for r in sorted(blocks.decls.collect(), key=lambda r: (r.module, r.idx)):
        own = out.setdefault(r.module, {"schemaVersion": 1, "module": r.module, "decls": [], "e": []})
        own["decls"].append({"name": r.name, "k": r.k, "x": r.x, "y": r.y, "s": r.s})
    for r in sorted(blocks.edges.collect()):
        out[r.module]["e"].append([r.src_idx, r.dst_idx])
    return out


def test_the_file_has_the_layout_of_a_pack(spark, tmp_path, blocks):
    path = tmp_path / "blocks.pack"
    pack.write_pack(blocks, str(path), "v1", "t0", "root", STATS)
    raw = path.read_bytes()
    (length,) = struct.unpack("<Q", raw[:8])
    header = json.loads(raw[8:8 + length])
    assert header["schemaVersion"] == 1
    assert header["meta"] == {"version": "v1", "generatedAt": "t0", "scope": "root", "stats": STATS}
    assert list(header["modules"]) == sorted(header["modules"], key=str.encode)
    expected, offset = _expected(blocks), 0
    for module, r in header["modules"].items():
        assert r["o"] == offset
        start = 8 + length + r["o"]
        assert json.loads(raw[start:start + r["l"]]) == expected[module]
        offset += r["l"]
    assert set(header["modules"]) == set(expected) and len(raw) == 8 + length + offset
    assert [p.name for p in tmp_path.iterdir()] == ["blocks.pack"]  # parts are gone


@pytest.mark.parametrize("partitions", ["1", "9"])
def test_same_blocks_give_the_same_bytes(spark, tmp_path, blocks, partitions):
    pack.write_pack(blocks, str(tmp_path / "a"), "v", "t", "s", STATS)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        pack.write_pack(B.Blocks(blocks.decls.repartition(2), blocks.edges.repartition(7)), str(tmp_path / "b"), "v", "t", "s", STATS)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert (tmp_path / "a").read_bytes() == (tmp_path / "b").read_bytes()


def test_blocks_are_read_back_by_ranges(spark, tmp_path, blocks, monkeypatch):
    path = str(tmp_path / "blocks.pack")
    pack.write_pack(blocks, path, "v1", "t0", "root", STATS)
    everything = pack.read_pack(spark, path)
    assert {r.module: json.loads(bytes(r.data)) for r in everything.collect()} == _expected(blocks)
    assert everything.filter("module = 'Root.Nowhere'").count() == 0
    assert everything.filter("module IN ('Root.A', 'Root.B')").count() == 2
    assert rows(everything.filter("module = 'Root.A' AND chunk = 0"), "module") == [("Root.A",)]

    reader = pack._PackReader({"path": path})
    assert list(reader.pushFilters([pack.EqualTo(("module",), "Root.A")])) == []
    (only,) = reader.partitions()
    header, base = reader.header()
    assert only.ranges == [("Root.A", base + header["modules"]["Root.A"]["o"], header["modules"]["Root.A"]["l"])]
    monkeypatch.setattr(pack, "RANGE_BYTES", 100)
    assert len(pack._PackReader({"path": path}).partitions()) > 1
    monkeypatch.setattr(pack, "CHUNK_BYTES", 100)
    chunks = [c for p in pack._PackReader({"path": path}).partitions() for c in pack._PackReader({"path": path}).read(p)]
    assert json.loads(b"".join(data for module, _, data in chunks if module == "Root.B")) == _expected(blocks)["Root.B"]


def test_one_module_reads_its_bytes_only(spark, tmp_path, blocks):
    """All other blocks may be damaged: their bytes are never touched."""
    path = tmp_path / "blocks.pack"
    pack.write_pack(blocks, str(path), "v1", "t0", "root", STATS)
    header, base = pack._PackReader({"path": str(path)}).header()
    own = header["modules"]["Root.A"]
    whole = path.read_bytes()
    path.write_bytes(whole[:base + own["o"] + own["l"]])  # what follows is cut off
    (row,) = pack.read_pack(spark, str(path)).filter(F.col("module") == "Root.A").collect()
    assert json.loads(bytes(row.data)) == _expected(blocks)["Root.A"]


def test_an_empty_pack(spark, tmp_path):
    none = B.Blocks(
        spark.createDataFrame([], "module string, idx long, name string, k string, x double, y double, s double"),
        spark.createDataFrame([], "module string, src_idx long, dst_idx long"),
    )
    path = str(tmp_path / "blocks.pack")
    pack.write_pack(none, path, "v", "t", "s", STATS)
    assert pack.read_pack(spark, path).count() == 0


@pytest.mark.parametrize("block_bytes", [3, 64, 1 << 20])
def test_files_in_blocks_of_bytes(spark, tmp_path, block_bytes):
    content = {"a": bytes(range(256)) * 4, "b": b"", "c": b"xyz", "d": b"12345"}
    for name, raw in content.items():
        (tmp_path / name).write_bytes(raw)
    listed = byte_files.listed_files(spark, str(tmp_path))
    got = {}
    for r in byte_files.byte_blocks(listed, block_bytes).orderBy("file", "block").collect():
        own = got.setdefault(r.file.rsplit("/", 1)[-1], [])
        assert r.block == len(own) and 0 < len(r.data) <= block_bytes
        own.append(bytes(r.data))
    assert {k: b"".join(v) for k, v in got.items()} == {k: v for k, v in content.items() if v}
