"""The stored graph, the stored map and the stored blocks.

Every write goes to a fresh directory and a one-row pointer names the current one, so
a reader never sees a half-written table and nothing is overwritten while it is read.
Versions are claimed by creating a file that must not exist yet, so no two writers share one.
Tables are ordered by their lookup key, which lets Parquet statistics prune point reads.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depgraph.operators.blocks import block_index
from depgraph.operators.build import Graph
from depgraph.operators.map_layout import (
    ModuleMap,
    edges_by_index,
    ordered_edges,
    ordered_structure,
    structure_by_index,
)
from depgraph.functions import checks
from depgraph.operators.reads import decl_deps, module_edges
from depgraph.session import discard, file_system

_POINTER = "version bigint, folder string, generatedAt string, label string, modules bigint"
_MAP_TABLES = ("nodes", "edges", "structure", "topics", "stats")
_NODE_TABLES = ("declarations", "modules", "namespaces")


def write_graph(graph: Graph, base: str) -> int:
    """Write every node and edge table as a new version, ordered by name or by source.

    ``depends_on`` is written twice more: ordered by target, for lookups of dependents, and with the
    modules of both ends, ordered by these, for the edges between two modules.
    """
    spark = graph.declarations.sparkSession
    folder = f"graph-{uuid.uuid4().hex}"
    for name, table in graph.tables().items():
        # both ends of an edge take part in the range bounds, so a hub is split over files
        keys = ["name"] if name in _NODE_TABLES else table.columns[:2]
        # dependencies are built in ranges of their ends; a file here holds a few of these ranges, in order
        ordered = table.sortWithinPartitions(*keys) if name == "depends_on" else _ordered(table, *keys)
        ordered.write.parquet(f"{base}/{folder}/{name}")
    by_target = f"{base}/{folder}/depended_on_by"
    _ordered(graph.depends_on, "dst", "src").write.parquet(by_target)
    # read from the copy ordered by target, which is the order of the first join
    edges = module_edges(replace(graph, depends_on=spark.read.parquet(by_target)))
    edges.sortWithinPartitions("srcModule", "dstModule", "src", "dst").write.parquet(f"{base}/{folder}/depends_by_module")
    return _publish(spark, base, "graph", folder)


def _ordered(table: DataFrame, *keys: str) -> DataFrame:
    return table.repartitionByRange(*keys).sortWithinPartitions(*keys)


def _current(spark: SparkSession, base: str, kind: str) -> str:
    """Folder of the current version; an error where nothing is stored."""
    row = current_pointer(spark, base, kind)
    if row is None:
        raise FileNotFoundError(f"no {kind} is stored in {base}")
    return f"{base}/{row['folder']}"


def read_graph(spark: SparkSession, base: str) -> Graph:
    folder = _current(spark, base, "graph")
    return Graph(**{f.name: spark.read.parquet(f"{folder}/{f.name}") for f in fields(Graph)})


def _exists(spark: SparkSession, location: str) -> bool:
    path, files = file_system(spark, location)
    return files.exists(path)


def lookup_deps(
    spark: SparkSession, base: str, name: str, direction: str = "in", limit: int = 200
) -> DataFrame:
    """Dependency rows of one declaration from the stored copy ordered for the direction."""
    graph = read_graph(spark, base)
    if direction == "in":
        stored = spark.read.parquet(f"{_current(spark, base, 'graph')}/depended_on_by")
        graph = replace(graph, depends_on=stored)
    return decl_deps(graph, name, direction, limit)


def stored_module_edges(spark: SparkSession, base: str) -> DataFrame:
    """Declaration edges with the modules of both ends, in the order of these."""
    return spark.read.parquet(f"{_current(spark, base, 'graph')}/depends_by_module")


def lookup_strip(spark: SparkSession, base: str, a: str, b: str) -> DataFrame:
    """All declaration edges from module a to module b: a range of the stored edges, without a join."""
    checks.distinct_pair(a, b)
    edges = stored_module_edges(spark, base)
    return edges.filter((F.col("srcModule") == a) & (F.col("dstModule") == b)).select("src", "srcKind", "dst", "dstKind")


def drop_graph(spark: SparkSession, base: str) -> None:
    """Remove all graph tables, derived edges and pointers below ``base``."""
    discard(spark, base)


# ---- pointers ----------------------------------------------------------------------------------

def current_pointer(spark: SparkSession, base: str, kind: str = "map"):
    """The newest pointer row, or None where nothing is stored."""
    if not _exists(spark, f"{base}/{kind}-pointer"):
        return None
    pointers = spark.read.schema(_POINTER).parquet(f"{base}/{kind}-pointer")
    return pointers.orderBy(F.desc("version")).first()


def kg_version(spark: SparkSession, base: str) -> int | None:
    row = current_pointer(spark, base)
    return row["version"] if row else None


def _claim(spark: SparkSession, base: str, kind: str, version: int) -> int:
    """The first version from this one on that no other writer has taken."""
    while True:
        path, files = file_system(spark, f"{base}/claims/{kind}-{version}")
        if files.createNewFile(path):
            return version
        version += 1


def _publish(
    spark: SparkSession, base: str, kind: str, folder: str, version: int | None = None,
    now: str = "", label: str = "", modules: int = 0,
) -> int:
    if version is None:
        known = current_pointer(spark, base, kind)
        version = known["version"] + 1 if known else 1
    version = _claim(spark, base, kind, version)
    row = spark.createDataFrame([(version, folder, now, label, modules)], _POINTER)
    row.coalesce(1).write.mode("append").parquet(f"{base}/{kind}-pointer")
    return version


# ---- map -----------------------------------------------------------------------------------------

def store_rows(doc: ModuleMap) -> dict[str, DataFrame]:
    """The rows a stored layout consists of: node properties, reduced imports, structure edges."""
    return {
        "nodes": doc.nodes.select(
            "name", "x", "y", "r", "topic", "color", "declCount", "closureSize", "topo"
        ),
        "viz": doc.edges.select(F.col("dep").alias("a"), F.col("importer").alias("b")),
        "struct": doc.structure.select("rel", F.col("src").alias("a"), F.col("dst").alias("b")),
    }


def write_map(doc: ModuleMap, base: str, now: str, label: str = "", seed: int | None = None) -> int:
    """Store a map as a new version and return the version number.

    The same map gives the same rows in the same order; the time stamp is the caller's.
    The first version is seeded from the wall clock, so numbers never repeat after a drop.
    """
    spark = doc.nodes.sparkSession
    known = kg_version(spark, base)
    version = known + 1 if known is not None else (int(time.time()) if seed is None else seed)
    folder = f"map-{uuid.uuid4().hex}"
    keys = {
        "nodes": ["topo"], "edges": ["importer", "dep"], "structure": ["rel", "src", "dst"],
        "topics": ["priority"], "stats": [],
    }
    for name in _MAP_TABLES:
        table = getattr(doc, name)
        ordered = _ordered(table, *keys[name]) if keys[name] else table
        ordered.write.parquet(f"{base}/{folder}/{name}")
    stored = spark.read.parquet(f"{base}/{folder}/nodes").count()
    return _publish(spark, base, "map", folder, version, now, label, stored)


def read_map(spark: SparkSession, base: str) -> ModuleMap | None:
    """The current stored map, or None where no layout is stored."""
    row = current_pointer(spark, base)
    if row is None:
        return None
    return ModuleMap(**{
        name: spark.read.parquet(f"{base}/{row['folder']}/{name}") for name in _MAP_TABLES
    })


def document_nodes(doc: ModuleMap) -> DataFrame:
    return doc.nodes.orderBy("topo")


def document_edges(doc: ModuleMap) -> DataFrame:
    """Index pairs (dep, importer) in document order: importer name, then dep name."""
    return ordered_edges(doc.edges, doc.nodes).select("dep_topo", "importer_topo")


def document_structure(doc: ModuleMap) -> DataFrame:
    return ordered_structure(doc.structure, doc.nodes).select("rel", "src_topo", "dst_topo")


def hydrate_pairs(doc: ModuleMap) -> DataFrame:
    """Index pairs back to name pairs, for all relations."""
    pairs = edges_by_index(doc.edges, doc.nodes).select(
        F.lit("import").alias("rel"), F.col("dep_topo").alias("a"), F.col("importer_topo").alias("b")
    ).unionByName(structure_by_index(doc.structure, doc.nodes).select(
        "rel", F.col("src_topo").alias("a"), F.col("dst_topo").alias("b")
    ))
    first = doc.nodes.select(F.col("topo").alias("a"), F.col("name").alias("a_name"))
    second = doc.nodes.select(F.col("topo").alias("b"), F.col("name").alias("b_name"))
    return pairs.join(first, "a").join(second, "b").select("rel", "a", "b", "a_name", "b_name")


def verify_store(stored: DataFrame, modules: int) -> DataFrame:
    """One report row: stored node count against the count of the document."""
    return stored.agg(F.count(F.lit(1)).alias("stored")).select(
        "stored", F.lit(modules).cast("bigint").alias("expected"),
        (F.col("stored") == modules).alias("matches"),
    )


# ---- blocks ----------------------------------------------------------------------------------------

def write_blocks(pieces: DataFrame, base: str) -> int:
    """Store block pieces with their byte ranges, ordered by module, as a new version."""
    folder = f"blocks-{uuid.uuid4().hex}"
    _ordered(block_index(pieces), "module", "part", "i", "j").write.parquet(f"{base}/{folder}")
    return _publish(pieces.sparkSession, base, "blocks", folder)


def read_block(spark: SparkSession, base: str, module: str) -> DataFrame:
    """The pieces of one module's block in order; no rows for an unknown module."""
    stored = spark.read.parquet(_current(spark, base, "blocks"))
    return stored.filter(F.col("module") == module).orderBy("part", "i", "j")


# ---- token tables ------------------------------------------------------------------------------------

def write_index(index: DataFrame, base: str, kind: str) -> int:
    """Store a table of tokens ordered by token, so a lookup by token or prefix prunes row groups."""
    folder = f"{kind}-{uuid.uuid4().hex}"
    _ordered(index, "token", "name").write.parquet(f"{base}/{folder}")
    return _publish(index.sparkSession, base, kind, folder)


def read_index(spark: SparkSession, base: str, kind: str) -> DataFrame:
    return spark.read.parquet(_current(spark, base, kind))
