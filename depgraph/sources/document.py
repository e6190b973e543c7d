"""The map as one JSON document: the same map gives the same bytes, however its tables are partitioned.

Sections follow each other as meta, topics, nodes (in topological order), edges (pairs of node positions,
dependency first, by the names of importer and dependency) and structure edges by relation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depgraph.operators.map_layout import ModuleMap, edges_by_index, structure_by_index
from depgraph.operators.structure import RELATIONS
from depgraph.sources.byte_files import write_one_file

SCHEMA_VERSION = 2
_ORDER = ["section", "a", "b", "s", "t"]
#: Decimals of coordinates and radii: sums of floating-point numbers differ in the last bits from run to run.
DECIMALS = 9


def _json(*columns) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def document_lines(doc: ModuleMap, version: str, now: str, scope: str) -> DataFrame:
    """(section, a, b, s, t, text): the document in pieces, each a node, a pair or a bracket, in the order of the keys."""

    def piece(rows: DataFrame, section: int, text: Column, a: Column | None = None, b=None, s=None, t=None) -> DataFrame:
        number, name = F.lit(0).cast("bigint"), F.lit("")
        return rows.select(
            F.lit(section).alias("section"), (number if a is None else a.cast("bigint")).alias("a"),
            (number if b is None else b.cast("bigint")).alias("b"), (name if s is None else s).alias("s"),
            (name if t is None else t).alias("t"), text.alias("text"),
        )

    def listed(rows: DataFrame, section: int, text: Column, *keys: str, **order: Column) -> DataFrame:
        """Items of a list: all but the one with the least keys begin with a comma."""
        least = rows.agg(F.min(F.struct(*keys)).alias("least")).first()["least"]
        first = F.lit(False)
        if least is not None:
            first = F.lit(True)
            for key in keys:
                first = first & (F.col(key) == F.lit(least[key]))
        return piece(rows, section, F.concat(F.when(first, "").otherwise(","), text), **order)

    stats = [c for c in doc.stats.columns]
    meta = F.struct(
        F.lit(version).alias("version"), F.lit(now).alias("generatedAt"), F.lit(scope).alias("scope"), F.struct(*stats).alias("stats")
    )
    head = _json(F.lit(SCHEMA_VERSION).alias("schemaVersion"), meta.alias("meta"))
    opening = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"topics":['))
    one = doc.stats.select(F.lit(1).alias("one"))
    rounded = {c: F.round(c, DECIMALS).alias(c) for c in ("x", "y", "r")}
    nodes = [rounded.get(c, F.col(c)) for c in ("name", "topic", "x", "y", "r", "color", "declCount", "closureSize", "isDeprecated", "title", "docstring")]

    def pair(a: str, b: str) -> Column:
        return F.concat(F.lit("["), F.col(a).cast("string"), F.lit(","), F.col(b).cast("string"), F.lit("]"))

    parts = [
        piece(doc.stats, 0, opening),
        listed(doc.topics, 1, _json("id", "label", "y", "color"), "priority", a=F.col("priority")),
        piece(one, 2, F.lit('],"nodes":[')),
        listed(doc.nodes, 3, _json(*nodes), "topo", a=F.col("topo")),
        piece(one, 4, F.lit('],"edges":[')),
        listed(edges_by_index(doc.edges, doc.nodes), 5, pair("dep_topo", "importer_topo"), "importer", "dep", s=F.col("importer"), t=F.col("dep")),
        piece(one, 6, F.lit('],"structureEdges":{')),
    ]
    pairs = structure_by_index(doc.structure, doc.nodes)
    for i, rel in enumerate(RELATIONS):
        opened = f'{"," if i else ""}"{rel}":['
        own = pairs.filter(F.col("rel") == rel)
        parts += [
            piece(one, 7 + 3 * i, F.lit(opened)),
            listed(own, 8 + 3 * i, pair("src_topo", "dst_topo"), "src_topo", "dst_topo", a=F.col("src_topo"), b=F.col("dst_topo")),
            piece(one, 9 + 3 * i, F.lit("]")),
        ]
    parts.append(piece(one, 7 + 3 * len(RELATIONS), F.lit("}}")))
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part)
    return lines


def write_document(doc: ModuleMap, path: str, version: str, now: str, scope: str) -> str:
    """Writes the document and returns the SHA-256 of its bytes, which is kept beside it as well."""
    return write_one_file(document_lines(doc, version, now, scope), _ORDER, path)
