"""The module map: topics, coordinates, radii, statistics and edge salience."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depgraph.functions import columns as C
from depgraph.operators import module_graph as G
from depgraph.operators.ranking import dense_index, position_in_group, running_max
from depgraph.operators.structure import RELATIONS, structure_edges
from depgraph.session import materialize
from depgraph.sources.feeds import Feeds

DEFAULT_TOPIC = "_default"
_MAX_TOPICS = 10_000


@dataclass(frozen=True)
class ModuleMap:
    """Tables of a finished map.

    nodes      topo, name, topic, x, y, r, color, declCount, closureSize, isDeprecated,
               title, docstring
    edges      dep, importer (names; reduced imports)
    structure  rel, src, dst (names)
    topics     priority, id, label, y, color
    stats      one row
    """

    nodes: DataFrame
    edges: DataFrame
    structure: DataFrame
    topics: DataFrame
    stats: DataFrame


def assign_topics(nodes: DataFrame, topics: DataFrame, root: str) -> DataFrame:
    """(id, name, topic, band, color): the first topic whose prefix the name has, else the default.

    ``root.<id>.`` can only match a name at one of the name's own dots, so the names are
    joined on their prefixes with an equality instead of being compared with each topic.
    """
    tails = F.split(F.substring(F.col("name"), len(root) + 2, 2_147_483_647), r"\.")
    ids = F.transform(
        F.sequence(F.lit(1), F.size("tails") - 1),
        lambda depth: F.array_join(F.slice("tails", F.lit(1), depth), "."),
    )
    prefixes = nodes.select("id", "name", tails.alias("tails")).filter(F.size("tails") > 1).select(
        F.col("id").alias("node"), F.explode(ids).alias("id")
    )
    ranked = topics.filter(F.col("id") != DEFAULT_TOPIC).groupBy("id").agg(
        F.min_by(F.struct("priority", "id", "y", "color"), "priority").alias("t")
    )
    matched = prefixes.join(ranked, "id").groupBy(F.col("node").alias("id")).agg(F.min("t").alias("t"))
    default = topics.filter(F.col("id") == DEFAULT_TOPIC).orderBy("priority").first()
    return nodes.join(matched, "id", "left").select(
        "id", "name",
        F.coalesce("t.id", F.lit(DEFAULT_TOPIC)).alias("topic"),
        F.coalesce("t.y", F.lit(default["y"])).alias("band"),
        F.coalesce("t.color", F.lit(default["color"])).alias("color"),
    )


def unmatched_prefixes(topics_of: DataFrame) -> DataFrame:
    """Default-topic modules counted by their second name segment, most frequent first."""
    parts = F.split("name", r"\.")
    prefix = F.when(F.size(parts) > 2, F.element_at(parts, 2)).otherwise(F.lit("(root)"))
    return topics_of.filter(F.col("topic") == DEFAULT_TOPIC).groupBy(prefix.alias("prefix")).agg(
        F.count(F.lit(1)).alias("modules")
    ).orderBy(F.desc("modules"), "prefix")


def radii(scores: DataFrame) -> DataFrame:
    """(id, score, r); the range of the scores is a single row of two numbers."""
    low, high = scores.agg(F.min("score"), F.max("score")).first()
    return scores.withColumn("r", C.radius(F.col("score"), F.lit(low), F.lit(high)))


def node_x(sizes: DataFrame, levels: DataFrame) -> DataFrame:
    """(id, closureSize, x): closure size to the power 0.72.

    Nodes without dependencies are the first in the topological order, by name rank
    (= id), and spread over x = 0, -1, ..., -9 in that order.
    """
    leaves = dense_index(levels.filter("level = 0").select("id"), ["id"], "leaf")
    return sizes.join(leaves, "id", "left").select(
        "id", "closureSize",
        F.when(F.col("closureSize") == 0, C.spread_x(F.col("leaf")))
        .otherwise(C.closure_x(F.col("closureSize"))).alias("x"),
    )


def swimlane_y(placed: DataFrame) -> DataFrame:
    """Add y: the topic band plus a zigzag slot inside each (column, topic), in topo order."""
    lanes = placed.withColumn("lane", F.col("x").cast("bigint"))
    slotted = position_in_group(lanes, ["lane", "topic"], ["topo"], "slot")
    return slotted.withColumn("y", F.col("band") + C.zigzag(F.col("slot"))).drop("lane", "slot")


def neighbour_y(placed: DataFrame, edges: DataFrame) -> DataFrame:
    """Replace y (band and slot, as :func:`swimlane_y` gives them) by a place near the dependencies of the same topic.

    A module aims at the mean of its band and the y of its direct dependencies of its own topic.  In each column modules
    are taken by their aim, then in topological order, and each gets the first whole slot from its aim upwards that lies
    above the one before it, so no two modules of a column share a slot.  The slot of the i-th module is i plus the greatest ``floor(aim) - i`` so far, a running maximum, so no column
    is walked one by one.
    """
    deps = placed.select(F.col("id").alias("dep"), F.col("topic").alias("dep_topic"), F.col("y").alias("dep_y"))
    own = placed.select(F.col("id").alias("importer"), "topic")
    near = edges.join(deps, "dep").join(own, "importer").filter("topic = dep_topic").groupBy(F.col("importer").alias("id")).agg(
        F.sum("dep_y").alias("near_y"), F.count(F.lit(1)).alias("near")
    )
    mean = (F.col("band") + F.coalesce("near_y", F.lit(0.0))) / (F.lit(1) + F.coalesce("near", F.lit(0)))
    aimed = placed.join(near, "id", "left").withColumns({"aim": mean, "lane": F.col("x").cast("bigint")})
    ranked = position_in_group(aimed, ["lane"], ["aim", "topo"], "place")
    lifted = running_max(ranked, ["aim", "topo"], "lift", F.floor("aim") - F.col("place"), ["lane"])
    slot = F.col("place") + F.col("lift")
    return lifted.withColumn("y", F.col("aim") + (slot - F.floor("aim"))).drop("near_y", "near", "aim", "lane", "place", "lift")


def decl_counts(declarations: DataFrame) -> DataFrame:
    return declarations.groupBy("module").agg(F.count(F.lit(1)).alias("declCount"))


def map_stats(
    nodes: DataFrame, direct: DataFrame, reduced: DataFrame, structure: DataFrame,
    external: int, bad_lines: int = 0,
) -> DataFrame:
    """One row of nine counters, from aggregates stacked under one schema."""
    def counted(df: DataFrame, **columns) -> DataFrame:
        return df.agg(*[column.cast("bigint").alias(name) for name, column in columns.items()])

    parts = [
        counted(nodes, modules=F.count(F.lit(1)),
                unmatchedTopicModules=F.count_if(F.col("topic") == DEFAULT_TOPIC)),
        counted(direct, edgesDirect=F.count(F.lit(1))),
        counted(reduced, edgesReduced=F.count(F.lit(1))),
        counted(structure, **{
            f"{rel}Edges": F.count_if(F.col("rel") == rel) for rel in RELATIONS
        }),
    ]
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    names = (
        "modules", "edgesDirect", "edgesReduced", "unmatchedTopicModules",
        *(f"{rel}Edges" for rel in RELATIONS),
    )
    summed = stacked.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in names])
    return summed.select(
        "modules", "edgesDirect", "edgesReduced",
        F.lit(external).cast("bigint").alias("skippedExternalImports"),
        F.lit(bad_lines).cast("bigint").alias("skippedBadLines"), "unmatchedTopicModules",
        *(f"{rel}Edges" for rel in RELATIONS),
    )


def named_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(importer, dep) ids -> (dep, importer) names."""
    importers = nodes.select(F.col("id").alias("importer"), F.col("name").alias("importer_name"))
    deps = nodes.select(F.col("id").alias("dep"), F.col("name").alias("dep_name"))
    return edges.join(importers, "importer").join(deps, "dep").select(
        F.col("dep_name").alias("dep"), F.col("importer_name").alias("importer")
    )


def module_map(
    feeds: Feeds, topics: DataFrame, root: str, bad_lines: int = 0,
    graph: G.ModuleGraph | None = None, levels: DataFrame | None = None,
    words: DataFrame | None = None, scores: DataFrame | None = None, near_dependencies: bool = False,
    order: DataFrame | None = None,
) -> ModuleMap:
    """The whole map; stages computed earlier may be passed in, ``words`` with the ``order`` they count in.  With ``near_dependencies`` y follows the dependencies
    of a module (:func:`neighbour_y`), without it the slot in its band alone.

    Rank and structure edges do not depend on the levels, so their jobs are submitted
    next to the level and closure jobs and share the cluster with them.
    """
    graph = graph or G.module_graph(feeds.modules, feeds.imports, root)

    def ranked() -> DataFrame:
        return materialize(G.pagerank(graph.nodes, graph.edges, graph.modules), "scores")

    with ThreadPoolExecutor(max_workers=2) as pool:
        structure_job = pool.submit(
            lambda: materialize(structure_edges(feeds, graph.nodes), "map_structure")
        )
        scores_job = pool.submit(ranked) if scores is None else None
        levels = levels if levels is not None else G.topological_levels(graph)
        places = order
        order = order if order is not None else materialize(G.topological_order(levels), "order")
        if words is None:
            words, places = G.closure(graph.edges, levels, order), order
        structure = structure_job.result()
        scores = scores if scores_job is None else scores_job.result()

    xs = node_x(G.closure_sizes(graph.nodes, words), levels)
    topics_of = assign_topics(graph.nodes, topics, root)
    placed = topics_of.join(order, "id").join(xs, "id").join(radii(scores), "id")
    props = feeds.modules.groupBy(F.col("module").alias("name")).agg(
        F.max_by(F.struct("isDeprecated", "title", "docstring"), "seq").alias("p")
    )
    counts = decl_counts(feeds.declarations).withColumnRenamed("module", "name")
    lanes = swimlane_y(placed)
    if near_dependencies:
        lanes = neighbour_y(lanes, graph.edges)
    nodes = lanes.join(props, "name").join(counts, "name", "left").select(
        "topo", "name", "topic", "x", "y", "r", "color",
        F.coalesce("declCount", F.lit(0)).alias("declCount"), "closureSize",
        F.col("p.isDeprecated").alias("isDeprecated"), F.col("p.title").alias("title"),
        C.truncate_doc(F.col("p.docstring")).alias("docstring"),
    )
    nodes = materialize(nodes, "map_nodes")
    reduced = materialize(named_edges(G.transitive_reduction(graph.edges, words, places), graph.nodes), "map_edges")
    stats = map_stats(nodes, graph.edges, reduced, structure, graph.external_imports, bad_lines)
    return ModuleMap(nodes, reduced, structure, topics, stats)


# ---- reads over a finished map --------------------------------------------------------------

def topic_anchors(nodes: DataFrame, topics: DataFrame) -> DataFrame:
    """Mean x and band of every topic that has nodes."""
    means = nodes.groupBy(F.col("topic").alias("id")).agg(F.avg("x").alias("x"))
    return topics.join(means, "id").select("id", "label", "x", "y")


def edges_by_index(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Name pairs -> index pairs (topo positions); names are kept for ordering."""
    dep = nodes.select(F.col("name").alias("dep"), F.col("topo").alias("dep_topo"))
    importer = nodes.select(F.col("name").alias("importer"), F.col("topo").alias("importer_topo"))
    return edges.join(dep, "dep").join(importer, "importer")


def structure_by_index(structure: DataFrame, nodes: DataFrame) -> DataFrame:
    src = nodes.select(F.col("name").alias("src"), F.col("topo").alias("src_topo"))
    dst = nodes.select(F.col("name").alias("dst"), F.col("topo").alias("dst_topo"))
    return structure.join(src, "src").join(dst, "dst")


def ordered_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Map edges in document order: by importer name, then dep name."""
    return edges_by_index(edges, nodes).orderBy("importer", "dep")


def ordered_structure(structure: DataFrame, nodes: DataFrame) -> DataFrame:
    return structure_by_index(structure, nodes).orderBy("rel", "src_topo", "dst_topo")


def edge_salience(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Import edges scored by the product of the radii of their ends."""
    dep = nodes.select(F.col("name").alias("dep"), F.col("r").alias("dep_r"))
    importer = nodes.select(F.col("name").alias("importer"), F.col("r").alias("importer_r"))
    return relations.filter("rel = 'import'").join(dep, "dep").join(importer, "importer").select(
        "dep", "importer", (F.col("dep_r") * F.col("importer_r")).alias("score")
    )


def densest_edges(salience: DataFrame, density: float) -> DataFrame:
    """The top round(density * E) edges by salience; none at density 0.

    The cut grows with the edges, so it is a filter on a distributed rank and not a
    ``limit``, which would gather the kept rows in one task.
    """
    total = salience.count()
    ranked = dense_index(
        salience.withColumn("falling", -F.col("score")), ["falling", "dep", "importer"], "place"
    )
    return ranked.filter(F.col("place") < int(density * total + 0.5)).drop("falling")
