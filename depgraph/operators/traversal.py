"""Reachability around selected nodes: hops, neighbours, closures, selections.

Edges are rows (src, dst).  A walk keeps the visited sets in written tables and only
asks for the size of the newest frontier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depgraph.operators.ranking import dense_index
from depgraph.session import Rounds, materialize


# Origins in one word of a set, and nodes of a frontier that Catalyst may still send to every task.
_WORD = 64
_FEW = 100_000


def _walk(start: DataFrame, edges: DataFrame, rounds: int | None) -> DataFrame:
    """(origin, node) reached from ``start`` (origin, node) along src -> dst within ``rounds``.

    Origins are numbered, and a node holds the set of those that reach it as words of 64 bits: an edge moves one row
    for up to 64 origins.  Repeated edges only repeat bits.
    """
    steps = edges.select("src", "dst")
    visited = Rounds(edges.sparkSession, "walk")
    start = materialize(start.select("origin", "node").distinct(), "walk_start")
    numbers = materialize(dense_index(start.select("origin").distinct(), ["origin"], "number"), "walk_origins")
    word, bit = F.expr(f"number div {_WORD}"), F.expr(f"shiftleft(1L, CAST(number % {_WORD} AS INT))")
    frontier = materialize(start.join(numbers, "origin").groupBy("node", word.alias("word")).agg(
        F.bit_or(bit).alias("bits")
    ), "walk_first")
    many = False
    while rounds is None or len(visited) < rounds:
        # a large frontier has its nodes once a word: it is hashed, and the edges need no sorting
        near = frontier.hint("shuffle_hash") if many else frontier
        reached = steps.join(near, near["node"] == steps["src"]).select(
            F.col("dst").alias("node"), "word", "bits", F.lit(0).cast("bigint").alias("seen")
        )
        if len(visited):
            reached = reached.unionByName(visited.all().select(
                "node", "word", F.lit(0).cast("bigint").alias("bits"), F.col("bits").alias("seen")
            ))
        fresh = reached.groupBy("node", "word").agg(
            F.expr("bit_or(bits) & ~bit_or(seen)").alias("bits")
        ).filter("bits <> 0")
        frontier, counts = visited.add(fresh, rows=F.count(F.lit(1)))
        if not counts["rows"]:
            break
        many = counts["rows"] > _FEW
    # the bits of a word, spelled out by the origins of that word
    return visited.all().join(numbers.select("origin", word.alias("word"), bit.alias("bit")), "word").filter(
        "(bits & bit) <> 0"
    ).select("origin", "node")


def _reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _origins(names: DataFrame) -> DataFrame:
    return names.select(F.col("name").alias("origin"), F.col("name").alias("node"))


def k_hop(edges: DataFrame, names: DataFrame, k: int, backwards: bool = False) -> DataFrame:
    """(origin, node): nodes on a path of 1..k edges from each name; may hold the name itself."""
    return _walk(_origins(names), _reverse(edges) if backwards else edges, k)


def distinct_reach(reached: DataFrame) -> DataFrame:
    return reached.groupBy("origin").agg(F.count_distinct("node").alias("reached"))


def neighbors(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(origin, side, node) over import edges only; rows are (dep, importer, rel)."""
    imports = edges.filter("rel = 'import'")
    chosen = names.select(F.col("name").alias("origin"))
    deps = imports.join(chosen, imports["importer"] == chosen["origin"]).select(
        "origin", F.lit("dep").alias("side"), F.col("dep").alias("node")
    )
    dependents = imports.join(chosen, imports["dep"] == chosen["origin"]).select(
        "origin", F.lit("dependent").alias("side"), F.col("importer").alias("node")
    )
    return deps.unionByName(dependents).distinct()


def node_closure(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(origin, side, node): everything a name depends on and everything that depends on it."""
    imports = edges.filter("rel = 'import'").select(
        F.col("importer").alias("src"), F.col("dep").alias("dst")
    )
    start = _origins(names)
    deps = _walk(start, imports, None).withColumn("side", F.lit("dep"))
    dependents = _walk(start, _reverse(imports), None).withColumn("side", F.lit("dependent"))
    both = deps.unionByName(dependents).select("origin", "side", "node")
    return both.filter("node <> origin")


def selection(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(origin, node, role): the name itself, its neighbours and the rest of its closures."""
    near = neighbors(edges, names).select("origin", "node", F.lit(1).alias("rank"))
    far = node_closure(edges, names).select("origin", "node", F.lit(2).alias("rank"))
    own = names.select(F.col("name").alias("origin"), F.col("name").alias("node"), F.lit(0).alias("rank"))
    best = own.unionByName(near).unionByName(far).groupBy("origin", "node").agg(
        F.min("rank").alias("rank")
    )
    role = F.element_at(F.array(F.lit("focus"), F.lit("neighbor"), F.lit("closure")), F.col("rank") + 1)
    return best.select("origin", "node", role.alias("role"))


def highlight_tiers(
    nodes: DataFrame, selected: DataFrame | None, topic: str | None,
    hovered: DataFrame | None = None,
) -> DataFrame:
    """Tier of every node (name, topic) under a selection, a topic filter and a hover.

    ``selected`` and ``hovered`` hold (node, role).  Tiers: full, closure, topic, faded, dark.
    """
    in_topic = F.lit(False) if topic is None else F.col("topic") == topic
    if selected is not None:
        roles = selected.select(F.col("node").alias("name"), "role")
        tier = (
            F.when(F.col("role").isin("focus", "neighbor"), "full")
            .when(F.col("role") == "closure", "closure")
            .when(F.lit(topic is None), "dark")
            .when(in_topic, "topic")
            .otherwise("faded")
        )
        return nodes.join(roles, "name", "left").select("name", "topic", tier.alias("tier"))
    if topic is None:
        return nodes.select("name", "topic", F.lit("full").alias("tier"))
    if hovered is not None:
        roles = hovered.filter(F.col("role").isin("focus", "neighbor")).select(
            F.col("node").alias("name"), "role"
        )
        nodes = nodes.join(roles, "name", "left")
        near = F.col("role").isNotNull()
    else:
        near = F.lit(False)
    tier = F.when(in_topic, "topic").when(near, "full").otherwise("faded")
    return nodes.select("name", "topic", tier.alias("tier"))


def induced_edges(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """Edges (origin, rel, dep, importer) whose two ends both belong to the node set of an origin.

    ``selected``: origin, node; sets of different origins are kept apart.
    """
    chosen = selected.select("origin", "node").distinct()
    ends = edges.join(chosen.withColumnRenamed("node", "dep"), "dep")
    return ends.join(chosen.withColumnRenamed("node", "importer"), ["origin", "importer"], "leftsemi").select(
        "origin", "rel", "dep", "importer"
    )
