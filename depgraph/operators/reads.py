"""Read queries over the graph: dependencies, strips, lookups, details, health."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from depgraph.functions import checks
from depgraph.functions import columns as C
from depgraph.operators.build import Graph
from depgraph.session import materialize, materialize_with

EXTERNAL = "(external)"

_DETAIL = (
    "name", "shortName", "kind", "module", "typeSignature", "docstring", "sourceFile",
    "startLine", "endLine", "sourceText", "attrs", "isDeprecated", "isExternal",
)


def attributed(nodes: DataFrame) -> DataFrame:
    return nodes.filter("module IS NOT NULL")


def names_frame(graph: Graph, names: Sequence[str]) -> DataFrame:
    spark = graph.declarations.sparkSession
    return spark.createDataFrame([(name,) for name in names], "name string")


def busiest(graph: Graph, k: int, direction: str = "in") -> DataFrame:
    """The k attributed declarations with the most incoming or outgoing dependency edges."""
    near = "dst" if checks.direction(direction) == "in" else "src"
    counted = graph.depends_on.groupBy(F.col(near).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(attributed(graph.declarations).select("name"), "name", "leftsemi").orderBy(
        F.desc("n"), "name"
    ).limit(k).select("name")


def deps_cross(
    graph: Graph, names: DataFrame, direction: str = "in", limit: int | None = None
) -> DataFrame:
    """Cross-module dependency rows of each name: self and other side, and the edge (from, to) itself.

    Rows whose module is unknown on either side stay and show as ``(external)``.  With a ``limit``
    each name keeps its first rows by (module, name), with their ``place``, and ``cut`` says that
    there were more; the rank filter also runs before the exchange, so a hub sends few rows.
    """
    checks.direction(direction)
    near, far = ("dst", "src") if direction == "in" else ("src", "dst")
    nodes = graph.declarations.select("name", "kind", "module")
    # written first, so its real size decides whether the edges have to move at all
    own = materialize(nodes.join(names.select("name").distinct(), "name", "leftsemi").select(
        F.col("name").alias("self"), F.col("kind").alias("selfKind"), F.col("module").alias("selfModule")
    ), "asked")
    pairs = graph.depends_on.select(F.col(near).alias("self"), F.col(far).alias("other"))
    other = nodes.select(
        F.col("name").alias("other"), F.col("kind").alias("otherKind"), F.col("module").alias("otherModule")
    )
    crossing = (
        F.col("otherModule").isNull() | F.col("selfModule").isNull()
        | (F.col("otherModule") != F.col("selfModule"))
    )
    source, target = ("other", "self") if direction == "in" else ("self", "other")
    # the few asked names cut the edges down before repeated pairs are removed
    rows = pairs.join(own, "self").distinct().join(other, "other").filter(crossing).select(
        "self", "selfKind", "other", "otherKind",
        F.coalesce("otherModule", F.lit(EXTERNAL)).alias("otherModule"),
        F.col(source).alias("from"), F.col(f"{source}Kind").alias("fromKind"),
        F.col(target).alias("to"), F.col(f"{target}Kind").alias("toKind"),
    )
    if limit is None:
        return rows
    by_name = Window.partitionBy("self")
    place = F.row_number().over(by_name.orderBy("otherModule", "other"))
    # one row beyond the limit is enough to know that there are more
    few = rows.withColumn("place", place).filter(F.col("place") <= limit + 1)
    marked = few.withColumn("cut", F.max("place").over(by_name) > limit)
    return marked.filter(F.col("place") <= limit)


def deps_grouped(rows: DataFrame) -> DataFrame:
    """Dependency rows as groups by the other side's module: every edge of a group, with the number of
    edges in the group and of the name in all.  Counts combine before the shuffle, so a hub is no hot task.
    """
    rows = materialize(rows, "grouped-deps")
    groups = rows.groupBy("self", "otherModule").agg(F.count(F.lit(1)).alias("edges"))
    totals = groups.groupBy("self").agg(F.sum("edges").alias("total"))
    return (
        rows.select("self", "otherModule", "from", "fromKind", "to", "toKind")
        .join(groups, ["self", "otherModule"]).join(totals, "self")
    )


def decl_deps(graph: Graph, name: str, direction: str = "in", limit: int = 200) -> DataFrame:
    """The first dependency rows of one declaration; an unknown name is an error."""
    if graph.declarations.filter(F.col("name") == name).isEmpty():
        raise checks.UnknownName(f"unknown declaration: {name}")
    near = "dst" if checks.direction(direction) == "in" else "src"
    touching = replace(graph, depends_on=graph.depends_on.filter(F.col(near) == name))
    return deps_cross(touching, names_frame(graph, [name]), direction, checks.clamp(limit, checks.DEPS_LIMIT))


def strip_edges(graph: Graph, a: str, b: str) -> DataFrame:
    """All distinct declaration edges from module a to module b."""
    checks.distinct_pair(a, b)
    nodes = graph.declarations.select("name", "kind", "module")
    src = materialize(nodes.filter(F.col("module") == a).select(
        F.col("name").alias("src"), F.col("kind").alias("srcKind")
    ), "strip")
    dst = nodes.filter(F.col("module") == b).select(
        F.col("name").alias("dst"), F.col("kind").alias("dstKind")
    )
    return graph.depends_on.select("src", "dst").join(src, "src").join(dst, "dst").select(
        "src", "srcKind", "dst", "dstKind"
    ).distinct()


def dep_strip(graph: Graph, a: str, b: str, limit: int = 500) -> DataFrame:
    """The first edges from module a to module b in name order; ``cut`` says that there are more."""
    limit = checks.clamp(limit, checks.STRIP_LIMIT)
    few = strip_edges(graph, a, b).orderBy("src", "dst").limit(limit + 1)
    place = F.row_number().over(Window.orderBy("src", "dst"))  # at most limit + 1 rows are left here
    marked = few.withColumn("place", place).withColumn("cut", F.max("place").over(Window.partitionBy()) > limit)
    return marked.filter(F.col("place") <= limit).orderBy("src", "dst").drop("place")


def strip_grouped(rows: DataFrame) -> DataFrame:
    """Strip rows as groups by source: every edge, with the number of edges of its source and of all."""
    rows, counts = materialize_with(rows.select("src", "srcKind", "dst", "dstKind"), "grouped-strip", total=F.count(F.lit(1)))
    groups = rows.groupBy("src").agg(F.count(F.lit(1)).alias("edges"))
    return rows.join(groups, "src").withColumn("total", F.lit(counts["total"]).cast("bigint"))


def module_edges(graph: Graph) -> DataFrame:
    """Distinct declaration edges between attributed declarations, with kinds and modules of both ends.

    They come in ranges of (srcModule, dstModule, src, dst), and repeats are dropped there.  The join on the target
    goes first: after the one on the source, rows of a source lie together and take little room in the last exchange.
    """
    nodes = attributed(graph.declarations)
    src = nodes.select(F.col("name").alias("src"), F.col("kind").alias("srcKind"), F.col("module").alias("srcModule"))
    dst = nodes.select(F.col("name").alias("dst"), F.col("kind").alias("dstKind"), F.col("module").alias("dstModule"))
    joined = graph.depends_on.select("src", "dst").join(dst, "dst").join(src, "src")
    rows = joined.select("dst", "src", "srcKind", "srcModule", "dstKind", "dstModule")
    return rows.repartitionByRange("srcModule", "dstModule", "src", "dst").distinct()


def module_strips(edges: DataFrame) -> DataFrame:
    """Number of declaration edges (of :func:`module_edges`) for every ordered pair of different modules.

    Most pairs have few edges, so rows are dealt out by pair once and counted by source and by pair where they arrive.
    Edges are stored in ranges of the pair, so ranges of it keep like rows together on their way.
    """
    pair = ["srcModule", "dstModule"]
    crossing = edges.filter("srcModule <> dstModule").select(*pair, "src").repartitionByRange(*pair)
    by_source = crossing.groupBy(*pair, "src").agg(F.count(F.lit(1)).alias("edges"))
    return by_source.groupBy(*pair).agg(F.sum("edges").alias("edges"), F.count("src").alias("sources"))


def decl_detail(graph: Graph, name: str) -> DataFrame:
    """All columns of one declaration with its source link; unknown names are an error."""
    row = detail_rows(graph.declarations.filter(F.col("name") == name))
    if row.isEmpty():
        raise checks.UnknownName(f"unknown declaration: {name}")
    return row


def detail_rows(nodes: DataFrame) -> DataFrame:
    link = C.source_url(F.col("module"), F.col("startLine"))
    return nodes.select(*_DETAIL, link.alias("sourceUrl"))


def batch_lookup(graph: Graph, names: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """One row per requested (place, name) that exists, with the chosen fields."""
    wanted = checks.fields(fields)
    link = C.source_url(F.col("module"), F.col("startLine"))
    rows = names.join(graph.declarations, "name").withColumn("sourceUrl", link)
    return rows.select("place", *wanted)


def decls_batch(graph: Graph, names: Sequence[str], fields: Sequence[str] | None = None) -> DataFrame:
    chosen = list(enumerate(checks.batch_names(names)))
    frame = graph.declarations.sparkSession.createDataFrame(chosen, "place bigint, name string")
    return batch_lookup(graph, frame, fields)


def health_counts(graph: Graph, version: int | None, layout_present: bool) -> DataFrame:
    decls = attributed(graph.declarations).agg(F.count(F.lit(1)).alias("decls"))
    modules = graph.modules.agg(F.count(F.lit(1)).alias("modules"))
    both = decls.unionByName(modules, allowMissingColumns=True)
    return both.agg(F.sum("decls").alias("decls"), F.sum("modules").alias("modules")).select(
        "decls", "modules", F.lit(version).cast("bigint").alias("kgVersion"),
        F.lit(layout_present).alias("layoutPresent"),
    )


def duplicate_keys(graph: Graph) -> DataFrame:
    """(label, name, copies) of node names that are not unique within their label."""
    keyed = graph.declarations.select(F.lit("Declaration").alias("label"), "name")
    keyed = keyed.unionByName(graph.modules.select(F.lit("Module").alias("label"), "name"))
    keyed = keyed.unionByName(graph.namespaces.select(F.lit("Namespace").alias("label"), "name"))
    return keyed.groupBy("label", "name").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def create_views(graph: Graph, prefix: str = "") -> list[str]:
    """Register every graph table as a temporary view for ad-hoc SQL."""
    views = []
    for name, table in graph.tables().items():
        table.createOrReplaceTempView(prefix + name)
        views.append(prefix + name)
    return views
