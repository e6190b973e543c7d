"""Per-module declaration blocks: declarations, their inner edges and coordinates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depgraph.functions import columns as C
from depgraph.operators.build import Graph
from depgraph.operators.module_graph import peel
from depgraph.operators.ranking import dense_index, position_in_group, running_total
from depgraph.operators.structure import module_of_name
from depgraph.session import materialize
from depgraph.sources.feeds import Feeds

SCHEMA_VERSION = 1
ROW_PITCH = 1.5
# A stored piece holds the declarations of one index range, or the edges between two.
PIECE = 256


@dataclass(frozen=True)
class Blocks:
    """decls: module, idx, name, k, inferred, x, y, s; edges: module, src_idx, dst_idx."""

    decls: DataFrame
    edges: DataFrame


def alive_records(extract: DataFrame, alive: DataFrame) -> DataFrame:
    living = alive.select(F.col("name").alias("module"))
    return extract.join(living, "module", "leftsemi")


def first_records(records: DataFrame) -> DataFrame:
    """The first record of every (module, name) in feed order."""
    kept = F.struct("instantiates", "nConstructors", "nExtends")
    return records.groupBy("module", "name").agg(
        F.min("seq").alias("seq"), F.min_by(kept, "seq").alias("r")
    ).select("module", "name", "seq", "r.*")


def duplicate_declarations(records: DataFrame) -> DataFrame:
    """Names recorded more than once in a module, with the number of extra records."""
    return records.groupBy("module", "name").agg(
        (F.count(F.lit(1)) - 1).alias("repeats")
    ).filter("repeats > 0")


def kind_lookup(records: DataFrame, declarations: DataFrame) -> DataFrame:
    """Parsed kind by (module, name), else the kind inferred from the record."""
    parsed = declarations.filter("kind <> ''").groupBy("module", "name").agg(
        F.max_by("kind", F.struct("seq", "startLine")).alias("parsed")
    )
    inferred = C.infer_kind(F.col("instantiates"), F.col("nConstructors"), F.col("nExtends"))
    return records.join(parsed, ["module", "name"], "left").select(
        "module", "name", "seq", F.coalesce("parsed", inferred).alias("k"),
        F.col("parsed").isNull().alias("inferred"),
    )


def index_declarations(records: DataFrame, order: list[str]) -> DataFrame:
    """0-based declaration number inside each module."""
    return position_in_group(records, ["module"], order, "idx")


def intra_edges(deps: DataFrame, decls: DataFrame, homes: DataFrame) -> DataFrame:
    """(module, src_idx, dst_idx): dependencies of first records that stay in their module.

    The join on the target goes first: it drops the cross-module bulk of the edges.  Repeats are dropped at the end,
    where few rows are left.
    """
    at_home = decls.join(
        homes.select("name", F.col("module").alias("home")), "name"
    ).filter("home = module")
    targets = at_home.select("module", F.col("name").alias("dst"), F.col("idx").alias("dst_idx"))
    sources = decls.select("module", "seq", F.col("name").alias("src"), F.col("idx").alias("src_idx"))
    inner = deps.filter("src <> dst").select("module", "seq", "src", "dst")
    return inner.join(targets, ["module", "dst"]).join(
        sources, ["module", "src", "seq"]
    ).select("module", "src_idx", "dst_idx").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(module, idx, outDegree, degree) of declarations with at least one inner edge."""
    ends = edges.select("module", F.col("src_idx").alias("idx"), F.lit(1).alias("out")).unionByName(
        edges.select("module", F.col("dst_idx").alias("idx"), F.lit(0).alias("out"))
    )
    return ends.groupBy("module", "idx").agg(
        F.sum("out").alias("outDegree"), F.count(F.lit(1)).alias("degree")
    )


def depth_columns(decls: DataFrame, edges: DataFrame) -> DataFrame:
    """(module, idx, column): longest-path depth inside the module, foundations at 0.

    All modules are peeled together.  Declarations on or behind a cycle share the
    column after the deepest settled one of their module.
    """
    ids = materialize(dense_index(decls.select("module", "idx"), ["module", "idx"]), "block_ids")

    def numbered(idx: str, name: str):
        return ids.select("module", F.col("idx").alias(idx), F.col("id").alias(name))

    arcs = edges.join(numbered("src_idx", "importer"), ["module", "src_idx"]).join(
        numbered("dst_idx", "dep"), ["module", "dst_idx"]
    )
    levels, stuck = peel(ids.select("id"), arcs.select("importer", "dep"))
    levels = levels.join(ids, "id")
    deepest = levels.groupBy("module").agg(F.max("level").alias("deepest"))
    overflow = stuck.join(ids, "id").join(deepest, "module", "left").select(
        "module", "idx", (F.coalesce("deepest", F.lit(0)) + 1).alias("column")
    )
    return levels.select("module", "idx", F.col("level").alias("column")).unionByName(overflow)


def column_slots(columns: DataFrame) -> DataFrame:
    """Add the slot of each declaration inside its column, by declaration number."""
    return position_in_group(columns, ["module", "column"], ["idx"], "slot")


def lay_out(decls: DataFrame, edges: DataFrame) -> DataFrame:
    """Add x, y and s to indexed declarations."""
    slots = column_slots(depth_columns(decls, edges)).select(
        "module", "idx", F.col("column").cast("double").alias("x"),
        (C.zigzag(F.col("slot")) * ROW_PITCH).alias("y"),
    )
    degree = degrees(edges).select("module", "idx", "degree")
    return decls.join(slots, ["module", "idx"]).join(degree, ["module", "idx"], "left").withColumn(
        "s", C.node_size(F.coalesce("degree", F.lit(0)))
    ).drop("degree")


def module_blocks(feeds: Feeds, alive: DataFrame) -> Blocks:
    """Blocks of all alive modules (name), declarations in feed order."""
    records = kind_lookup(first_records(alive_records(feeds.extract, alive)), feeds.declarations)
    decls = materialize(index_declarations(records, ["seq", "name"]), "block_decls")
    homes = module_of_name(alive_records(feeds.extract, alive))
    edges = materialize(intra_edges(feeds.deps, decls, homes), "block_edges")
    placed = lay_out(decls, edges).select("module", "idx", "name", "k", "inferred", "x", "y", "s")
    return Blocks(materialize(placed, "blocks"), edges)


def live_blocks(graph: Graph, modules: DataFrame) -> Blocks:
    """Blocks of the given modules (name) from the stored graph, declarations in name order."""
    named = modules.select(F.col("name").alias("module")).distinct()
    nodes = graph.declarations.join(named, "module", "leftsemi").select(
        "module", "name", F.col("kind").alias("k")
    )
    decls = materialize(index_declarations(nodes, ["name"]), "live_decls")
    sources = decls.select(F.col("name").alias("src"), "module", F.col("idx").alias("src_idx"))
    targets = decls.select(F.col("name").alias("dst"), "module", F.col("idx").alias("dst_idx"))
    # edges are stored by source, so the join on the source moves little; repeats are dropped where few rows are left
    edges = graph.depends_on.filter("src <> dst").select("src", "dst").join(sources, "src").join(
        targets, ["module", "dst"]
    ).select("module", "src_idx", "dst_idx")
    edges = materialize(edges.distinct(), "live_edges")
    return Blocks(lay_out(decls, edges).select("module", "idx", "name", "k", "x", "y", "s"), edges)


def block_stats(blocks: Blocks, repeats: DataFrame) -> DataFrame:
    decls = blocks.decls.agg(
        F.count_distinct("module").alias("modules"), F.count(F.lit(1)).alias("decls"),
        F.count_if("inferred").alias("kindsInferred"),
    )
    edges = blocks.edges.agg(F.count(F.lit(1)).alias("edges"))
    extra = repeats.agg(F.coalesce(F.sum("repeats"), F.lit(0)).alias("duplicateNames"))
    stacked = decls.unionByName(edges, allowMissingColumns=True).unionByName(
        extra, allowMissingColumns=True
    )
    names = ("modules", "decls", "edges", "kindsInferred", "duplicateNames")
    return stacked.agg(*[F.sum(name).alias(name) for name in names])


def block_pieces(blocks: Blocks) -> DataFrame:
    """(module, part, i, j, payload): the blocks as JSON pieces of bounded size.

    Part 0 holds the declarations i*PIECE.. of a module, part 1 the edges from index
    range i to index range j.  Pairs are distinct, so a piece has at most PIECE
    declarations or PIECE * PIECE edges, however large its module is.
    """
    decls = blocks.decls.groupBy("module", F.expr(f"idx div {PIECE}").alias("i")).agg(
        F.array_sort(F.collect_list(F.struct("idx", "name", "k", "x", "y", "s"))).alias("d")
    ).select(
        "module", F.lit(0).alias("part"), "i", F.lit(0).cast("bigint").alias("j"),
        F.to_json(F.transform("d", lambda d: F.struct(
            d["name"].alias("name"), d["k"].alias("k"), d["x"].alias("x"), d["y"].alias("y"),
            d["s"].alias("s"),
        ))).alias("payload"),
    )
    edges = blocks.edges.groupBy(
        "module", F.expr(f"src_idx div {PIECE}").alias("i"), F.expr(f"dst_idx div {PIECE}").alias("j")
    ).agg(F.array_sort(F.collect_list(F.array("src_idx", "dst_idx"))).alias("e")).select(
        "module", F.lit(1).alias("part"), "i", "j", F.to_json("e").alias("payload")
    )
    return decls.unionByName(edges)


def block_index(pieces: DataFrame) -> DataFrame:
    """Add byte length ``l`` and byte offset ``o`` of every piece in (module, part, i, j) order."""
    sized = pieces.withColumn("l", F.octet_length("payload").cast("bigint"))
    return running_total(sized, ["module", "part", "i", "j"], "o", F.col("l"))


def module_index(index: DataFrame) -> DataFrame:
    """(module, o, l): byte range of each module in the concatenation of its pieces."""
    return index.groupBy("module").agg(F.min("o").alias("o"), F.sum("l").alias("l"))
