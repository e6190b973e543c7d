"""Stages of the derived graph, each computed once per session and kept as a table."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depgraph.operators import blocks as B
from depgraph.operators import build
from depgraph.operators import map_layout as M
from depgraph.operators import module_graph as G
from depgraph.operators import search as S
from depgraph.plans import fixture
from depgraph.session import materialize, materialize_all, new_path, tune
from depgraph.sources import files, pack, store
from depgraph.sources.feeds import Feeds


class Workspace:
    """Lazily built stages over the tables of one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = tune(spark)
        self.sf_dir = sf_dir

    @cached_property
    def tables(self) -> dict[str, DataFrame]:
        derived = fixture.spark_tables(self.spark, self.sf_dir)
        del derived["base"]
        # like sources and targets lie together, which halves the files and what the next exchange moves
        derived["deps"] = derived["deps"].sortWithinPartitions("src", "dst")
        return materialize_all(derived)

    @cached_property
    def feeds(self) -> Feeds:
        t = self.tables
        declarations = fixture.declaration_rows(t)
        return Feeds(
            modules=fixture.module_rows(t),
            namespaces=t["modules"].select(F.col("module").alias("namespace")),
            imports=t["imports"], declarations=declarations, extract=t["extract"], deps=t["deps"],
            extends=t["extends"], fields=t["fields"], constructors=t["constructors"],
        )

    @cached_property
    def graph(self) -> build.Graph:
        return build.build_graph(self.feeds, materialize_all)

    @cached_property
    def topics(self) -> DataFrame:
        return files.topic_dim(self.spark, fixture.TOPICS)

    @cached_property
    def module_graph(self) -> G.ModuleGraph:
        return G.module_graph(self.feeds.modules, self.feeds.imports, fixture.ROOT)

    @cached_property
    def levels(self) -> DataFrame:
        return G.topological_levels(self.module_graph)

    @cached_property
    def order(self) -> DataFrame:
        return materialize(G.topological_order(self.levels), "order")

    @cached_property
    def closure(self) -> DataFrame:
        return G.closure(self.module_graph.edges, self.levels, self.order)

    @cached_property
    def scores(self) -> DataFrame:
        g = self.module_graph
        return materialize(G.pagerank(g.nodes, g.edges, g.modules), "scores")

    @cached_property
    def map(self) -> M.ModuleMap:
        return M.module_map(
            self.feeds, self.topics, fixture.ROOT, graph=self.module_graph, levels=self.levels,
            words=self.closure, scores=self.scores, order=self.order,
        )

    @cached_property
    def blocks(self) -> B.Blocks:
        return B.module_blocks(self.feeds, self.module_graph.nodes)

    @cached_property
    def sources(self) -> DataFrame:
        return materialize(fixture.raw_sources(self.tables), "sources")

    @cached_property
    def stored_map(self) -> str:
        base = new_path(self.spark, "map")
        store.write_map(self.map, base, now="2024-01-01T00:00:00+00:00", seed=1)
        return base

    @cached_property
    def stored_pack(self) -> str:
        path = new_path(self.spark, "pack")
        stats = B.block_stats(self.blocks, self.blocks.decls.select(F.lit(0).alias("repeats")).limit(0)).first()
        pack.write_pack(self.blocks, path, "derived", "2024-01-01T00:00:00+00:00", fixture.ROOT, stats.asDict())
        return path

    @cached_property
    def stored_names(self) -> DataFrame:
        base = new_path(self.spark, "names")
        store.write_index(S.name_index(self.graph.declarations), base, "names")
        return store.read_index(self.spark, base, "names")

    @cached_property
    def stored_graph(self) -> str:
        base = new_path(self.spark, "graph")
        store.write_graph(self.graph, base)
        return base


_OPEN: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    """The workspace of this application for ``sf_dir``."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        _OPEN[key] = Workspace(spark, sf_dir)
    return _OPEN[key]
