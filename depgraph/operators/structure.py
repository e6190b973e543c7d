"""Module-level structure edges and the multi-relation edge table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depgraph.functions import columns as C
from depgraph.sources.feeds import Feeds

RELATIONS = ("extends", "instantiates", "fields")


def module_of_name(extract: DataFrame) -> DataFrame:
    """name -> defining module; a repeated name keeps its last record."""
    return extract.filter("module <> ''").groupBy("name").agg(
        F.max_by("module", "seq").alias("module")
    )


def structure_targets(feeds: Feeds) -> DataFrame:
    """(rel, src_module, target) of every relation, distinct before anything is joined."""
    extends = feeds.extends.select(F.lit("extends").alias("rel"), "module", F.col("dst").alias("target"))
    instances = feeds.extract.filter("instantiates <> ''").select(
        F.lit("instantiates").alias("rel"), "module", F.col("instantiates").alias("target")
    )
    fields = feeds.fields.select(F.lit("fields").alias("rel"), "module", F.col("dst").alias("target"))
    return extends.unionByName(instances).unionByName(fields).filter("module <> ''").distinct()


def structure_edges(feeds: Feeds, alive: DataFrame) -> DataFrame:
    """(rel, src, dst): distinct cross-module pairs among the alive modules (name).

    A field target without a record of its own resolves through its owner, the name
    before the final dot.
    """
    homes = module_of_name(feeds.extract)
    living = alive.select(F.col("name").alias("module"))
    targets = structure_targets(feeds).join(living, "module", "leftsemi")
    exact = homes.select(F.col("name").alias("target"), F.col("module").alias("home"))
    found = targets.join(exact, "target", "left")
    owner = F.when((F.col("rel") == "fields") & F.col("home").isNull(), C.owner_prefix(F.col("target")))
    owners = homes.select(F.col("name").alias("owner"), F.col("module").alias("owner_home"))
    resolved = found.withColumn("owner", owner).join(owners, "owner", "left").select(
        "rel", F.col("module").alias("src"), F.coalesce("home", "owner_home").alias("dst")
    )
    return resolved.filter("dst IS NOT NULL AND dst <> src").distinct().join(
        living.select(F.col("module").alias("dst")), "dst", "leftsemi"
    ).select("rel", "src", "dst")


def all_relations(import_edges: DataFrame, structure: DataFrame) -> DataFrame:
    """Parallel edges of all relations as (rel, dep, importer).

    ``import_edges`` holds (dep, importer); structure rows point from the dependent at
    its foundation, so src is the importer side and dst the dep side.
    """
    imports = import_edges.select(F.lit("import").alias("rel"), "dep", "importer")
    return imports.unionByName(
        structure.select("rel", F.col("dst").alias("dep"), F.col("src").alias("importer"))
    )


def relation_filter(edges: DataFrame, relations: Sequence[str]) -> DataFrame:
    return edges.filter(F.col("rel").isin(*relations)) if relations else edges.filter(F.lit(False))
