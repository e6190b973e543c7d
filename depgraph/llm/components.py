"""Connected components by alternating large-star and small-star rounds.

Every round hangs the neighbours of a node on the smallest node it knows; the edge table shrinks to
one star for each component within a number of rounds logarithmic in the component's size.  Minima
combine before the shuffle and the joins back are one-to-many, so nodes of any degree are split by
adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depgraph.session import Rounds, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) of every node with an edge other than the roots themselves.

    ``edges``: u, v of one integer type, in any direction; loops and repeated edges have no effect.
    """
    rounds = Rounds(edges.sparkSession, "stars")
    code = F.xxhash64("u", "v").cast("decimal(20,0)")
    now = materialize(edges.select("u", "v").filter("u != v").distinct(), "edges")
    seen = None
    while True:
        now, found = rounds.add(
            _small_star(_large_star(now)), n=F.count(F.lit(1)), code=F.sum(code)
        )
        if (found["n"], found["code"]) == seen:
            break
        seen = (found["n"], found["code"])
    return materialize(now.select(F.col("u").alias("node"), F.col("v").alias("root")), "components")
