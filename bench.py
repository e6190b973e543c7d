"""Times the headline jobs and prints one JSON line.

Every timing starts from the driver's Parquet tables or from stages named in the key and
ends when the result rows have been written or counted.  A run over the smallest tables
first warms the JVM up.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from depgraph.operators import blocks, build, map_layout, reads
from depgraph.plans import fixture
from depgraph.plans.workspace import Workspace
from depgraph.session import materialize

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
WARM_DIR = os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.001")
CPUS = os.environ.get("BENCH_CPUS", "8")


def run(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    work = Workspace(spark, sf_dir)
    seconds: dict[str, float] = {}

    def timed(key: str, job) -> None:
        started = time.perf_counter()
        job()
        seconds[key] = round(time.perf_counter() - started, 3)

    timed("input_tables", lambda: work.tables)
    timed("graph_build", lambda: work.graph)
    timed("module_map", lambda: map_layout.module_map(work.feeds, work.topics, fixture.ROOT).stats.collect())
    timed("module_blocks", lambda: blocks.module_blocks(work.feeds, work.module_graph.nodes))
    graph = work.graph

    def dependency_groups() -> None:
        rows = reads.deps_cross(graph, reads.busiest(graph, 10), "in", 200)
        reads.deps_grouped(rows).collect()

    timed("dependency_groups", dependency_groups)
    timed("module_strips", lambda: materialize(reads.module_strips(reads.module_edges(graph)), "strips"))
    timed("node_table", lambda: materialize(build.declaration_nodes(work.feeds), "nodes"))
    return seconds


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("depgraph-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if os.path.isdir(WARM_DIR):
        run(spark, WARM_DIR)
    seconds = run(spark, SF_DIR)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
