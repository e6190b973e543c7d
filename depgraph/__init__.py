"""depgraph: dependency-graph analytics expressed as Spark DataFrame jobs."""
