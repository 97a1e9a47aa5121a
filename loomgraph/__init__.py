"""loomgraph: a Spark-first analytics engine for code property graphs."""
