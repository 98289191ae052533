"""cairnlake: a Spark-first evidence memory, retrieval and corpus engine."""
