"""Property-graph analytics, retrieval and corpus operators on PySpark."""
