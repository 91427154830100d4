"""factgraph: a PySpark-native knowledge-graph engine (see README.md)."""
