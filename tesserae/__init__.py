"""A PySpark-native analytics engine: SQL over sorted immutable parts, vectors, graphs, and keyed in-memory tables."""
