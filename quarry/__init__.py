"""A PySpark-native engine for source-tree and text analysis."""
