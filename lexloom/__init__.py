"""lexloom: a Spark-native engine for descriptor taxonomies over large document collections."""

__version__ = "0.1.0"
