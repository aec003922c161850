"""treelight: a Spark-native engine for name, path and content search over very large trees."""

__version__ = "0.1.0"
