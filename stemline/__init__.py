"""stemline: Spark-native analytics over temporal lineage graphs."""

__version__ = "0.1.0"
