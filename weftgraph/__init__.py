"""weftgraph: a PySpark-native analytics engine for code property graphs."""

__version__ = "0.1.0"
