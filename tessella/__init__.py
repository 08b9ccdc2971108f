"""tessella: a PySpark-native analytics engine for wide tables and training-data corpora."""

__version__ = "0.1.0"
