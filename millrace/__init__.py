"""millrace: a Spark-native engine for building, checking and repairing SQL data pipelines."""

__version__ = "0.1.0"
