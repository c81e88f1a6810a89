"""folioforge: Spark-native query and data processing for multilingual document archives."""

__version__ = "0.1.0"
