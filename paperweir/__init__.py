"""paperweir: a PySpark-native engine for capturing, verifying, cleaning and publishing reading material."""

__version__ = "0.1.0"
