"""quern: a PySpark-native analytics engine for conversational session records."""

__version__ = "0.1.0"
