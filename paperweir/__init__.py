"""A PySpark-native engine that turns document collections into structured, redacted Markdown."""
