"""Media-library analytics as declarative Spark plans."""
