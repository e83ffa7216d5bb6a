"""Media-signal analytics on Spark."""
