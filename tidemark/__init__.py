"""Document-stream analytics on Spark."""
