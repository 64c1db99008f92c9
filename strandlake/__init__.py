"""Error-protected sequence archives and data pipelines on Spark."""
