"""Reading and writing market files with Spark's own readers."""
