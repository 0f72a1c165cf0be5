"""Text classification analytics expressed as Spark DataFrame jobs."""
