"""Panel credit analytics expressed as Spark DataFrame jobs."""
