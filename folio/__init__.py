"""Document analytics and vector retrieval expressed as Spark DataFrame jobs."""
