"""Repository security analytics expressed as Spark jobs."""
