"""Login-risk analytics expressed as Spark jobs."""
