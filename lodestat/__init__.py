"""Statistical analysis of tables as Spark jobs."""
