"""Data-quality checks, cleaning and profiling of tables, as Spark jobs."""
